"""Mixing sources to target weights in a tree of domains, languages and sources.

A budget of tokens goes down the tree.  At each node it is shared among the children by their weights; a child that has less than its share
is filled and what it cannot take goes to its siblings by theirs, again and again.  As a node is never given more than all below it
have, a shortage is met by siblings first and reaches the parent's siblings only when a whole family is used up.  What integer
division leaves over goes, a token each, to the first children by name.

A leaf that may be repeated holds ``max_epochs`` times its tokens.  It is read in epochs, each in an order of its own, set by an MD5 of seed,
epoch and ``doc_id``; the leaf's share is the first tokens of this endless stream, the last document being cut.

Tokens are blank-separated words.  Cases: null, empty and blank texts have no tokens; they are taken where the stream passes them, and a leaf
that has no tokens gives nothing; null domains, languages and sources are nodes like others; a weight of 0 gives nothing, also
in a shortage; rows that repeat a ``doc_id`` are documents of their own; a budget above all there is takes all there is; an empty
table gives an empty result; very long texts are counted whole; documents at equal places of a stream stand by id, then by tokens and a
hash of the text; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailweave.llm.common import read, write_scratch
from mailweave.llm.rows import made_name, told_apart, without

LEVELS = ("domain", "lang", "source")
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


def node(value: Column) -> Column:
    """A name that tells a null from every text."""
    return F.coalesce(F.concat(F.lit("v:"), value.cast("string")), F.lit("n"))


def weight_of(level: str, weights: dict[str, dict[str, int]]) -> Column:
    """Whole-number weight of a node among its siblings; 1 where none is given."""
    given = weights.get(level) or {}
    out = F.lit(1)
    for name, units in given.items():
        out = F.when(F.col(level) == f"v:{name}", F.lit(units)).otherwise(out)
    return out.cast("long")


def fill(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Share each parent's ``budget`` among its children (weight > 0, capacity); adds ``share``.

    Children stand in the order of capacity by weight; those are filled whose capacity does not exceed what the level then is.
    There are as many rows as nodes in the tree.
    """
    whole = "decimal(38,0)"
    w, c = F.col("weight").cast(whole), F.col("capacity").cast(whole)
    order = Window.partitionBy(*parents).orderBy((F.col("capacity") / F.col("weight")).asc(), F.col(name))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = children.withColumn("_left", F.col("budget").cast(whole) - F.coalesce(F.sum(c).over(before), F.lit(0)))
    rows = rows.withColumn("_rest", F.sum(w).over(Window.partitionBy(*parents)) - F.coalesce(F.sum(w).over(before), F.lit(0)))
    rows = rows.withColumn("_full", c * F.col("_rest") <= F.col("_left") * w)
    family, open_ = Window.partitionBy(*parents), ~F.col("_full")
    rows = rows.withColumn("_pool", F.max(F.when(open_, F.col("_left"))).over(family)).withColumn(
        "_units", F.max(F.when(open_, F.col("_rest"))).over(family))
    part = F.when(F.col("_full"), F.col("capacity")).otherwise(F.floor(F.expr("cast(_pool as bigint) * cast(weight as bigint) div cast(_units as bigint)")))
    rows = rows.withColumn("share", part.cast("long"))
    spare = F.col("_pool").cast("long") - F.sum(F.when(open_, F.col("share"))).over(family)
    turn = F.row_number().over(Window.partitionBy(*parents, "_full").orderBy(name))
    rows = rows.withColumn("_spare", spare).withColumn("_turn", turn)
    return rows.withColumn("share", F.col("share") + F.when(open_ & (F.col("_turn") <= F.col("_spare")), 1).otherwise(0)).drop(
        "_left", "_rest", "_full", "_pool", "_units", "_spare", "_turn")


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], budget: Column, max_epochs: int, levels=LEVELS) -> DataFrame:
    """(levels..., tokens, share) for leaves (levels..., tokens); ``budget`` is computed from ``sum(tokens)`` as column ``all``."""
    sized = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    for level in levels:
        sized = sized.withColumn(f"_w_{level}", weight_of(level, weights))
    positive = sized
    for level in levels:
        positive = positive.filter(F.col(f"_w_{level}") > 0)
    given = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all")).select(budget.cast("long").alias("budget"), F.lit(0).alias("root"))
    above, keys = given, ["root"]
    for level in levels:
        below = positive.withColumn("root", F.lit(0)).groupBy(*keys, level).agg(
            F.sum("capacity").alias("capacity"), F.first(f"_w_{level}").alias("weight"))
        shared = fill(below.join(above, keys), keys, level)
        keys = [*keys, level]
        above = shared.select(*keys, F.col("share").alias("budget"))
    return leaves.join(above, list(levels), "left").select(*levels, "tokens", F.coalesce("budget", F.lit(0)).alias("share"))


def _order(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def select_prefixes(docs: DataFrame, shares: DataFrame, seed: int = SEED, levels=LEVELS, more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, levels..., epoch, tokens, and ``more`` columns of ``docs``): what each leaf's stream of epochs gives within its share.

    Whole epochs need no order.  In the last one positions are summed in two steps, over 4096 slices of the order and inside a
    slice, so that a leaf with a third of all documents is spread over as many tasks.
    """
    met = docs.join(shares.withColumnRenamed("tokens", "leaf_tokens").filter("share > 0"), list(levels))
    met = met.withColumn("whole", F.expr("share div leaf_tokens")).withColumn("rest", F.expr("share % leaf_tokens"))
    names = ["doc_id", *levels, *more]
    full = met.filter("whole > 0").select(*names, F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("epoch"), "tokens")
    last = met.filter("rest > 0").withColumn("place", _order(seed, F.col("whole"))).withColumn("slice", F.substring("place", 1, 3))
    sums = last.groupBy(*levels, "slice").agg(F.sum("tokens").alias("in_slice"))
    ahead = Window.partitionBy(*levels).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.coalesce(F.sum("in_slice").over(ahead), F.lit(0))).drop("in_slice")
    inside = Window.partitionBy(*levels, "slice").orderBy("place", "doc_id", "tokens", "mark").rowsBetween(Window.unboundedPreceding, -1)
    placed = last.join(sums, [*levels, "slice"]).filter("start < rest").withColumn(
        "before", F.col("start") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    cut = placed.filter("before < rest").select(*names, F.col("whole").alias("epoch"), F.least(F.col("tokens"), F.col("rest") - F.col("before")).alias("tokens"))
    return full.unionByName(cut)


def slim(docs: DataFrame, domain: Column) -> DataFrame:
    """(doc_id, domain, lang, source, tokens, mark) as nodes; texts are only counted."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", node(domain).alias("domain"), node(F.col("lang")).alias("lang"), node(F.col("source")).alias("source"),
                       F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"), F.xxhash64(text).alias("mark"))


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], budget: Column, max_epochs: int, seed: int = SEED,
        more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, tokens, and ``more`` columns of ``slim``) of what is selected; nodes are named by ``node``."""
    counted = write_scratch(slim(docs, domain), "mix-documents")
    leaves = counted.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    shares = write_scratch(leaf_budgets(leaves, weights, budget, max_epochs), "mix-shares")
    return select_prefixes(counted, shares, seed, more=more)


def keep_mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], budget: Column, seed: int = SEED) -> DataFrame:
    """Rows of ``docs`` that a mix without repeats selects, whole: a row stays if its own text was selected, not for another one's under its id.

    Rows without an id are selected like others; of rows that repeat ``doc_id`` and text one stays.
    """
    taken = write_scratch(mix(docs, domain, weights, budget, 1, seed, ("mark",)).select("doc_id", "mark").distinct(), "mix-taken")
    plain, odd = told_apart(docs)
    chosen = taken.select(made_name(F.col("doc_id"), F.col("mark")).alias("doc_id"))
    gone_odd = odd.select(F.col("name").alias("doc_id")).distinct().join(chosen, "doc_id", "left_anti")
    gone = plain.select(F.col("doc_id").cast("long").alias("doc_id")).join(taken.select("doc_id"), "doc_id", "left_anti")
    return without(plain, odd, gone.unionByName(gone_odd))


WEIGHTS = {"domain": {"src0": 4, "src1": 3}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 2}}


def domain_of_source() -> Column:
    """The domain of the test documents: the first four letters of the source's name."""
    return F.substring("source", 1, 4)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six tenths of all tokens in the mix of ``WEIGHTS``, every document twice at most."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    taken = mix(docs, domain_of_source(), WEIGHTS, F.expr("all * 6 div 10"), 2)
    return taken.select("doc_id", *[F.expr(f"substring({c}, 3)").alias(c) for c in LEVELS], "epoch", "tokens")


def _fill_sql(below: str, above: str, keys: str, name: str) -> str:
    """The same sharing in DuckDB: ``below`` (keys, name, capacity, weight) under ``above`` (keys, budget)."""
    return f"""
 (WITH a AS (SELECT b.*, u.budget FROM {below} b JOIN {above} u USING ({keys})),
  o AS (SELECT *, budget - coalesce(sum(capacity) OVER w, 0) AS lft, sum(weight) OVER (PARTITION BY {keys}) - coalesce(sum(weight) OVER w, 0) AS rst
        FROM a WINDOW w AS (PARTITION BY {keys} ORDER BY capacity::DOUBLE / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  f AS (SELECT *, capacity::HUGEINT * rst <= lft::HUGEINT * weight AS ful FROM o),
  p AS (SELECT *, max(CASE WHEN NOT ful THEN lft END) OVER (PARTITION BY {keys}) AS pool,
               max(CASE WHEN NOT ful THEN rst END) OVER (PARTITION BY {keys}) AS units FROM f),
  s AS (SELECT *, CASE WHEN ful THEN capacity ELSE pool * weight // units END AS share FROM p),
  t AS (SELECT *, pool - sum(CASE WHEN NOT ful THEN share END) OVER (PARTITION BY {keys}) AS spare,
               row_number() OVER (PARTITION BY {keys}, ful ORDER BY {name}) AS turn FROM s)
  SELECT {keys}, {name}, (share + CASE WHEN NOT ful AND turn <= spare THEN 1 ELSE 0 END)::BIGINT AS budget FROM t)"""


OP2_SQL = rf"""
WITH d AS (SELECT doc_id, 0 AS root, substr(source, 1, 4) AS domain, lang, source,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens FROM documents),
leaves AS (SELECT root, domain, lang, source, sum(tokens)::BIGINT AS tokens, 2 * sum(tokens)::BIGINT AS capacity FROM d GROUP BY ALL),
top AS (SELECT 0 AS root, (sum(tokens) * 6 // 10)::BIGINT AS budget FROM d),
c1 AS (SELECT root, domain, sum(capacity)::BIGINT AS capacity, CASE domain WHEN 'src0' THEN 4 WHEN 'src1' THEN 3 ELSE 1 END AS weight FROM leaves GROUP BY ALL),
b1 AS {_fill_sql("c1", "top", "root", "domain")},
c2 AS (SELECT root, domain, lang, sum(capacity)::BIGINT AS capacity, CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END AS weight
       FROM leaves GROUP BY ALL),
b2 AS {_fill_sql("c2", "b1", "root, domain", "lang")},
c3 AS (SELECT root, domain, lang, source, sum(capacity)::BIGINT AS capacity, 1 AS weight FROM leaves GROUP BY ALL),
b3 AS {_fill_sql("c3", "b2", "root, domain, lang", "source")},
m AS (SELECT d.*, b3.budget // l.tokens AS whole, b3.budget % l.tokens AS rest
      FROM d JOIN leaves l USING (root, domain, lang, source) JOIN b3 USING (root, domain, lang, source) WHERE b3.budget > 0),
e AS (SELECT doc_id, domain, lang, source, unnest(range(whole)) AS epoch, tokens FROM m WHERE whole > 0),
r AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat('{SEED}:', whole, ':', doc_id)), doc_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM m WHERE rest > 0)
SELECT doc_id, domain, lang, source, epoch, tokens FROM e
UNION ALL
SELECT doc_id, domain, lang, source, whole, least(tokens, rest - bef)::BIGINT FROM r WHERE bef < rest
"""
