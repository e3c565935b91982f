"""Changes and deletes at their own cost: touched buckets only, exact counts, folding."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from mailweave.operators import keyword as K
from mailweave.operators import maintenance as M
from mailweave.operators.keyed_table import KeyedTable
from mailweave.streaming.ingest import index_tables
from mailweave.streaming.parts import Parts
from tests.test_parts import batch_mails, scores


def files(root):
    return {f for f in glob.glob(f"{root}/**/*.parquet", recursive=True)}


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.fixture
def stored(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=16)
    table.create(spark.range(4000).select("id", F.concat(F.lit("v"), F.col("id")).alias("v"), F.lit(0).alias("version")))
    return table


def test_a_small_change_touches_its_buckets_only(spark, stored):
    before = files(stored.root)
    delta = spark.createDataFrame([(7, "seven", 1), (7, "SEVEN", 2), (9000, "new", 1)], "id long, v string, version int")
    stored.upsert(delta)
    stored.delete(spark.createDataFrame([(8,), (12345,)], "id long"))
    made = files(stored.root) - before
    assert before <= files(stored.root) and len(made) <= 4 and all("change-" in f for f in made)
    got = {r.id: r.v for r in stored.read().collect()}
    assert got[7] == "SEVEN" and got[9000] == "new" and 8 not in got and len(got) == 4000
    # Untouched buckets are read as they are: only the others meet the changes.
    now = stored.manifest.read()
    assert 0 < len(now["changes"]) <= 4


def test_equals_plain_upserts_and_deletes(spark, stored):
    base = spark.range(4000).select("id", F.concat(F.lit("v"), F.col("id")).alias("v"), F.lit(0).alias("version"))
    for turn in range(4):
        delta = spark.range(turn * 900, turn * 900 + 1200, 3).select("id", F.lit(f"turn{turn}").alias("v"), F.lit(turn).alias("version"))
        gone = spark.range(turn * 700, turn * 700 + 900, 5).select("id")
        stored.upsert(delta)
        stored.upsert(delta)  # twice is once
        stored.delete(gone)
        base = M.delete_rows(M.upsert(base, delta), gone, "id")
    assert rows_of(stored.read()) == rows_of(base.select("id", "v", "version"))


def test_folding_writes_full_buckets_and_no_other(spark, stored):
    one = [r.id for r in spark.range(4000).withColumn("b", stored.bucket()).filter("b = 3").select("id").collect()]
    stored.delete(spark.createDataFrame([(i,) for i in one[:5]], "id long"))
    before = files(stored.root)
    assert stored.manifest.read()["changes"].keys() == {"3"}
    stored.delete(spark.createDataFrame([(i,) for i in one[5:len(one) // 2]], "id long"))
    after, now = files(stored.root), stored.manifest.read()
    assert now["changes"] == {} and before <= after
    fresh = {f for f in after - before if "/rows-" in f}
    assert fresh and all("bucket=3" in f for f in fresh)
    assert {r.id for r in stored.read().collect()} == set(range(4000)) - set(one[:len(one) // 2])
    # The next change removes what the fold has replaced.
    stored.delete(spark.createDataFrame([(one[-1],)], "id long"))
    assert not any(f in files(stored.root) for f in before if "bucket=3" in f)


def test_odd_changes(spark, tmp_path, stored):
    stored.delete(spark.createDataFrame([], "id long"))
    stored.upsert(spark.createDataFrame([], "id long, v string, version int"))
    stored.upsert(spark.createDataFrame([(None, "no id", 1), (1, None, None)], "id long, v string, version int"))
    got = rows_of(stored.read().filter("id is null or id = 1"))
    assert got == sorted([(None, "no id", 1), (1, None, None)], key=str)
    empty = KeyedTable(spark, str(tmp_path / "e"))
    empty.create(spark.createDataFrame([], "id long, v string, version int"))
    assert empty.read().count() == 0
    empty.upsert(spark.createDataFrame([(1, "a", 1)], "id long, v string, version int"))
    empty.delete(spark.createDataFrame([(1,)], "id long"))
    empty.upsert(spark.createDataFrame([(1, "b", 1)], "id long, v string, version int"))
    assert rows_of(empty.read()) == [(1, "b", 1)]


def test_deleted_mails_leave_the_index(spark, tmp_path):
    parts = Parts(spark, str(tmp_path / "s"))
    more = {"archive_id": F.lit("a"), "thread_id": F.lit("t"), "sent_at": F.lit(None).cast("timestamp")}
    mails = {b: batch_mails(spark, b, 12).withColumns(more) for b in range(3)}
    for b in (0, 1):
        parts.add(b, index_tables(mails[b]))
    before = files(str(tmp_path / "s"))
    gone = mails[0].filter("id in (3, 4)")
    parts.delete("request-1", gone)
    parts.delete("request-1", gone)
    assert before <= files(str(tmp_path / "s"))  # nothing stored is written again
    left = K.Index.of(mails[0].filter("id not in (3, 4)").unionByName(mails[1]))

    def same(stored, whole):
        for text in ("rare0 budget", "topic 1", "user3@example.com"):
            assert scores(stored, text) == scores(whole, text)
        columns = ["field", "term", "df"]
        assert sorted(map(tuple, stored.vocab.select(columns).collect())) == sorted(map(tuple, whole.vocab.select(columns).collect()))
        assert sorted(map(str, stored.stats.collect())) == sorted(map(str, whole.stats.collect()))

    same(parts.index(), left)
    assert {r.id for r in parts.vectors().collect()} == {r.id for r in left.postings.select("id").collect()}
    # A deleted mail may come again; merging and folding change nothing.
    parts.add(2, index_tables(gone.unionByName(mails[2])))
    whole = K.Index.of(mails[0].unionByName(mails[1]).unionByName(mails[2]))
    same(parts.index(), whole)
    parts.merge(fan=2)
    same(parts.index(), whole)
    parts.delete("request-2", mails[1].unionByName(mails[0]))
    assert not parts.has_table("tombstones") and len(parts.manifest()["parts"]) == 1
    same(parts.index(), K.Index.of(mails[2]))
    assert os.path.isdir(tmp_path / "s")
