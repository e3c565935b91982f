"""Index parts of a growing store: sorted tables of some batches each, merged by size, and a manifest that says which of them count.

A batch leaves one small part.  Whenever ``FAN`` parts are of one size class they are merged into one of the next class, so after n batches a
store has no more than ``FAN - 1`` parts a class, and each row has been written again once a class.  Manifests are numbered files that appear
whole, by renaming; readers take the last one.  A part that a merge has replaced stays until the next change, for readers that have
begun.  A batch that is repeated after a failure finds its part in the manifest, or writes it over; folders that no manifest names are
left over from a failure and are removed by the next merge.

Deleted mails leave a part too: their ids as tombstones, which hide what earlier parts hold of them, and their counts with a minus sign,
so that frequencies and lengths stay exact without reading any other part.  A merge leaves hidden rows out; once a share of all
postings is hidden the whole store is merged into one part without tombstones.

There is one writer, the stream's driver.
"""

from __future__ import annotations

import math
import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.operators import dashboard_state
from mailweave.operators import keyword as K
from mailweave.operators.maintenance import latest_by_id
from mailweave.operators.manifest import Manifest, names_in
from mailweave.session import discard, materialise

TABLES = ("threads", "postings", "vocab", "field_stats", "grams", "vectors", "dashboard", "tombstones")
DATED = ("postings", "vectors")  # tables whose rows carry when they came, which tombstones are compared with
FAN = 4
DEAD_SHARE = 0.25  # of the postings, from which on a store is folded


def size_class(rows: int, fan: int = FAN) -> int:
    """The class of a part: one higher for every ``fan`` times as many rows."""
    return int(math.log(max(rows, 1), fan) + 1e-9)


class Parts:
    """The parts below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, os.path.join(root, "index")
        self.manifests = Manifest(spark, self.root)

    def _folder(self, name: str) -> str:
        return os.path.join(self.root, "parts", name)

    def manifest(self) -> dict:
        """``parts``: name -> batches and rows; ``retired``: folders of parts that no longer count but may still be read."""
        return {"parts": {}} | self.manifests.read()

    def _commit(self, now: dict, parts: dict, retired: list[str]) -> None:
        self.manifests.commit(now, {"parts": parts}, [f"parts/{name}" for name in retired])

    def has(self, batch: int) -> bool:
        """Whether the part of a batch counts already, alone or merged."""
        return any(batch in p["batches"] for p in self.manifest()["parts"].values())

    def add(self, batch: int, tables: dict[str, DataFrame]) -> None:
        """Write the part of one batch and let it count."""
        name, now = f"batch-{batch}", self.manifest()
        for table, rows in tables.items():
            self._write(rows.withColumn("since", F.lit(now["version"]).cast("long")) if table in DATED else rows, name, table)
        largest = "postings" if "postings" in tables else next(iter(tables))
        count = self.spark.read.parquet(os.path.join(self._folder(name), largest)).count()
        self._commit(now, now["parts"] | {name: {"batches": [batch], "deletes": [], "rows": count, "dead": 0}}, [])

    def delete(self, token: str, mails: DataFrame) -> None:
        """Take stored mails, given as they were indexed, out of the indexes.  ``token`` names the request: a second one of that name does nothing."""
        now = self.manifest()
        if any(token in p["deletes"] for p in now["parts"].values()):
            return
        name, rows = f"delete-{now['version']}", materialise(K.posting_rows(mails), "deleted-postings")
        vocab = K.vocabulary(rows).select("field", "term", F.length("term").alias("length"), (-F.col("df")).alias("df"),
                                          F.lit(None).cast("long").alias("max_tf"), F.lit(None).cast("long").alias("min_dl"))
        tables = {"tombstones": mails.select("id").distinct().withColumn("until", F.lit(now["version"]).cast("long")), "vocab": vocab,
                  "field_stats": K.stat_parts(rows).select("field", (-F.col("n")).alias("n"), (-F.col("words")).alias("words"))}
        if self.has_table("dashboard"):
            tables["dashboard"] = dashboard_state.taken_away(dashboard_state.state_of(mails))
        for table, found in tables.items():
            self._write(found, name, table)
        dead = rows.count()
        discard(self.spark, rows.inputFiles()[0].rsplit("/", 1)[0])
        self._commit(now, now["parts"] | {name: {"batches": [], "deletes": [token], "rows": dead, "dead": dead}}, [])
        self.fold()

    def _write(self, rows: DataFrame, name: str, table: str) -> None:
        writer = rows.write.mode("overwrite")
        (writer.partitionBy("term_bucket") if table == "postings" else writer).parquet(os.path.join(self._folder(name), table))

    def folders(self, table: str, parts: list[str] | None = None) -> list[str]:
        """The folders of a table that count; batches stored without an index have none of its tables."""
        found = [os.path.join(self._folder(n), table) for n in (parts or sorted(self.manifest()["parts"]))]
        return [f for f in found if names_in(self.spark, f)]

    def has_table(self, table: str, parts: list[str] | None = None) -> bool:
        return bool(self.folders(table, parts))

    def read(self, table: str, parts: list[str] | None = None) -> DataFrame:
        """One table of all parts, or of some; there are few of them."""
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f) for f in self.folders(table, parts)])

    def alive(self, table: str, parts: list[str] | None = None) -> DataFrame:
        """One of the ``DATED`` tables without what later tombstones of any part hide."""
        rows = self.read(table, parts)
        if not self.has_table("tombstones"):
            return rows
        gone = self.read("tombstones").groupBy("id").agg(F.max("until").alias("until"))
        return rows.join(gone, "id", "left").filter(F.col("until").isNull() | (F.col("since") >= F.col("until"))).select(*rows.columns)

    def merged(self, table: str, parts: list[str]) -> DataFrame:
        """One table of several parts, in the order in which it is stored."""
        rows = self.alive(table, parts) if table in DATED else self.read(table, parts)
        if table == "postings":
            order = ("term_bucket", "field", "term", "id")
            return rows.repartitionByRange(*order).sortWithinPartitions(*order)
        if table == "vocab":
            order = ("length", "field", "term")
            return added_up(rows).filter("df <> 0").repartitionByRange(*order).sortWithinPartitions(*order)
        if table == "field_stats":
            return rows.groupBy("field").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).coalesce(1)
        if table == "grams":
            return rows.distinct().repartitionByRange("gram", "term").sortWithinPartitions("gram", "term")
        if table == "threads":
            return latest_by_id(rows, "thread_id", "batch")
        if table == "dashboard":
            return dashboard_state.merged(rows)
        if table == "tombstones":
            return rows.groupBy("id").agg(F.max("until").alias("until"))
        return rows.repartition("id")

    def merge(self, fan: int = FAN) -> int:
        """Merge until no size class has ``fan`` parts; the number of merges."""
        done = 0
        while True:
            classes: dict[int, list[str]] = {}
            for name, part in sorted(self.manifest()["parts"].items(), key=lambda p: p[1]["batches"][:1]):
                classes.setdefault(size_class(part["rows"], fan), []).append(name)
            full = next((names for _, names in sorted(classes.items()) if len(names) >= fan), None)
            if full is None:
                return done
            self._merge(full)
            done += 1

    def fold(self, share: float = DEAD_SHARE) -> bool:
        """Merge all parts into one without tombstones, if more than a share of the postings is hidden."""
        parts = self.manifest()["parts"]
        dead = sum(p["dead"] for p in parts.values())
        if dead <= share * sum(p["rows"] for p in parts.values() if not p["dead"]):
            return False
        self._merge(sorted(parts))
        return True

    def _merge(self, names: list[str]) -> None:
        now = self.manifest()
        live = {f"parts/{name}" for name in now["parts"]} | set(now["retired"])
        for folder in {f"parts/{name}" for name in names_in(self.spark, os.path.join(self.root, "parts"))} - live:
            self.manifests.remove(folder)
        name, whole = f"merged-{uuid.uuid4().hex}", len(names) == len(now["parts"])
        tables = [t for t in TABLES if self.has_table(t, names) and not (whole and t == "tombstones")]
        for table in tables:
            self._write(self.merged(table, names), name, table)
        merged = [now["parts"][n] for n in names]
        part = {"batches": sorted(b for p in merged for b in p["batches"]), "deletes": sorted(t for p in merged for t in p["deletes"]), "rows": sum(p["rows"] for p in merged if not p["dead"]) or 1,
                "dead": 0 if whole else sum(p["dead"] for p in merged)}
        if whole and "postings" in tables:
            part["rows"] = self.spark.read.parquet(os.path.join(self._folder(name), "postings")).count()
        self._commit(now, {n: p for n, p in now["parts"].items() if n not in names} | {name: part}, names)

    def index(self) -> K.Index:
        """The keyword index of all parts.  Filters on field, term and length reach the parts before their counts are added up."""
        return K.Index(self.alive("postings").drop("head", "since"), added_up(self.read("vocab")).filter("df > 0"), K.stats_from(self.read("field_stats")), self.read("grams").distinct())

    def threads(self) -> DataFrame:
        """The newest statistics of every thread."""
        return latest_by_id(self.read("threads"), "thread_id", "batch").drop("batch")

    def dashboard(self) -> DataFrame:
        """The state that the dashboard is read from."""
        return dashboard_state.added(self.read("dashboard"))

    def vectors(self) -> DataFrame:
        return self.alive("vectors").drop("since")


def added_up(vocab: DataFrame) -> DataFrame:
    return vocab.groupBy("field", "term", "length").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"))
