"""A stored table of one row an id that is changed at the cost of the change: buckets by id, change files, folding.

Rows lie in buckets by a hash of their id.  An upsert or delete writes its rows, or bare ids, as a change folder of the buckets that it touches
and nothing else.  A reader takes untouched buckets as they are; in touched ones the last change of an id counts in place of the
stored row.  Once the changes of a bucket pass a share of its rows the bucket is folded: written again with its changes, which then
no longer apply to it.  No other bucket is read or written for that.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.operators.manifest import Manifest, names_in

BUCKETS = 64
FOLD_SHARE = 0.25
CHANGE, GONE = "_change", "_gone"


class KeyedTable:
    """The table below ``root``, keyed by ``key``; ``version`` settles which of several rows of an id in one change is the last."""

    def __init__(self, spark: SparkSession, root: str, key: str = "id", version: str = "version", buckets: int = BUCKETS):
        self.spark, self.root, self.key, self.version, self.buckets = spark, root, key, version, buckets
        self.manifest = Manifest(spark, root)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write_buckets(self, rows: DataFrame, folder: str) -> dict[str, int]:
        """Rows below ``folder``, a folder a bucket; rows by bucket, of which there are no more than ``buckets``."""
        path = os.path.join(self.root, folder)
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        if not any(name.startswith("bucket=") for name in names_in(self.spark, path)):
            return {}  # nothing to write
        written = self.spark.read.parquet(path)
        return {str(r.bucket): r["count"] for r in written.groupBy("bucket").count().collect()}

    def create(self, rows: DataFrame) -> None:
        """The first rows, one an id."""
        now, folder = self.manifest.read(), f"rows-{uuid.uuid4().hex}"
        count = self._write_buckets(rows, folder)
        after = {"columns": rows.columns, "types": [rows.schema[c].dataType.simpleString() for c in rows.columns],
                 "rows": {b: {"folder": f"{folder}/bucket={b}", "count": n} for b, n in count.items()}, "changes": {}}
        self.manifest.commit(now, after, [])

    def upsert(self, rows: DataFrame) -> None:
        """Write rows over those of the same ids; of several rows of an id in one change the one of the highest version counts."""
        from mailweave.operators.maintenance import latest_by_id

        self._change(latest_by_id(rows, self.key, self.version).withColumn(GONE, F.lit(False)))

    def delete(self, ids: DataFrame) -> None:
        """Remove the rows of some ids."""
        self._change(ids.select(self.key).distinct().withColumn(GONE, F.lit(True)))

    def _change(self, rows: DataFrame) -> None:
        now = self.manifest.read()
        number = now["version"] + 1
        folder = f"change-{number}-{uuid.uuid4().hex}"
        kinds = dict(zip(now["columns"], now["types"], strict=True))
        whole = rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(kinds[c]).alias(c) for c in now["columns"]), GONE,
                            F.lit(number).cast("long").alias(CHANGE))
        count = self._write_buckets(whole, folder)
        changes = {b: list(c) for b, c in now["changes"].items()}
        for b, n in count.items():
            changes.setdefault(b, []).append({"folder": f"{folder}/bucket={b}", "count": n})
        self.manifest.commit(now, {**now, "changes": changes}, [])
        self.fold()

    def _parquet(self, folders: list[str], now: dict, *more: str) -> DataFrame:
        schema = ", ".join(f"`{c}` {t}" for c, t in zip(now["columns"], now["types"], strict=True))
        schema = ", ".join([schema, *more])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(os.path.join(self.root, f) for f in folders))

    def _merged(self, now: dict, buckets: list[str]) -> DataFrame:
        """The rows of touched buckets with their changes."""
        stored = self._parquet([now["rows"][b]["folder"] for b in buckets if b in now["rows"]], now)
        changes = self._parquet([c["folder"] for b in buckets for c in now["changes"].get(b, [])], now, f"{GONE} boolean", f"{CHANGE} long")
        others = [c for c in changes.columns if c != self.key]
        last = changes.groupBy(self.key).agg(F.max_by(F.struct(*others), F.col(CHANGE)).alias("_r")).select(self.key, "_r.*")
        kept = stored.join(last.select(self.key), self.key, "left_anti")
        return kept.select(*now["columns"]).unionByName(last.filter(~F.col(GONE)).select(*now["columns"]))

    def read(self) -> DataFrame:
        """The rows as all changes leave them."""
        now = self.manifest.read()
        touched = sorted(b for b, c in now["changes"].items() if c)
        rest = self._parquet([r["folder"] for b, r in now["rows"].items() if b not in touched], now).select(*now["columns"])
        return rest.unionByName(self._merged(now, touched)) if touched else rest

    def fold(self, share: float = FOLD_SHARE) -> list[str]:
        """Write the buckets again whose changes pass a share of their rows; their numbers."""
        now = self.manifest.read()
        full = [b for b, c in now["changes"].items() if sum(x["count"] for x in c) > share * now["rows"].get(b, {"count": 0})["count"]]
        if not full:
            return []
        folder = f"rows-{uuid.uuid4().hex}"
        count = self._write_buckets(self._merged(now, full), folder)
        rows = {b: r for b, r in now["rows"].items() if b not in full} | {b: {"folder": f"{folder}/bucket={b}", "count": n} for b, n in count.items()}
        retired = [r["folder"] for b, r in now["rows"].items() if b in full] + [c["folder"] for b in full for c in now["changes"][b]]
        self.manifest.commit(now, {**now, "rows": rows, "changes": {b: c for b, c in now["changes"].items() if b not in full}}, retired)
        return sorted(full)
