"""Header threads of a corpus that grows: a late parent or reference moves the mails that wait for it, and no others.

A mail belongs to the first of its references, else to the mail it answers, that is in the corpus.  Three tables say where things stand: the
message ids that are known; for every mail its thread and the place of the reference that gave it; and for every mail the references
before that place, which it waits for.  A batch looks up its own references among the known ids, and its new ids among what others
wait for.  Whatever the order of batches, the threads are those of one batch with all mails.

Known and awaited ids lie in folders by batch and by a hash of the id, of which a batch reads those of its own ids.  Entries that a
mail no longer waits for are told by the place that its row has now.  A batch that is repeated replaces its folders.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.functions.headers import normalized_subject, reference_ids
from mailweave.operators.keyed_table import KeyedTable
from mailweave.operators.manifest import names_in
from mailweave.operators.skew import lookup_join
from mailweave.session import materialise

ID_BUCKETS = 64
LAST = (1 << 31) - 1  # the place of a mail that no reference has placed


class GrowingThreads:
    """The threads below ``root``; ``buckets`` in number by the size of the corpus."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = ID_BUCKETS):
        self.spark, self.root, self.buckets = spark, root, buckets
        self.placed = KeyedTable(spark, os.path.join(root, "placed"), version="batch", buckets=buckets)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("message_id"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _write(self, rows: DataFrame, table: str, batch: int) -> None:
        rows.select("*", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(os.path.join(self.root, table, f"batch={batch}"))

    def _earlier(self, table: str, schema: str, batch: int, buckets: list[int]) -> DataFrame:
        """Rows of other batches, from the folders of some ids."""
        path = os.path.join(self.root, table)
        if not set(names_in(self.spark, path)) - {f"batch={batch}"}:
            return self.spark.createDataFrame([], schema)
        stored = self.spark.read.schema(f"{schema}, batch int, bucket int").parquet(path)
        return stored.filter((F.col("batch") != batch) & F.col("bucket").isin(buckets)).drop("batch", "bucket")

    def add(self, batch: int, mails: DataFrame) -> DataFrame:
        """Take in a batch of mails; ``(thread_key)`` of all threads that have won or lost mails, whose figures are to be refreshed."""
        id_type = mails.schema["id"].dataType.simpleString()
        by_subject = F.when(F.col("subject") != "", F.concat(F.lit("subject:"), normalized_subject(F.col("subject"))))
        own = F.when(F.col("message_id") != "", F.concat(F.lit("msg:"), F.col("message_id")))
        parent = F.when(F.coalesce("in_reply_to", F.lit("")) != "", F.array("in_reply_to")).otherwise(F.array().cast("array<string>"))
        slim = materialise(mails.select("id", "message_id", F.coalesce(own, by_subject).alias("fallback"),
                                        F.concat(reference_ids(F.col("references_header")), parent).alias("refs")), "thread-mails")
        links = slim.select("id", F.posexplode("refs").alias("pos", "message_id"))
        mine = slim.filter(F.coalesce("message_id", F.lit("")) != "").select("message_id").distinct()
        # No more than ``buckets`` numbers each.
        asked = [r.bucket for r in links.select(self._bucket()).distinct().collect()]
        brought = [r.bucket for r in mine.select(self._bucket()).distinct().collect()]
        known = self._earlier("known", "message_id string", batch, sorted({*asked, *brought}))
        fresh = materialise(mine.join(known, "message_id", "left_anti"), "fresh-ids")

        # The batch's own mails: the first of their references that is known now.
        all_known = known.unionByName(fresh).distinct().withColumn("_known", F.lit(True))
        found = lookup_join(links, all_known, "message_id", "id")
        first = found.filter("_known").groupBy("id").agg(F.min("pos").alias("place"), F.min_by("message_id", "pos").alias("root"))
        placed = slim.select("id", "fallback").join(first, "id", "left").select(
            "id", F.coalesce(F.concat(F.lit("msg:"), F.col("root")), "fallback").alias("thread_key"), F.coalesce("place", F.lit(LAST)).alias("place"))
        placed = materialise(placed, "placed")
        waits = links.join(placed.select("id", "place"), "id").filter("pos < place").select("message_id", "id", "pos")

        # Mails of earlier batches that have waited for one of the new ids.
        awaited = self._earlier("waiting", f"message_id string, id {id_type}, pos int", batch, brought).join(fresh, "message_id")
        earliest = awaited.groupBy("id").agg(F.min("pos").alias("pos"), F.min_by("message_id", "pos").alias("root"))
        stored = self.placed.read() if self.placed.manifest.read()["version"] else None
        touched = placed.select("thread_key")
        if stored is not None:
            moved = materialise(earliest.join(stored, "id").filter("pos < place").select(
                "id", F.concat(F.lit("msg:"), F.col("root")).alias("thread_key"), F.col("pos").alias("place"), F.col("thread_key").alias("before")), "moved")
            touched = touched.unionByName(moved.select("thread_key")).unionByName(moved.select(F.col("before").alias("thread_key")))
            changed = placed.unionByName(moved.select("id", "thread_key", "place"))
        else:
            changed = placed
        out = materialise(touched.filter("thread_key is not null").distinct(), "touched-threads")
        self._write(waits, "waiting", batch)
        self._write(fresh, "known", batch)
        changed = changed.withColumn("batch", F.lit(batch).cast("long"))
        if stored is None:
            self.placed.create(changed)
        else:
            self.placed.upsert(changed)
        return out

    def keys(self) -> DataFrame:
        """``(id, thread_key)`` of every mail."""
        return self.placed.read().select("id", "thread_key")

    def threads(self) -> DataFrame:
        return self.keys().filter(F.col("thread_key").isNotNull()).groupBy("thread_key").agg(F.count("*").alias("email_count"))
