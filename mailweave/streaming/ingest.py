"""Archives or messages that keep arriving: parse, append, refresh touched threads, extend both indexes, close the ledger.

Each micro-batch is decoded once, into a folder that goes when the batch is stored.  It writes below ``batch=<epoch>`` folders and
replaces them when it is run again, so a restart after a lost executor or driver leaves no doubles.  Nothing is held in streaming
state: mails lie in folders by a hash of their thread, and the statistics and summary of a touched thread are recomputed from the
folders of the touched threads alone.  Threads and both indexes are kept as parts that add up and are merged as they grow in number
(:mod:`mailweave.streaming.parts`).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mailweave.functions.text import extractive_summary
from mailweave.operators import keyword as K
from mailweave.operators.address_search import grams_of
from mailweave.operators.dashboard_state import state_of
from mailweave.operators.ledger import archive_ledger
from mailweave.operators.threads import refreshed, with_subject_thread
from mailweave.operators.vectors import vector_index
from mailweave.schema import length_problem
from mailweave.session import discard, materialise
from mailweave.sources.archive_ranges import scan_archive_files
from mailweave.sources.archives import (
    MAX_ARCHIVE_BYTES, accepted, admitted, archive_id, emails_from_scan, parse_messages, refused, rejected,
)
from mailweave.streaming.parts import DATED, FAN, TABLES, Parts

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"
THREAD_BUCKETS = 64


def archive_stream(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """Files as they appear below ``folder``; which of them are admitted is up to :class:`Archives`."""
    return (
        spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", per_trigger).load(folder)
    )


class Archives:
    """Batches of archive files."""

    def __init__(self, max_bytes: int = MAX_ARCHIVE_BYTES):
        self.max_bytes = max_bytes

    def decode(self, batch: DataFrame) -> DataFrame:
        return scan_archive_files(batch.filter(admitted(self.max_bytes)).select("path", "length"))

    def mails(self, decoded: DataFrame) -> DataFrame:
        return emails_from_scan(decoded)

    def rejects(self, batch: DataFrame, decoded: DataFrame) -> DataFrame:
        inside = rejected(decoded).select(F.concat_ws("/", "archive_path", "entry_path").alias("source"), "error")
        return inside.unionByName(refused(batch, self.max_bytes))

    def ledger(self, batch: DataFrame, decoded: DataFrame) -> DataFrame:
        files = batch.filter(admitted(self.max_bytes)).select(
            archive_id(F.col("path")).alias("archive_id"), F.element_at(F.split("path", "/"), -1).alias("filename"))
        return archive_ledger(files, decoded.withColumn("archive_id", archive_id()))


class Messages:
    """Batches of single messages ``(id, archive_id, source_file, created_at, raw)``."""

    def decode(self, batch: DataFrame) -> DataFrame:
        return parse_messages(batch, keep=("id", "archive_id", "source_file", "created_at"))

    def mails(self, decoded: DataFrame) -> DataFrame:
        return accepted(decoded).withColumn("summary", extractive_summary(F.col("subject"), F.col("body_text")))

    def rejects(self, batch: DataFrame, decoded: DataFrame) -> DataFrame:
        return rejected(decoded).select(F.col("source_file").alias("source"), "error")

    def ledger(self, batch: DataFrame, decoded: DataFrame) -> DataFrame:
        files = decoded.select("archive_id").distinct().withColumn("filename", F.col("archive_id"))
        return archive_ledger(files, decoded.withColumnRenamed("source_file", "entry_path"))


def thread_bucket(thread_id: Column) -> Column:
    return F.pmod(F.xxhash64(thread_id), F.lit(THREAD_BUCKETS)).cast("int")


def touched_mails(spark: SparkSession, root: str, epoch: int, buckets: list[int]) -> DataFrame:
    """Stored mails of the given buckets, up to a batch: later folders can only be left over from a run that is now repeated."""
    return read_table(spark, root, "emails").filter((F.col("batch") <= epoch) & F.col("bucket").isin(buckets))


def index_tables(fresh: DataFrame) -> dict[str, DataFrame]:
    """The index tables of one batch of mails; its postings are analysed once and written first."""
    rows = materialise(K.posting_rows(fresh), "postings").withColumn("term_bucket", K.term_bucket(F.col("term")))
    order = ("term_bucket", "field", "term", "id")
    vocab = materialise(K.vocabulary(rows).withColumn("length", F.length("term")), "vocab")
    return {"postings": rows.repartitionByRange(*order).sortWithinPartitions(*order), "vocab": vocab, "field_stats": K.stat_parts(rows),
            "grams": grams_of(vocab.filter(F.col("field") == K.EXACT_FIELD)), "vectors": vector_index(fresh)}


def process_batch(root: str, source, index: bool = True, fan: int = FAN):
    """The ``foreachBatch`` function that stores one micro-batch below ``root``."""
    def folder(name: str, epoch: int) -> str:
        return os.path.join(root, name, f"batch={epoch}")

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession

        def store(rows: DataFrame, name: str, *parts: str) -> DataFrame:
            rows.write.mode("overwrite").partitionBy(*parts).parquet(folder(name, epoch))
            return spark.read.schema(rows.schema).parquet(folder(name, epoch))

        decoded = store(source.decode(batch), "decoded")
        mails = with_subject_thread(source.mails(decoded)).withColumn("_problem", length_problem(decoded.columns))
        store(source.rejects(batch, decoded).unionByName(
            mails.filter(F.col("_problem").isNotNull()).select(F.col("source_file").alias("source"), F.col("_problem").alias("error"))), "rejects")
        fresh = store(mails.filter(F.col("_problem").isNull()).drop("_problem").withColumn("bucket", thread_bucket(F.col("thread_id"))),
                      "emails", "bucket")
        parts = Parts(spark, root)
        if not parts.has(epoch):
            # At most THREAD_BUCKETS numbers.
            buckets = [r.bucket for r in fresh.select("bucket").distinct().collect()]
            threads = refreshed(touched_mails(spark, root, epoch, buckets), fresh.select("thread_id")).withColumn("batch", F.lit(epoch).cast("long"))
            parts.add(epoch, {"threads": threads, "dashboard": state_of(fresh)} | (index_tables(fresh) if index else {}))
            parts.merge(fan)
        store(source.ledger(batch, decoded), "archives")
        discard(spark, folder("decoded", epoch))

    return run


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    if name in DATED:
        return Parts(spark, root).alive(name).drop("since")
    return Parts(spark, root).read(name) if name in TABLES else spark.read.parquet(os.path.join(root, name))


def stored_index(spark: SparkSession, root: str) -> K.Index:
    """The keyword index of all batches."""
    return Parts(spark, root).index()


def current_threads(spark: SparkSession, root: str) -> DataFrame:
    """The newest statistics of every thread."""
    return Parts(spark, root).threads()


def start(source: DataFrame, root: str, kind=None, index: bool = True, available_now: bool = True) -> StreamingQuery:
    """Start ingest into ``root``, of archives unless told otherwise; by default it stops once all present input is stored."""
    writer = source.writeStream.foreachBatch(process_batch(root, kind or Archives(), index)).option(
        "checkpointLocation", os.path.join(root, "checkpoint"))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
