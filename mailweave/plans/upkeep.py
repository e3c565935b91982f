"""Upserts, deletes, audits and rebuilds."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailweave.operators import maintenance as M
from mailweave.operators.keyed_table import KeyedTable
from mailweave.plans import tables
from mailweave.plans.registry import query
from mailweave.schema import contract_problems, overlong_values
from mailweave.session import scratch_path
from mailweave.sources.tables import append_emails, read_emails
from mailweave.sources.testmail import emails, mail, threaded_emails
from mailweave.streaming.ingest import index_tables
from mailweave.streaming.parts import Parts

DELETED_ARCHIVE = "src1"


@query
def sink_emails_roundtrip(spark, sf):
    rows = threaded_emails(spark, sf)
    path = scratch_path(spark, "emails")
    append_emails(rows, path)
    back = read_emails(spark, path, like=rows)
    return back.select("id", "archive_id", "thread_id", "sender", F.array_join("receivers", ",").alias("receivers"),
                       "subject", "body_text", "sent_at", "summary")


def _versions(spark, sf):
    """A stored state and a batch of changes: edited replies, some twice, and new rows."""
    rows = mail(spark, sf).select(F.col("email_id").alias("id"), "message_id", "in_reply_to", "references_header", "subject")
    slim = lambda frame, version: frame.select("id", "subject", F.lit(version).alias("version"))
    base = slim(rows, 0)
    first = slim(rows.filter(F.col("in_reply_to").isNotNull()).withColumn("subject", F.concat(F.lit("edited "), "subject")), 1)
    second = slim(rows.filter(F.col("references_header").isNotNull()).withColumn("subject", F.upper("subject")), 2)
    new = slim(rows.filter(F.col("message_id").isNull()).withColumn("id", -F.col("id")), 1)
    unversioned = slim(rows.filter(F.col("in_reply_to").isNotNull()).withColumn("subject", F.lit("lost")), None)
    return base, first.unionByName(second).unionByName(new).unionByName(
        unversioned.withColumn("version", F.col("version").cast("int")))


@query
def upsert_by_id(spark, sf):
    """A stored table after a batch of changes, which touches its own buckets only."""
    base, delta = _versions(spark, sf)
    stored = KeyedTable(spark, scratch_path(spark, "keyed"))
    stored.create(base)
    stored.upsert(delta)
    return stored.read()


@query
def insert_if_absent(spark, sf):
    """New rows come twice; ids that are stored already keep their row."""
    base, delta = _versions(spark, sf)
    fresh = M.latest_by_id(delta, "id", "version")
    return M.insert_if_absent(base, fresh.unionByName(fresh))


@query
def delete_by_archive(spark, sf):
    """Row counts in the stores after one archive is deleted from them: its ids and negative counts are written, nothing else."""
    rows = threaded_emails(spark, sf)
    mails, parts = KeyedTable(spark, scratch_path(spark, "keyed")), Parts(spark, scratch_path(spark, "stores"))
    slim = rows.select("id", "archive_id")
    mails.create(slim)
    parts.add(0, index_tables(rows))
    gone = rows.filter(F.col("archive_id") == DELETED_ARCHIVE)
    parts.delete(DELETED_ARCHIVE, gone)
    mails.delete(gone.select("id"))
    index = parts.index()
    left = {"emails": mails.read(), "postings": index.postings, "vocabulary": index.vocab, "vectors": parts.vectors()}
    out = None
    for name, store in left.items():
        row = store.agg(F.count("*").alias("remaining")).select(F.lit(name).alias("store"), "remaining")
        out = row if out is None else out.unionByName(row)
    return out


@query
def delete_thread_setnull(spark, sf):
    """Threads without replies are deleted; their mails stay."""
    rows = threaded_emails(spark, sf).select("id", "archive_id", "thread_id", "in_reply_to")
    deleted = rows.groupBy("thread_id").agg(F.count("in_reply_to").alias("replies")).filter("replies = 0")
    return M.clear_thread(rows, deleted).select("id", "thread_id")


@query
def reindex_counts(spark, sf):
    """Mails found in the keyword and the vector store after both are built anew."""
    folder = scratch_path(spark, "stores")
    M.rebuild(threaded_emails(spark, sf), folder)
    keyword = spark.read.parquet(f"{folder}/keyword/postings").agg(F.count_distinct("id").alias("indexed"))
    vectors = spark.read.parquet(f"{folder}/vectors").agg(F.count_distinct("id").alias("indexed"))
    return keyword.select(F.lit("keyword").alias("store"), "indexed").unionByName(
        vectors.select(F.lit("vectors").alias("store"), "indexed"))


@query
def index_audit(spark, sf):
    """Mails with a message id are in the index, together with leftovers of deleted ones."""
    rows = emails(spark, sf).select("id", "message_id", "in_reply_to")
    kept = rows.filter(F.col("message_id").isNotNull()).select("id")
    orphans = rows.filter(F.col("in_reply_to").isNull()).select((-F.col("id")).alias("id"))
    return M.index_audit(rows, kept.unionByName(orphans))


@query
def schema_contract(spark, sf):
    """The derived tables against the declared contract, and the mails that exceed given column lengths."""
    rows = threaded_emails(spark, sf)
    schema = contract_problems(spark, {"emails": rows, "email_threads": tables.threads(spark, sf)})
    long = overlong_values(rows, {"subject": 10, "sender": 17}).groupBy("column").agg(F.count("*").alias("rows"))
    return schema.withColumn("rows", F.lit(None).cast("bigint")).unionByName(long.select(
        F.lit("emails").alias("table"), "column", F.lit("value too long").alias("problem"), "rows"))
