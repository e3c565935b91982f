"""Ingest queries.  Their archives and messages are composed by Spark from the test mails."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from mailweave.functions.headers import utc_wall_time
from mailweave.operators import keyword as K
from mailweave.operators.ledger import archive_ledger as ledger
from mailweave.plans.registry import query
from mailweave.session import scratch_path
from mailweave.sources import archives as S
from mailweave.sources.archive_ranges import scan_archive_files
from mailweave.sources.testmail import emails, mail_from, table
from mailweave.streaming import ingest

SUFFIXES = (".eml", ".TXT", ".mime", ".png")


def _suffix(number):
    return F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), (number % len(SUFFIXES) + 1).cast("int"))


def raw_message(date_time=None):
    """Message bytes of an adapter row; replies carry a second, marked-up body."""
    at = F.col("sent_at") if date_time is None else date_time
    line = lambda name, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(name + ": "), value, F.lit("\r\n")))
    plain = F.concat(F.lit("Content-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"), F.col("body_text"))
    both = F.concat(
        F.lit('Content-Type: multipart/alternative; boundary="=_part_="\r\n\r\n--=_part_=\r\n'), plain,
        F.lit("\r\n--=_part_=\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>markup</p>\r\n--=_part_=--\r\n"))
    head = F.concat_ws(
        "", line("From", F.concat(F.lit('"Mail, Writer" <'), F.upper("sender"), F.lit(">"))),
        line("To", F.replace("receivers_csv", F.lit(","), F.lit(", "))), line("Cc", F.col("cc_csv")),
        line("Subject", F.col("subject")),
        line("Message-ID", F.concat(F.lit("<"), F.col("message_id"), F.lit(">"))),
        line("In-Reply-To", F.concat(F.lit("<"), F.col("in_reply_to"), F.lit(">"))),
        line("References", F.col("references_header")),
        line("Date", F.concat(F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))))
    return F.encode(F.concat(head, F.lit("MIME-Version: 1.0\r\n"), F.when(F.col("in_reply_to").isNull(), plain).otherwise(both)), "utf-8")


def _mail(spark, sf):
    return mail_from(table(spark, sf, "documents"), table(spark, sf, "events"))


def _pack(batches):
    """One ZIP per archive and batch of rows."""
    for batch in batches:
        packed = []
        for archive, rows in batch.groupby("archive_id"):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as target:
                for name, raw in zip(rows["entry"], rows["raw"]):
                    target.writestr(name, bytes(raw))
            packed.append({"path": f"/mail/{archive}/{rows['entry'].min()}.zip", "content": buffer.getvalue()})
        yield pd.DataFrame(packed, columns=["path", "content"])


def packed_archives(spark, sf):
    """Archive files in the shape of the binaryFile source; some messages are compound documents."""
    raw = F.when(F.col("cc_csv") != "", F.concat(F.lit(S.COMPOUND_DOCUMENT), F.lit(b"rest"))).otherwise(raw_message())
    entries = _mail(spark, sf).select(
        "archive_id", F.concat(F.lit("box/"), F.col("email_id").cast("string"), _suffix(F.col("email_id"))).alias("entry"),
        raw.alias("raw"))
    return entries.mapInPandas(_pack, "path string, content binary").withColumn("length", F.length("content").cast("bigint"))


@query
def src_admission(spark, sf):
    """Uploads named after the documents: ZIP names within the size limit pass, the others are refused with the reason."""
    n = F.col("doc_id")
    uploads = table(spark, sf, "documents").select(
        F.concat("source", F.lit("/"), n.cast("string"), F.when(n % 3 == 0, ".zip").when(n % 3 == 1, ".ZIP").otherwise(".tar"))
         .alias("path"), (F.col("n_chars") * 100000).alias("length"))
    passed = uploads.filter(S.admitted()).select("path", F.lit(None).cast("string").alias("error"))
    return passed.unionByName(S.refused(uploads).withColumnRenamed("source", "path"))


def _store(folder):
    """Writes archives to files below ``folder``, one folder a source, from the tasks that have made them."""
    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                target = "/" + folder[5:].lstrip("/") if folder.startswith("file:") else folder
                system, root = fs.FileSystem.from_uri(target) if "://" in target else (fs.LocalFileSystem(), target)
                name = root + path
                system.create_dir(name.rpartition("/")[0], recursive=True)
                with system.open_output_stream(name) as out:
                    out.write(content)
            yield batch[["path"]]

    return run


def stored_archives(spark, sf):
    """The archives as files in a folder of the shared one."""
    folder = scratch_path(spark, "archives")
    packed_archives(spark, sf).select("path", "content").mapInPandas(_store(folder), "path string").write.format("noop").mode("overwrite").save()
    return folder


@query
def src_archive_scan(spark, sf):
    """Mail files of archives that lie in files, read by range."""
    scanned = scan_archive_files(S.archive_files(spark, stored_archives(spark, sf)))
    return scanned.select(
        F.element_at(F.split("archive_path", "/"), -3).alias("archive"), "entry_path",
        F.when(F.col("error").isNull(), "parsed").otherwise("rejected").alias("outcome"))


@query
def src_parse_mail(spark, sf):
    messages = _mail(spark, sf).select(F.col("email_id").alias("id"), raw_message().alias("raw"))
    return _comparable(S.accepted(S.parse_messages(messages)))


def _comparable(rows):
    return rows.select(
        "id", "message_id", "in_reply_to", "references_header", "sender", F.array_join("receivers", ",").alias("receivers"),
        F.array_join("cc", ",").alias("cc"), "subject", "body_text", utc_wall_time(F.col("sent_at")).alias("sent_at"))


@query
def archive_ledger(spark, sf):
    """One archive has a file that is damaged; its other files do not count against that."""
    packed = packed_archives(spark, sf)
    damaged = packed.groupBy(F.element_at(F.split("path", "/"), 3).alias("archive_id")).agg(F.max("path").alias("path")).filter(
        F.col("archive_id") == "src7").select("path", F.lit(b"no archive").alias("content"), F.lit(10).cast("bigint").alias("length"))
    scanned = S.scan_archives(packed.unionByName(damaged.withColumn("path", F.concat("path", F.lit(".zip"))))).select(
        F.element_at(F.split("archive_path", "/"), 3).alias("archive_id"), "entry_path", "error")
    files = emails(spark, sf).select("archive_id").distinct().withColumn("filename", F.concat("archive_id", F.lit(".zip")))
    return ledger(files, scanned)


def _streamed(spark, sf):
    """The documents, one file or a folder of files, read as a stream, composed to messages, and ingested; returns the store's folder."""
    schema = table(spark, sf, "documents").schema
    # A stream reads folders and patterns only; this pattern is met by the table's name, be it a file's or a folder's.
    arriving = spark.readStream.schema(schema).parquet(f"{sf}/documents.parque[t]")
    messages = mail_from(arriving, table(spark, sf, "events")).select(
        F.col("email_id").alias("id"), "archive_id",
        F.concat(F.col("email_id").cast("string"), F.lit(".eml")).alias("source_file"),
        F.current_timestamp().alias("created_at"), raw_message().alias("raw"))
    root = scratch_path(spark, "stream")
    ingest.start(messages, root, ingest.Messages()).awaitTermination()
    return root


@query
def stream_ingest(spark, sf):
    """What a stream of messages leaves in the store of mails."""
    return _comparable(ingest.read_table(spark, _streamed(spark, sf), "emails"))


@query
def stream_thread_stats(spark, sf):
    """The threads of the store after the stream."""
    rows = ingest.current_threads(spark, _streamed(spark, sf))
    return rows.select("thread_id", "subject_normalized", "participant_count", "email_count",
                       utc_wall_time(F.col("first_email_at")).alias("first_email_at"), utc_wall_time(F.col("last_email_at")).alias("last_email_at"))


@query
def stream_search(spark, sf):
    """A keyword search on the index that the stream has built."""
    from mailweave.plans.mail_search import DIGITS, QUERY

    stored = ingest.stored_index(spark, _streamed(spark, sf))
    terms = K.fixed(K.exact_terms(K.query_terms(K.one_query(spark, QUERY))))
    return K.best_scores(terms, K.pushed_down(terms, stored)).select("id", F.round("score", DIGITS).alias("score"))
