"""Lookups, filters, projections, pages and enrichment joins of the read views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailweave.functions.text import SHORT_TEXT_CHARS
from mailweave.operators.skew import HOT_ROWS, lookup_join
from mailweave.schema import EMAIL_DETAIL, LIST_ITEM

MAX_PAGE = 100


def by_id(rows: DataFrame, value, column: str = "id") -> DataFrame:
    return rows.filter(F.col(column) == F.lit(value))


def by_ids_in_order(rows: DataFrame, ids: list, column: str = "id") -> DataFrame:
    """Rows of the requested ids in request order; unknown ids yield nothing.

    The list is joined as a table; Spark picks the strategy by its size.
    """
    kind = rows.schema[column].dataType.simpleString()
    request = rows.sparkSession.createDataFrame(list(enumerate(dict.fromkeys(ids))), f"pos bigint, `{column}` {kind}")
    return rows.join(request, column).orderBy("pos")


def first_by_value(rows: DataFrame, column: str, value, order: str = "id") -> DataFrame:
    """The row with ``column`` equal to ``value``; of several the one with the smallest id."""
    return rows.filter(F.col(column) == F.lit(value)).orderBy(order).limit(1)


def sender_condition(text: str, escape: bool = True) -> Column:
    """Case-insensitive substring test on the sender; with ``escape=False`` ``%`` and ``_`` act as wildcards."""
    if escape:
        return F.contains(F.lower("sender"), F.lit(text.lower()))
    return F.col("sender").ilike(f"%{text}%")


def filtered(emails: DataFrame, sender: str | None = None, thread_id=None, escape: bool = True) -> DataFrame:
    """All given conditions hold; absent ones do not restrict."""
    out = emails
    if sender:
        out = out.filter(sender_condition(sender, escape))
    if thread_id is not None:
        out = out.filter(F.col("thread_id") == F.lit(thread_id))
    return out


def in_date_range(date_from=None, date_to=None) -> Column:
    """Inclusive at both ends; an undated mail never matches a given end."""
    inside = F.lit(True)
    if date_from is not None:
        inside = inside & (F.col("sent_at") >= F.lit(date_from))
    if date_to is not None:
        inside = inside & (F.col("sent_at") <= F.lit(date_to))
    return inside


def list_items(emails: DataFrame) -> DataFrame:
    return emails.select(*LIST_ITEM)


def details(emails: DataFrame) -> DataFrame:
    return emails.select(*EMAIL_DETAIL)


def iso_time(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")


def index_documents(emails: DataFrame) -> DataFrame:
    """The twelve fields of a keyword-index document."""
    return emails.select(
        F.col("id").alias("email_id"), "archive_id", "thread_id", "sender", "receivers", "cc", "subject", "body_text",
        "summary", iso_time(F.col("sent_at")).alias("sent_at"), iso_time(F.col("created_at")).alias("created_at"),
        "source_file",
    )


def metadata_columns() -> list[Column]:
    """What a stored vector says about its mail."""
    return [
        F.col("id").alias("email_id"), F.col("archive_id"),
        F.coalesce(F.col("thread_id"), F.lit("")).alias("thread_id"), F.col("sender"),
        F.substring("subject", 1, 500).alias("subject"),
        F.coalesce(iso_time(F.col("sent_at")), F.lit("")).alias("sent_at"),
    ]


def vector_metadata(emails: DataFrame) -> DataFrame:
    return emails.select(*metadata_columns())


def _page(rows: DataFrame, order: list[Column], page: int, page_size: int) -> DataFrame:
    if page < 1 or not 1 <= page_size <= MAX_PAGE:
        raise ValueError(f"pages start at 1 and hold 1 to {MAX_PAGE} rows")
    return rows.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def email_page(emails: DataFrame, page: int = 1, page_size: int = 20) -> DataFrame:
    order = [F.desc_nulls_last("sent_at"), F.desc("created_at"), F.asc("id")]
    return _page(emails, order, page, page_size)


def email_page_after(emails: DataFrame, sent_at, created_at, last_id, page_size: int = 20) -> DataFrame:
    """The page after the mail with these values, in the order of ``email_page``.

    Unlike an offset it keeps one page of rows in each task, however far into the list it lies.
    """
    later = (F.col("created_at") < F.lit(created_at)) | ((F.col("created_at") == F.lit(created_at)) & (F.col("id") > F.lit(last_id)))
    if sent_at is None:
        beyond = F.col("sent_at").isNull() & later
    else:
        beyond = F.col("sent_at").isNull() | (F.col("sent_at") < F.lit(sent_at)) | ((F.col("sent_at") == F.lit(sent_at)) & later)
    return email_page(emails.filter(beyond), 1, page_size)


def thread_page(threads: DataFrame, page: int = 1, page_size: int = 20) -> DataFrame:
    return _page(threads, [F.desc_nulls_last("last_email_at"), F.asc("id")], page, page_size)


def archive_page(archives: DataFrame, page: int = 1, page_size: int = 50) -> DataFrame:
    return _page(archives, [F.desc("created_at"), F.asc("id")], page, page_size)


def page_totals(rows: DataFrame, page_size: int) -> DataFrame:
    return rows.agg(F.count("*").alias("total")).select(
        "total", F.lit(page_size).cast("bigint").alias("page_size"),
        F.ceil(F.col("total") / page_size).cast("bigint").alias("total_pages"))


def with_thread(emails: DataFrame, threads: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each mail with its thread's subject; mails without a thread are kept."""
    subjects = threads.select(F.col("id").alias("thread_id"), F.col("subject_normalized").alias("thread_subject"))
    return lookup_join(emails, subjects, "thread_id", "id", hot_rows=hot_rows)


def threads_with_emails(
    threads: DataFrame, emails: DataFrame, single_order: bool = False, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Thread rows with their mails, one row per mail, sorted by thread and then in mail order.

    Flat instead of nested: a thread may hold a large part of all mails, which no single row can.  The sort is by
    range over thread and mail keys together, so one thread spreads over many tasks.  List order puts undated mails
    first, then by date and creation; with ``single_order`` an undated mail stands at its creation time.
    """
    items = emails.select(
        "thread_id", F.col("id").alias("email_id"), "sender", "subject", "sent_at",
        F.col("summary").alias("email_summary"), "created_at")
    heads = threads.select(
        F.col("id").alias("thread_id"), "subject_normalized", "participant_count", "email_count", "first_email_at",
        "last_email_at")
    rows = lookup_join(items, heads, "thread_id", "email_id", how="inner", hot_rows=hot_rows)
    if single_order:
        mail_order = [F.asc(F.coalesce("sent_at", "created_at")), F.asc("email_id")]
    else:
        mail_order = [F.asc_nulls_first("sent_at"), F.asc("created_at"), F.asc("email_id")]
    return rows.orderBy(F.desc_nulls_last("last_email_at"), F.asc("thread_id"), *mail_order)


def thread_detail(threads: DataFrame, emails: DataFrame, thread_id) -> DataFrame:
    """One thread and its mails.  The id filter reaches both scans, so no shuffle join is left to balance."""
    head = threads.filter(F.col("id") == F.lit(thread_id)).select(
        F.col("id").alias("thread_id"), "subject_normalized", "email_count")
    items = emails.filter(F.col("thread_id") == F.lit(thread_id)).select(
        "thread_id", F.col("id").alias("email_id"), "sender", "subject", "sent_at", "created_at")
    return items.join(head.limit(1), "thread_id").orderBy(F.coalesce("sent_at", "created_at"), "email_id")


def hydrate(hits: DataFrame, emails: DataFrame) -> DataFrame:
    """Fill a hit's missing summary and snippet from its mail; a hit whose mail is gone stays as it is."""
    stored = emails.select("id", F.col("summary").alias("_summary"),
                           F.substring("body_text", 1, SHORT_TEXT_CHARS).alias("_start"))
    empty_to_null = lambda name: F.when(F.col(name) != "", F.col(name))
    return (
        hits.join(stored, "id", "left")
        .withColumn("summary", F.coalesce(empty_to_null("summary"), empty_to_null("_summary"), F.col("summary")))
        .withColumn("snippet", F.coalesce(empty_to_null("snippet"), F.col("_start"), F.col("snippet")))
        .drop("_summary", "_start")
    )
