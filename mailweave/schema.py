"""Declared table contracts and the check that compares real tables against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(*columns: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in columns])


TEXT, COUNT, TIME = T.StringType(), T.LongType(), T.TimestampType()
ADDRESSES = T.ArrayType(T.StringType(), containsNull=False)

ARCHIVES = _struct(
    ("id", TEXT, False), ("filename", TEXT, False), ("file_path", TEXT, False), ("status", TEXT, False),
    ("total_emails", COUNT, False), ("processed_emails", COUNT, False), ("error_message", TEXT, True),
    ("created_at", TIME, False), ("updated_at", TIME, False),
)
THREADS = _struct(
    ("id", TEXT, False), ("subject_normalized", TEXT, False), ("root_message_id", TEXT, True),
    ("participant_count", COUNT, False), ("email_count", COUNT, False), ("first_email_at", TIME, True),
    ("last_email_at", TIME, True), ("summary", TEXT, True), ("created_at", TIME, False), ("updated_at", TIME, False),
)
EMAILS = _struct(
    ("id", TEXT, False), ("archive_id", TEXT, False), ("thread_id", TEXT, True), ("message_id", TEXT, True),
    ("in_reply_to", TEXT, True), ("references_header", TEXT, True), ("sender", TEXT, False),
    ("receivers", ADDRESSES, False), ("cc", ADDRESSES, False), ("subject", TEXT, False), ("body_text", TEXT, False),
    ("body_html", TEXT, True), ("sent_at", TIME, True), ("summary", TEXT, True), ("elasticsearch_id", TEXT, True),
    ("chroma_id", TEXT, True), ("source_file", TEXT, True), ("created_at", TIME, False),
)
PARSED_MAIL = _struct(
    ("message_id", TEXT, True), ("in_reply_to", TEXT, True), ("references_header", TEXT, True),
    ("sender", TEXT, False), ("receivers", ADDRESSES, False), ("cc", ADDRESSES, False), ("subject", TEXT, False),
    ("body_text", TEXT, False), ("body_html", TEXT, True), ("sent_at", TIME, True), ("source_file", TEXT, True),
)

REQUIRED_TABLES = {"email_archives": ARCHIVES, "email_threads": THREADS, "emails": EMAILS}

# Declared lengths of the bounded text columns (fixed values of the data model).
MAX_LENGTHS = {
    "message_id": 512, "in_reply_to": 512, "sender": 512, "subject": 1024,
    "elasticsearch_id": 128, "chroma_id": 128, "source_file": 1024,
}

# Output tuples of the read views.
LIST_ITEM = ("id", "sender", "subject", "sent_at", "summary", "thread_id")
EMAIL_DETAIL = (
    "id", "archive_id", "thread_id", "message_id", "in_reply_to", "sender", "receivers", "cc", "subject",
    "body_text", "sent_at", "summary", "source_file", "created_at",
)

def contract_problems(
    spark: SparkSession, tables: dict[str, DataFrame], required: dict[str, T.StructType] = REQUIRED_TABLES
) -> DataFrame:
    """Rows ``(table, column, problem)``: absent tables, absent columns, other types.

    Only schemas are looked at, so no data is read.
    """
    found = []
    for table, wanted in required.items():
        if table not in tables:
            found.append((table, "", "missing table"))
            continue
        actual = {field.name: field.dataType for field in tables[table].schema.fields}
        for field in wanted.fields:
            if field.name not in actual:
                found.append((table, field.name, "missing column"))
            elif actual[field.name].simpleString() != field.dataType.simpleString():
                found.append((table, field.name, f"type is {actual[field.name].simpleString()}"))
    return spark.createDataFrame(found, "`table` string, `column` string, problem string")


def length_problem(columns: list[str], limits: dict[str, int] = MAX_LENGTHS) -> Column:
    """Why a row does not fit the declared lengths; null where it does."""
    checks = [F.when(F.length(name) > limit, F.lit(f"{name} is longer than {limit}")) for name, limit in limits.items() if name in columns]
    return F.coalesce(*checks) if checks else F.lit(None).cast("string")


def overlong_values(emails: DataFrame, limits: dict[str, int] = MAX_LENGTHS) -> DataFrame:
    """Values longer than declared, as ``(id, column, length)``; such mails belong to the rejects."""
    sizes = F.array(*[
        F.struct(F.lit(name).alias("column"), F.length(name).cast("long").alias("length"), F.lit(limit).alias("limit"))
        for name, limit in limits.items() if name in emails.columns
    ])
    return (
        emails.select("id", F.explode(sizes).alias("s"))
        .filter("s.length > s.limit")
        .select("id", "s.column", "s.length")
    )
