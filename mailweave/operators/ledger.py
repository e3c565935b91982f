"""Archive ledger derived from what ingest saw."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def archive_ledger(files: DataFrame, members: DataFrame) -> DataFrame:
    """One row per archive file: status and counts.

    ``files`` has ``archive_id, filename``; ``members`` the ingest output: ``archive_id, entry_path, error`` with a
    null ``entry_path`` for an archive that could not be opened.  An archive without members still gets its row.
    """
    seen = members.groupBy("archive_id").agg(
        F.count_if(F.col("entry_path").isNotNull()).alias("total_emails"),
        F.count_if(F.col("entry_path").isNotNull() & F.col("error").isNull()).alias("processed_emails"),
        F.max(F.when(F.col("entry_path").isNull(), F.col("error"))).alias("error_message"),
    )
    zero = F.lit(0).cast("bigint")
    return files.join(seen, "archive_id", "left").select(
        "archive_id", "filename",
        F.when(F.col("error_message").isNotNull(), "failed").otherwise("completed").alias("status"),
        F.coalesce("total_emails", zero).alias("total_emails"),
        F.coalesce("processed_emails", zero).alias("processed_emails"),
        "error_message",
    )
