"""Dashboard statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOP = 10
DAYS = 30
OVERVIEW = (
    "total_emails", "total_threads", "total_archives", "unique_senders", "unique_receivers", "emails_with_summary",
    "date_range_start", "date_range_end",
)
# Thread-size classes with their inclusive bounds (fixed values of the report).
SIZE_CLASSES = (("1", None, 1), ("2-5", 2, 5), ("6-10", 6, 10), ("11+", 11, None))


def row_count(rows: DataFrame, name: str) -> DataFrame:
    return rows.agg(F.count("*").alias(name))


def one_row(*frames: DataFrame) -> DataFrame:
    """Put one-row frames side by side: stack them with nulls in the gaps, then fold the stack into one row."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])


def unique_senders(emails: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return emails.agg(count("sender").alias("unique_senders"))


def unique_receivers(emails: DataFrame) -> DataFrame:
    return emails.select(F.explode("receivers").alias("receiver")).agg(
        F.count_distinct("receiver").alias("unique_receivers"))


def with_summary(emails: DataFrame) -> DataFrame:
    return emails.agg(F.count_if(F.col("summary").isNotNull() & (F.col("summary") != "")).alias("emails_with_summary"))


def date_range(emails: DataFrame) -> DataFrame:
    return emails.agg(F.min("sent_at").alias("date_range_start"), F.max("sent_at").alias("date_range_end"))


def top_senders(emails: DataFrame, limit: int = TOP) -> DataFrame:
    counts = emails.groupBy("sender").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "sender").limit(limit)


def daily_volume(emails: DataFrame, days: int = DAYS) -> DataFrame:
    """The last ``days`` days that have mail, oldest first."""
    dated = emails.filter(F.col("sent_at").isNotNull()).groupBy(F.to_date("sent_at").alias("day"))
    return dated.agg(F.count("*").alias("count")).orderBy(F.desc("day")).limit(days).orderBy("day")


def top_subjects(emails: DataFrame, limit: int = TOP) -> DataFrame:
    counts = emails.filter(F.col("subject") != "").groupBy("subject").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "subject").limit(limit)


def thread_size_distribution(threads: DataFrame) -> DataFrame:
    """Number of threads per size class, all classes always present."""
    size = F.col("email_count")
    counts = []
    for label, low, high in SIZE_CLASSES:
        inside = F.lit(True)
        if low is not None:
            inside = inside & (size >= low)
        if high is not None:
            inside = inside & (size <= high)
        counts.append(F.struct(F.lit(label).alias("bucket"), F.count_if(inside).alias("count")))
    return threads.agg(F.array(*counts).alias("c")).select(F.inline("c"))


def thread_sizes(threaded: DataFrame) -> DataFrame:
    """``(thread_id, email_count)``; nothing but the thread ids is read for it."""
    return threaded.filter(F.col("thread_id").isNotNull()).groupBy("thread_id").agg(F.count("*").alias("email_count"))


def overview(emails: DataFrame, threads: DataFrame, archives: DataFrame) -> DataFrame:
    """Figures of the mails from one pass: receivers become sets per mail and meet in one distinct count with the senders.

    ``threads`` needs one row a thread and no further columns.
    """
    people = F.array_union(F.array(F.struct(F.lit(0).alias("kind"), F.col("sender").alias("who"))),
                           F.transform("receivers", lambda r: F.struct(F.lit(1).alias("kind"), r.alias("who"))))
    slim = emails.select("sent_at", (F.coalesce("summary", F.lit("")) != "").alias("has_summary"),
                         F.posexplode_outer(people).alias("at", "person"))
    # Grouped by person first: partial sums and extremes of the mails ride along, so the mails are read once.
    own = F.col("at") == 0
    by_person = slim.groupBy("person").agg(
        F.count_if(own).alias("n"), F.count_if(own & F.col("has_summary")).alias("s"), F.min("sent_at").alias("lo"), F.max("sent_at").alias("hi"))
    named = F.col("person.who").isNotNull()
    facts = by_person.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_emails"), F.count_if(named & (F.col("person.kind") == 0)).alias("unique_senders"),
        F.count_if(named & (F.col("person.kind") == 1)).alias("unique_receivers"), F.coalesce(F.sum("s"), F.lit(0)).alias("emails_with_summary"),
        F.min("lo").alias("date_range_start"), F.max("hi").alias("date_range_end"))
    return one_row(facts, row_count(threads, "total_threads"), row_count(archives, "total_archives")).select(*OVERVIEW)


def dashboard(emails: DataFrame, threads: DataFrame, archives: DataFrame) -> DataFrame:
    """One row: the overview and the four panels as nested values.  Every panel is a short top-k report."""
    return assembled(overview(emails, threads, archives), top_senders(emails), daily_volume(emails), top_subjects(emails),
                     thread_size_distribution(threads))


def assembled(figures: DataFrame, senders: DataFrame, days: DataFrame, subjects: DataFrame, sizes: DataFrame) -> DataFrame:
    """The dashboard from its parts."""
    def panel(rows: DataFrame, name: str, *fields) -> DataFrame:
        return rows.agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))

    return one_row(
        figures.select(F.struct(*OVERVIEW).alias("overview")),
        panel(senders, "top_senders", (-F.col("count")).alias("order"), "sender", "count"),
        panel(days, "daily_volume", "day", "count"),
        panel(subjects, "top_subjects", (-F.col("count")).alias("order"), "subject", "count"),
        panel(sizes, "thread_size_distribution", "bucket", "count"),
    ).select(
        "overview",
        F.transform("top_senders", lambda s: F.struct(s["sender"].alias("sender"), s["count"].alias("count")))
         .alias("top_senders"),
        F.transform("daily_volume", lambda d: F.struct(
            F.date_format(d["day"], "yyyy-MM-dd").alias("date"), d["count"].alias("count"))).alias("daily_volume"),
        F.transform("top_subjects", lambda s: F.struct(s["subject"].alias("keyword"), s["count"].alias("count")))
         .alias("top_subjects"),
        F.map_from_entries("thread_size_distribution").alias("thread_size_distribution"),
    )


def dashboard_rows(whole: DataFrame) -> DataFrame:
    """A dashboard in long form: ``(panel, position, label, value)`` with text values."""
    text = "cast({} as string)".format
    figures = F.array(*[
        F.struct(F.lit(n).alias("label"), (
            F.date_format(f"overview.{n}", "yyyy-MM-dd HH:mm:ss") if n.startswith("date_") else F.expr(text(f"overview.{n}"))
        ).alias("value")) for n in OVERVIEW])
    buckets = F.array(*[
        F.struct(F.lit(label).alias("label"), F.col("thread_size_distribution")[label].cast("string").alias("value"))
        for label, _, _ in SIZE_CLASSES])

    def relabel(name, label):
        return F.transform(name, lambda r: F.struct(r[label].alias("label"), r["count"].cast("string").alias("value")))

    panels = F.array(
        F.struct(F.lit("overview").alias("panel"), figures.alias("rows")),
        F.struct(F.lit("top_senders").alias("panel"), relabel("top_senders", "sender").alias("rows")),
        F.struct(F.lit("daily_volume").alias("panel"), relabel("daily_volume", "date").alias("rows")),
        F.struct(F.lit("top_subjects").alias("panel"), relabel("top_subjects", "keyword").alias("rows")),
        F.struct(F.lit("thread_size_distribution").alias("panel"), buckets.alias("rows")),
    )
    return (
        whole.select(F.explode(panels).alias("p"))
        .select("p.panel", F.posexplode("p.rows").alias("position", "r"))
        .select("panel", F.col("position").cast("bigint").alias("position"), "r.label", "r.value")
    )


def archive_progress(archives: DataFrame) -> DataFrame:
    """Percentage done of each archive; an empty one counts as done only once completed."""
    done = F.round(100 * F.col("processed_emails") / F.when(F.col("total_emails") > 0, F.col("total_emails")))
    idle = F.when(F.col("status") == "completed", 100).otherwise(0)
    return archives.withColumn("progress", F.coalesce(done, idle).cast("bigint"))
