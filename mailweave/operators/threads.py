"""Conversation threads: grouping, statistics, roots, summaries and matching to stored threads.

Groups may be very large (an alert subject, a mailing list), so nothing here collects a whole group:
statistics are partial aggregates and the summary reads the first mails only, as many as can matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailweave.functions.headers import normalized_subject, reference_ids
from mailweave.functions.text import SUMMARY_INPUT_CHARS, THREAD_BODY_CHARS, extractive_summary, truncate
from mailweave.operators.skew import HOT_ROWS, first_n_per_key, lookup_join, spread_nulls

# A part of the combined text has at least ": " and all but the first a " | " before it, so this many
# mails always fill the summary's input and later ones cannot change the result.
SUMMARY_MAILS = -(-SUMMARY_INPUT_CHARS // 5)

# Order of mails within a thread: undated ones first, then by date, creation and id.
MAIL_ORDER = ("sent_at", "created_at", "id")


def _position() -> Column:
    # Struct comparison puts nulls first, which is the order wanted for undated mails.
    return F.struct(*MAIL_ORDER)


def subject_key(archive_id: Column, subject: Column) -> Column:
    """Archive-mode group: the normalised subject, or the archive itself where that is empty."""
    norm = normalized_subject(subject)
    return F.when(norm != "", norm).otherwise(F.concat(F.lit("archive-"), archive_id.cast("string")))


def thread_identity(scope: Column, key: Column) -> Column:
    """Id of a thread: a hash of where it belongs (its archive, or all of them) and of what its mails share."""
    return F.sha2(F.concat_ws("\u001f", scope.cast("string"), key), 256)


def with_subject_thread(emails: DataFrame) -> DataFrame:
    """Add ``thread_key`` and ``thread_id``.  No shuffle: both depend on the row alone."""
    key = subject_key(F.col("archive_id"), F.col("subject"))
    return emails.withColumn("thread_key", key).withColumn("thread_id", thread_identity(F.col("archive_id"), F.col("thread_key")))


def threads_by_subject(emails: DataFrame) -> DataFrame:
    key = subject_key(F.col("archive_id"), F.col("subject")).alias("thread_key")
    return emails.groupBy("archive_id", key).agg(F.count("*").alias("email_count"))


def known_message_ids(emails: DataFrame) -> DataFrame:
    return emails.filter(F.coalesce("message_id", F.lit("")) != "").select("message_id").distinct()


def reply_parents(emails: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each mail with the id it answers, ``parent_id`` null where that mail is not in the corpus."""
    known = known_message_ids(emails).select(F.col("message_id").alias("in_reply_to"),
                                             F.col("message_id").alias("parent_id"))
    return lookup_join(emails.select("id", "in_reply_to"), known, "in_reply_to", "id", hot_rows=hot_rows)


def reference_roots(emails: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """For each mail with one: the first id of its References header that is in the corpus."""
    links = emails.select("id", F.posexplode(reference_ids(F.col("references_header"))).alias("pos", "message_id"))
    found = lookup_join(links, known_message_ids(emails), "message_id", "id", how="inner", hot_rows=hot_rows)
    return found.groupBy("id").agg(F.min_by("message_id", "pos").alias("reference_root"))


def header_roots(emails: DataFrame, hot_rows: int = HOT_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, root_id)`` and the columns of ``keep`` for every mail: first known reference, else known parent, else own message id.

    All candidates of a mail go through one join, in order of preference; the mail's own row travels with the first of them, and
    a mail that has none takes its own id without one, so mails are not joined to themselves.
    """
    def present(name):
        return F.when(F.coalesce(F.col(name), F.lit("")) != "", F.array(name)).otherwise(F.array().cast("array<string>"))

    own = F.when(F.col("message_id") != "", F.col("message_id"))
    candidates = F.concat(reference_ids(F.col("references_header")), present("in_reply_to"))
    links = emails.select("id", own.alias("_own"), *keep, F.posexplode_outer(candidates).alias("pos", "message_id"))
    known = known_message_ids(emails).withColumn("_known", F.lit(True))
    found = lookup_join(links, known, "message_id", "id", hot_rows=hot_rows)
    first = F.min_by("message_id", F.when(F.col("_known"), F.col("pos")))
    rest = [F.first(c).alias(c) for c in ("_own", *keep)]
    return found.groupBy("id").agg(first.alias("_first"), *rest).select("id", *keep, F.coalesce("_first", "_own").alias("root_id"))


def with_global_thread_key(emails: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``thread_key``: header root, else normalised subject, else null (mail stays unthreaded)."""
    keys = global_thread_keys(emails, hot_rows)
    return emails.join(keys, "id", "left")


def global_thread_keys(emails: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(id, thread_key)`` in one pass over the mails."""
    by_subject = F.when(F.col("subject") != "", F.concat(F.lit("subject:"), normalized_subject(F.col("subject"))))
    return header_roots(emails, hot_rows, ("subject",)).select(
        "id", F.coalesce(F.concat(F.lit("msg:"), F.col("root_id")), by_subject).alias("thread_key"))


def threads_by_header(emails: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    roots = header_roots(emails, hot_rows).filter(F.col("root_id").isNotNull())
    return roots.groupBy(F.concat(F.lit("msg:"), F.col("root_id")).alias("thread_key")).agg(
        F.count("*").alias("email_count"))


def threads_global(emails: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Header groups, and subject groups of the mails the headers leave over."""
    keyed = global_thread_keys(emails, hot_rows).filter(F.col("thread_key").isNotNull())
    return keyed.groupBy("thread_key").agg(F.count("*").alias("email_count"))


def participants(sender: Column, receivers: Column, cc: Column) -> Column:
    """Distinct addresses of one mail; an empty sender does not count."""
    own = F.when(F.coalesce(sender, F.lit("")) != "", F.array(sender)).otherwise(F.array().cast("array<string>"))
    return F.array_union(own, F.array_union(receivers, cc))


def thread_stats(threaded: DataFrame, keys: tuple[str, ...] = ("thread_id",), fallback: str = "thread_key") -> DataFrame:
    """One row per thread from its mails.

    Needs the thread columns, ``fallback`` (subject of a thread whose first mail has none), and the mail columns.
    Mails are aggregated as they are; participants are counted as distinct (thread, address) pairs on their own.
    """
    rows = threaded.filter(F.col(keys[-1]).isNotNull())
    has_id = F.coalesce("message_id", F.lit("")) != ""
    position = _position()
    opener = F.min_by("message_id", F.when(has_id & (F.coalesce("in_reply_to", F.lit("")) == ""), position))
    stats = rows.groupBy(*keys).agg(
        F.count("*").alias("email_count"), F.min("sent_at").alias("first_email_at"), F.max("sent_at").alias("last_email_at"),
        F.coalesce(opener, F.min_by(F.when(has_id, F.col("message_id")), position)).alias("root_message_id"),
        normalized_subject(F.min_by("subject", position)).alias("_subject"), F.min(fallback).alias("_fallback"))
    everyone = F.explode(participants(F.col("sender"), F.col("receivers"), F.col("cc")))
    people = rows.select(*[F.col(k).alias(f"_{k}") for k in keys], everyone.alias("_who")).distinct().groupBy(*[f"_{k}" for k in keys]).agg(
        F.count("*").alias("participant_count"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    stats = stats.join(people, same, "left").withColumn("participant_count", F.coalesce("participant_count", F.lit(0)))
    subject = F.when(F.col("_subject") != "", F.col("_subject")).otherwise(F.col("_fallback"))
    return stats.select(
        *keys, subject.alias("subject_normalized"), "root_message_id", "participant_count", "email_count",
        "first_email_at", "last_email_at",
    )


def thread_roots(threaded: DataFrame, keys: tuple[str, ...] = ("thread_id",)) -> DataFrame:
    """Root message of each thread: earliest mail with an id and no parent, else the first mail's own id."""
    has_id = F.coalesce("message_id", F.lit("")) != ""
    starts = has_id & (F.coalesce("in_reply_to", F.lit("")) == "")
    return threaded.groupBy(*keys).agg(F.coalesce(
        F.min_by("message_id", F.when(starts, _position())),
        F.min_by(F.when(has_id, F.col("message_id")), _position()),
    ).alias("root_message_id"))


def thread_summaries(threaded: DataFrame, keys: tuple[str, ...] = ("thread_id",)) -> DataFrame:
    """Extractive summary of every thread with more than one mail, over ``subject: body`` parts in order.

    Bodies are cut before the shuffle.  Only the first ``SUMMARY_MAILS`` mails of a thread travel, picked in
    salted slices; more cannot reach the text the summary is made of.
    """
    part = F.concat(F.col("subject"), F.lit(": "), truncate(F.col("body_text"), THREAD_BODY_CHARS))
    rows = threaded.select(*keys, *MAIL_ORDER, part.alias("part"))
    order = [F.asc_nulls_first("sent_at"), F.asc("created_at"), F.asc("id")]
    first = first_n_per_key(rows, list(keys), order, SUMMARY_MAILS, "id")
    texts = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "part"))).alias("parts"))
    combined = F.array_join(F.transform("parts", lambda p: p["part"]), " | ")
    return texts.filter(F.size("parts") > 1).select(
        *keys, extractive_summary(F.lit("Thread conversation"), combined).alias("summary"))


def match_or_create(groups: DataFrame, existing: DataFrame) -> DataFrame:
    """Give each new group a thread id: of the stored thread with its root, else with its subject, else a new one.

    ``groups`` has ``subject_normalized`` and ``root_message_id``; ``existing`` also ``id``.  Where several stored
    threads qualify the smallest id is taken.  New groups of one root are one thread, named by the first of their subjects;
    groups without a root share one with those of their subject.
    """
    by_root = existing.filter(F.col("root_message_id").isNotNull()).groupBy("root_message_id").agg(
        F.min("id").alias("_by_root"))
    by_subject = existing.filter(F.col("subject_normalized").isNotNull()).groupBy("subject_normalized").agg(F.min("id").alias("_by_subject"))
    met = groups.withColumn("_row", F.xxhash64(*groups.columns))

    def found(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
        keyed = table.withColumnRenamed(key, "_key")
        return rows.join(keyed, spread_nulls(key, "_row") == F.col("_key"), "left").drop("_key")

    met = found(found(met, by_root, "root_message_id"), by_subject, "subject_normalized")
    stored = F.coalesce("_by_root", "_by_subject")
    firsts = met.filter(stored.isNull() & F.col("root_message_id").isNotNull()).groupBy("root_message_id").agg(
        F.min("subject_normalized").alias("_first"))
    met = found(met, firsts, "root_message_id")
    first = F.coalesce("_first", "subject_normalized")
    return (
        met.withColumn("thread_id", F.coalesce(stored, thread_identity(F.lit("thread"), first)))
        .withColumn("matched_by", F.when(F.col("_by_root").isNotNull(), "root").when(F.col("_by_subject").isNotNull(), "subject")
                    .when(first != F.col("subject_normalized"), "root").otherwise("new"))
        .drop("_by_root", "_by_subject", "_first", "_row")
    )


def refreshed(members: DataFrame, touched: DataFrame) -> DataFrame:
    """Statistics and summary of the touched threads, from all their members.

    ``members`` are mails with their ``thread_id`` and ``thread_key``; ``touched`` lists thread ids.
    """
    rows = members.join(touched.select("thread_id").distinct(), "thread_id", "left_semi")
    return thread_stats(rows).join(thread_summaries(rows), "thread_id", "left")


def latest_per_message_id(emails: DataFrame) -> DataFrame:
    """The last mail of each message id: a partial aggregate per id, no sort of whole groups."""
    last = F.max_by("id", F.struct("sent_at", "created_at", "id"))
    return emails.filter(F.coalesce("message_id", F.lit("")) != "").groupBy("message_id").agg(last.alias("id"))
