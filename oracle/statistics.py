"""Dashboard statistics."""

from oracle.base import using

TOP_SENDERS = "SELECT sender, count(*) AS count FROM emails GROUP BY sender ORDER BY count DESC, sender LIMIT 10"
TOP_SUBJECTS = "SELECT subject, count(*) AS count FROM emails WHERE subject <> '' GROUP BY subject ORDER BY count DESC, subject LIMIT 10"
DAILY = """SELECT CAST(sent_at AS DATE) AS day, count(*) AS count FROM emails WHERE sent_at IS NOT NULL
GROUP BY 1 ORDER BY 1 DESC LIMIT 30"""
SIZES = """SELECT b.bucket, CAST(count(t.id) AS BIGINT) AS count
FROM (VALUES ('1', -1, 1), ('2-5', 2, 5), ('6-10', 6, 10), ('11+', 11, 1000000000)) b(bucket, lo, hi)
LEFT JOIN threads t ON t.email_count BETWEEN b.lo AND b.hi GROUP BY b.bucket"""
OVERVIEW = """SELECT (SELECT count(*) FROM emails) AS total_emails, (SELECT count(*) FROM threads) AS total_threads,
 (SELECT count(*) FROM archives) AS total_archives, (SELECT count(DISTINCT sender) FROM emails) AS unique_senders,
 (SELECT count(DISTINCT r) FROM (SELECT unnest(receivers) AS r FROM emails)) AS unique_receivers,
 (SELECT count(*) FROM emails WHERE summary IS NOT NULL AND summary <> '') AS emails_with_summary,
 (SELECT min(sent_at) FROM emails) AS date_range_start, (SELECT max(sent_at) FROM emails) AS date_range_end"""

SQL = {
    "counts": using("threads", "archives") + """SELECT (SELECT count(*) FROM emails) AS emails,
 (SELECT count(*) FROM threads) AS threads, (SELECT count(*) FROM archives) AS archives""",
    "unique_senders": using("mail") + "SELECT count(DISTINCT sender) AS unique_senders FROM mail",
    "unique_receivers": using("emails") + """SELECT count(DISTINCT r) AS unique_receivers
FROM (SELECT unnest(receivers) AS r FROM emails)""",
    "with_summary": using("emails") + """SELECT count(*) AS emails_with_summary FROM emails
WHERE summary IS NOT NULL AND summary <> ''""",
    "date_range": using("mail") + "SELECT min(sent_at) AS date_range_start, max(sent_at) AS date_range_end FROM mail",
    "top_senders": using("emails") + TOP_SENDERS,
    "daily_volume": using("emails") + DAILY,
    "top_subjects": using("emails") + TOP_SUBJECTS,
    "thread_size_dist": using("threads") + SIZES,
    "overview": using("threads", "archives") + OVERVIEW,
    "dashboard": using(
        "threads", "archives", o=OVERVIEW, ts=TOP_SENDERS, dv=DAILY, tj=TOP_SUBJECTS, sz=SIZES) + """
SELECT 'overview' AS panel, CAST(v.position AS BIGINT) AS position, v.label, CASE v.position
  WHEN 0 THEN CAST(total_emails AS VARCHAR) WHEN 1 THEN CAST(total_threads AS VARCHAR)
  WHEN 2 THEN CAST(total_archives AS VARCHAR) WHEN 3 THEN CAST(unique_senders AS VARCHAR)
  WHEN 4 THEN CAST(unique_receivers AS VARCHAR) WHEN 5 THEN CAST(emails_with_summary AS VARCHAR)
  WHEN 6 THEN strftime(date_range_start, '%Y-%m-%d %H:%M:%S') ELSE strftime(date_range_end, '%Y-%m-%d %H:%M:%S') END AS value
FROM o, (VALUES (0, 'total_emails'), (1, 'total_threads'), (2, 'total_archives'), (3, 'unique_senders'),
 (4, 'unique_receivers'), (5, 'emails_with_summary'), (6, 'date_range_start'), (7, 'date_range_end')) v(position, label)
UNION ALL SELECT 'top_senders', row_number() OVER (ORDER BY count DESC, sender) - 1, sender, CAST(count AS VARCHAR) FROM ts
UNION ALL SELECT 'daily_volume', row_number() OVER (ORDER BY day) - 1, strftime(day, '%Y-%m-%d'), CAST(count AS VARCHAR) FROM dv
UNION ALL SELECT 'top_subjects', row_number() OVER (ORDER BY count DESC, subject) - 1, subject, CAST(count AS VARCHAR) FROM tj
UNION ALL SELECT 'thread_size_distribution', CASE bucket WHEN '1' THEN 0 WHEN '2-5' THEN 1 WHEN '6-10' THEN 2 ELSE 3 END,
 bucket, CAST(count AS VARCHAR) FROM sz""",
    "archive_progress": using("archives") + """SELECT id, status, total_emails, processed_emails, CAST(CASE
 WHEN total_emails > 0 THEN round(100.0 * processed_emails / total_emails)
 WHEN status = 'completed' THEN 100 ELSE 0 END AS BIGINT) AS progress FROM archives""",
}
SQL["overview_state"], SQL["dashboard_state"] = SQL["overview"], SQL["dashboard"]
SQL["thread_figures_state"] = using("threads") + """SELECT id AS thread_id, email_count, participant_count, first_email_at, last_email_at
FROM threads"""
