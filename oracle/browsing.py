"""Lookups, filters, projections, pages and enrichment."""

from oracle.base import using

ISO = "'%Y-%m-%dT%H:%M:%S'"
THREAD_ID = "sha256('src5' || chr(31) || 'Topic 5')"

SQL = {
    "lookup_by_id": using("emails") + "SELECT id, sender, subject, sent_at, summary FROM emails WHERE id = 42",
    "lookup_by_ids": using("emails0") + """SELECT CAST(v.pos AS BIGINT) AS pos, id, sender, subject FROM emails0
JOIN (VALUES (0, 77), (1, 3), (2, 1000000000000), (3, 150), (4, 8)) v(pos, wanted) ON id = wanted""",
    "lookup_by_message_id": using("emails0") + """SELECT id, message_id, subject FROM emails0
WHERE message_id = 'm31@example.org' ORDER BY id LIMIT 1""",
    "filter_sender": using("mail") + """SELECT email_id AS id, sender, subject, sent_at FROM mail
WHERE contains(lower(sender), 'user1')""",
    "filter_sender_wildcard": using("mail") + """SELECT email_id AS id, sender, subject, sent_at FROM mail
WHERE sender ILIKE '%r_5@ex%com%'""",
    "filter_sender_thread": using("threaded") + f"""SELECT id, sender, subject, thread_id FROM threaded
WHERE contains(lower(sender), 'user') AND thread_id = {THREAD_ID}""",
    "project_list_item": using("threaded") + "SELECT id, sender, subject, sent_at, summary, thread_id FROM threaded",
    "project_detail": using("threaded") + """SELECT id, archive_id, thread_id, message_id, in_reply_to, sender,
 array_to_string(receivers, ',') AS receivers, array_to_string(cc, ',') AS cc, subject, body_text, sent_at, summary,
 source_file, created_at FROM threaded""",
    "index_document": using("threaded") + f"""SELECT id AS email_id, archive_id, thread_id, sender,
 array_to_string(receivers, ',') AS receivers, array_to_string(cc, ',') AS cc, subject, body_text, summary,
 strftime(sent_at, {ISO}) AS sent_at, strftime(created_at, {ISO}) AS created_at, source_file FROM threaded""",
    "vector_metadata": using("threaded") + f"""SELECT id AS email_id, archive_id, thread_id, sender,
 substr(subject, 1, 500) AS subject, coalesce(strftime(sent_at, {ISO}), '') AS sent_at FROM threaded""",
    "kw_date_range": using("mail") + """SELECT email_id AS id, sent_at FROM mail
WHERE sent_at >= TIMESTAMP '2024-01-10' AND sent_at <= TIMESTAMP '2024-01-20 12:00:00'""",
    "email_with_thread": using("threads") + """SELECT e.id, e.sender, e.subject, e.thread_id,
 t.subject_normalized AS thread_subject FROM threaded e LEFT JOIN threads t ON t.id = e.thread_id""",
    "thread_with_emails": using("threads") + """SELECT t.id AS thread_id, e.id AS email_id, e.sender, e.subject, e.sent_at,
 e.summary AS email_summary, e.created_at, t.subject_normalized, t.participant_count, t.email_count, t.first_email_at,
 t.last_email_at FROM threads t JOIN threaded e ON e.thread_id = t.id""",
    "thread_detail": using("threads") + f"""SELECT t.id AS thread_id, e.id AS email_id, e.sender, e.subject, e.sent_at,
 e.created_at, t.subject_normalized, t.email_count FROM threads t JOIN threaded e ON e.thread_id = t.id
WHERE t.id = {THREAD_ID}""",
    "hydrate_hits": using("emails", hits="""SELECT CASE WHEN message_id IS NULL THEN -id ELSE id END AS id,
 CASE WHEN in_reply_to IS NOT NULL THEN subject END AS summary,
 CASE WHEN references_header IS NOT NULL THEN 'excerpt' ELSE '' END AS snippet FROM emails""") + """
SELECT h.id, coalesce(nullif(h.summary, ''), nullif(e.summary, ''), h.summary) AS summary,
 coalesce(nullif(h.snippet, ''), substr(e.body_text, 1, 200), h.snippet) AS snippet
FROM hits h LEFT JOIN emails e ON e.id = h.id""",
    "page_emails": using("emails") + """SELECT id, sender, subject, sent_at FROM emails
ORDER BY sent_at DESC NULLS LAST, created_at DESC, id LIMIT 20 OFFSET 20""",
    "page_threads": using("threads") + """SELECT id, subject_normalized, last_email_at FROM threads
ORDER BY last_email_at DESC NULLS LAST, id LIMIT 20 OFFSET 20""",
    "page_archives": using("archives") + """SELECT id, filename, status, created_at FROM archives
ORDER BY created_at DESC, id LIMIT 7""",
    "page_totals": using("mail") + """SELECT count(*) AS total, CAST(20 AS BIGINT) AS page_size,
 CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM mail""",
}
