"""Thread queries."""

from oracle.base import ORDER, THREADS, norm_subject, summary, truncate, using

KNOWN = "SELECT DISTINCT message_id AS known_id FROM mail WHERE message_id IS NOT NULL"
REFS = """SELECT email_id, pos, trim(string_split(references_header, ' ')[pos], '<>') AS ref
FROM (SELECT email_id, references_header, unnest(range(1, len(string_split(references_header, ' ')) + 1)) AS pos
      FROM mail WHERE references_header IS NOT NULL)"""
FIRST_REF = """SELECT email_id, arg_min(ref, pos) AS reference_root FROM refs JOIN known ON ref = known_id GROUP BY email_id"""
ROOTS = """SELECT m.email_id, m.subject, coalesce(f.reference_root, k.known_id, m.message_id) AS root_id
FROM mail m LEFT JOIN first_ref f USING (email_id) LEFT JOIN known k ON k.known_id = m.in_reply_to"""
HEADERS = using("mail", known=KNOWN, refs=REFS, first_ref=FIRST_REF, roots=ROOTS)
# Threads of archives with short names are stored; the others are matched to them or to each other.
MATCHING = {
    "existing": "SELECT * FROM threads WHERE length(archive_id) <= 4",
    "by_root": "SELECT root_message_id, min(id) AS i FROM existing WHERE root_message_id IS NOT NULL GROUP BY 1",
    "by_subject": "SELECT subject_normalized, min(id) AS i FROM existing GROUP BY 1",
    "found": """SELECT g.id AS group_id, g.subject_normalized, g.root_message_id, r.i AS by_root, s.i AS by_subject
 FROM threads g LEFT JOIN by_root r ON r.root_message_id = g.root_message_id
 LEFT JOIN by_subject s ON s.subject_normalized = g.subject_normalized WHERE length(g.archive_id) > 4""",
    "firsts": """SELECT root_message_id, min(subject_normalized) AS f FROM found
 WHERE by_root IS NULL AND by_subject IS NULL AND root_message_id IS NOT NULL GROUP BY 1""",
    "matched": """SELECT group_id, coalesce(by_root, by_subject, sha256('thread' || chr(31) || coalesce(f, subject_normalized))) AS thread_id,
 CASE WHEN by_root IS NOT NULL THEN 'root' WHEN by_subject IS NOT NULL THEN 'subject' WHEN f <> subject_normalized THEN 'root' ELSE 'new' END AS matched_by
 FROM found LEFT JOIN firsts USING (root_message_id)""",
}

SQL = {
    "threads_by_subject": using("emails0") + """SELECT archive_id, thread_key, count(*) AS email_count FROM emails0
GROUP BY archive_id, thread_key""",
    "threads_by_header": HEADERS + """SELECT 'msg:' || root_id AS thread_key, count(*) AS email_count FROM roots
WHERE root_id IS NOT NULL GROUP BY 1""",
    "threads_global": HEADERS + f"""SELECT thread_key, count(*) AS email_count FROM (
SELECT CASE WHEN root_id IS NOT NULL THEN 'msg:' || root_id
 WHEN subject <> '' THEN 'subject:' || {norm_subject('subject')} END AS thread_key FROM roots)
WHERE thread_key IS NOT NULL GROUP BY 1""",
    "thread_root": using("threads") + "SELECT archive_id, thread_key, root_message_id FROM threads",
    "thread_stats": using("threads") + """SELECT id, subject_normalized, root_message_id, participant_count, email_count,
 first_email_at, last_email_at FROM threads""",
    "thread_summary": using("threaded", texts=f"""SELECT archive_id, thread_key, 'Thread conversation. ' || string_agg(
 subject || ': ' || {truncate('body_text', 500)}, ' | ' ORDER BY {ORDER}) AS txt
FROM threaded GROUP BY archive_id, thread_key HAVING count(*) > 1""") + summary("texts", "txt", "archive_id, thread_key"),
    "reply_parent_join": using("mail", known=KNOWN) + """SELECT email_id AS id, in_reply_to, known_id AS parent_id
FROM mail LEFT JOIN known ON known_id = in_reply_to""",
    "reference_root": using("mail", known=KNOWN, refs=REFS, first_ref=FIRST_REF) + """SELECT email_id AS id, reference_root
FROM first_ref""",
    "latest_per_message_id": using("emails", rows="""SELECT id, message_id, sent_at, created_at FROM emails
UNION ALL SELECT -id, in_reply_to, sent_at, created_at FROM emails WHERE references_header IS NOT NULL""") + """
SELECT message_id, id FROM rows WHERE message_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY sent_at DESC NULLS LAST, created_at DESC, id DESC) = 1""",
    "participant_union": using("emails0") + """SELECT id, array_to_string(list_sort(list_distinct(
 list_concat(list_concat([sender], receivers), cc))), ',') AS participants FROM emails0""",
    "thread_match_or_create": using("threads", **MATCHING) + """SELECT g.subject_normalized, g.root_message_id, g.archive_id, g.email_count,
 m.thread_id, m.matched_by FROM threads g JOIN matched m ON m.group_id = g.id""",
    "thread_refresh": using("threads", **MATCHING, members="""SELECT * FROM (
 SELECT t.* REPLACE (coalesce(m.thread_id, t.thread_id) AS thread_id) FROM threaded t LEFT JOIN matched m ON m.group_id = t.thread_id)
 WHERE thread_id IN (SELECT thread_id FROM matched)""", fresh=THREADS.replace("threaded", "members"), texts=f"""SELECT thread_id,
 'Thread conversation. ' || string_agg(subject || ': ' || {truncate('body_text', 500)}, ' | ' ORDER BY {ORDER}) AS txt
FROM members GROUP BY thread_id HAVING count(*) > 1""", sums=summary("texts", "txt", "thread_id")) + """
SELECT f.id AS thread_id, f.subject_normalized, f.root_message_id, f.participant_count, f.email_count, f.first_email_at, f.last_email_at,
 s.summary FROM fresh f LEFT JOIN sums s ON s.thread_id = f.id""",
}
SQL["threads_grown"] = SQL["threads_global"]
