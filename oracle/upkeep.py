"""Upserts, deletes, audits."""

from oracle.base import using
from oracle.search import COUNTED

_BASE = "SELECT email_id AS id, subject, 0 AS version FROM mail"
_DELTA = """SELECT email_id AS id, 'edited ' || subject AS subject, 1 AS version FROM mail WHERE in_reply_to IS NOT NULL
UNION ALL SELECT email_id, upper(subject), 2 FROM mail WHERE references_header IS NOT NULL
UNION ALL SELECT -email_id, subject, 1 FROM mail WHERE message_id IS NULL
UNION ALL SELECT email_id, 'lost', NULL FROM mail WHERE in_reply_to IS NOT NULL"""
_LAST = "SELECT * FROM delta QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC NULLS LAST) = 1"
_VERSIONS = using("mail", base=_BASE, delta=_DELTA, latest=_LAST)

SQL = {
    "sink_emails_roundtrip": using("threaded") + """SELECT id, archive_id, thread_id, sender,
 array_to_string(receivers, ',') AS receivers, subject, body_text, sent_at, summary FROM threaded""",
    "upsert_by_id": _VERSIONS + """SELECT * FROM latest UNION ALL
SELECT * FROM base WHERE id NOT IN (SELECT id FROM latest)""",
    "insert_if_absent": _VERSIONS + """SELECT * FROM base UNION ALL
SELECT * FROM latest WHERE id NOT IN (SELECT id FROM base)""",
    "delete_by_archive": COUNTED[:-1] + """, kept AS (SELECT * FROM emails WHERE archive_id <> 'src1'),
 left_postings AS (SELECT field, term FROM token_rows WHERE id IN (SELECT id FROM kept) UNION ALL SELECT 'sender', sender FROM kept)
SELECT 'emails' AS store, count(*) AS remaining FROM kept
UNION ALL SELECT 'postings', count(*) FROM left_postings
UNION ALL SELECT 'vocabulary', count(*) FROM (SELECT DISTINCT field, term FROM left_postings)
UNION ALL SELECT 'vectors', count(*) FROM kept""",
    "delete_thread_setnull": using("threaded") + """SELECT id, CASE WHEN count(in_reply_to) OVER (PARTITION BY thread_id) > 0
 THEN thread_id END AS thread_id FROM threaded""",
    "reindex_counts": using("emails") + """SELECT 'keyword' AS store, count(*) AS indexed FROM emails
UNION ALL SELECT 'vectors', count(*) FROM emails""",
    "index_audit": using("mail", t="SELECT email_id AS id FROM mail", i="""SELECT email_id AS id FROM mail
WHERE message_id IS NOT NULL UNION ALL SELECT -email_id FROM mail WHERE in_reply_to IS NULL""") + """
SELECT CASE WHEN t.id IS NOT NULL AND i.id IS NOT NULL THEN 'in_both' WHEN t.id IS NOT NULL THEN 'missing_in_index'
 ELSE 'orphan' END AS state, count(*) AS count FROM t FULL OUTER JOIN i USING (id) GROUP BY 1""",
    "schema_contract": using("mail") + """SELECT * FROM (VALUES
 ('email_archives', '', 'missing table'), ('emails', 'id', 'type is bigint'), ('emails', 'body_html', 'missing column'),
 ('emails', 'sent_at', 'type is timestamp_ntz'), ('emails', 'elasticsearch_id', 'missing column'),
 ('emails', 'chroma_id', 'missing column'), ('emails', 'created_at', 'type is timestamp_ntz'),
 ('email_threads', 'first_email_at', 'type is timestamp_ntz'), ('email_threads', 'last_email_at', 'type is timestamp_ntz'),
 ('email_threads', 'created_at', 'missing column'), ('email_threads', 'updated_at', 'missing column')
) v("table", "column", problem), (SELECT CAST(NULL AS BIGINT) AS rows) n
UNION ALL SELECT 'emails', 'subject', 'value too long', count(*) FROM mail WHERE length(subject) > 10 HAVING count(*) > 0
UNION ALL SELECT 'emails', 'sender', 'value too long', count(*) FROM mail WHERE length(sender) > 17 HAVING count(*) > 0""",
}
