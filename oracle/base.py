"""Shared pieces: the mail view, text helpers, and the derived tables as WITH entries."""

from __future__ import annotations

BLANK = r"E' \n\t\r\x0b\x0c'"

MAIL = """
SELECT d.doc_id AS email_id, d.source AS archive_id,
 CASE WHEN d.doc_id % 17 = 0 THEN NULL ELSE concat('m', d.doc_id, '@example.org') END AS message_id,
 CASE WHEN d.doc_id % 3 <> 0 THEN concat('m', CAST((d.doc_id - d.doc_id % 3) / 3 AS BIGINT), '@example.org') END AS in_reply_to,
 CASE WHEN d.doc_id % 5 = 1 THEN concat('<m', CAST((d.doc_id - d.doc_id % 9) / 9 AS BIGINT), '@example.org> <m',
      CAST((d.doc_id - d.doc_id % 3) / 3 AS BIGINT), '@example.org>') END AS references_header,
 concat('user', e.user_id, '@example.com') AS sender,
 CASE WHEN d.doc_id % 11 = 0 THEN ''
      WHEN d.doc_id % 2 = 0 THEN concat('user', d.doc_id % 7, '@example.com')
      ELSE concat('user', d.doc_id % 7, '@example.com,user', 7 + d.doc_id % 5, '@example.com') END AS receivers_csv,
 CASE WHEN d.doc_id % 13 = 0 THEN concat('user', d.doc_id % 19, '@example.com') ELSE '' END AS cc_csv,
 concat(CASE d.doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Re: ' WHEN 2 THEN 'FWD: re:  ' ELSE 'fw:' END,
        CASE WHEN d.doc_id % 29 = 0 THEN '' ELSE concat('Topic ', d.doc_id % 40) END) AS subject,
 d.text AS body_text,
 CASE WHEN d.doc_id % 23 = 0 THEN NULL ELSE e.ts END AS sent_at
FROM documents d JOIN events e ON e.event_id = d.doc_id * 5
"""


def trim(x: str) -> str:
    return f"trim({x}, {BLANK})"


def rtrim(x: str) -> str:
    return f"rtrim({x}, {BLANK})"


def collapse(x: str) -> str:
    return trim(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def truncate(x: str, n: int) -> str:
    return f"(CASE WHEN length({x}) <= {n} THEN {x} ELSE {rtrim(f'substr({x}, 1, {n - 3})')} || '...' END)"


def norm_subject(x: str) -> str:
    marks = rf"regexp_replace({x}, '^\s*(?:(?:re|fwd|fw):\s*)*', '', 'i')"
    return collapse(marks)


def summary(source: str, content: str, keep: str) -> str:
    """A subselect that adds ``summary`` of the text expression ``content`` to the columns ``keep`` of ``source``."""
    return f"""
SELECT {keep}, CASE WHEN len(ss) = 0 THEN {truncate('ct', 200)}
   WHEN length(pv) > 250 THEN {rtrim('substr(pv, 1, 247)')} || '...' ELSE pv || '.' END AS summary
FROM (SELECT *, array_to_string(ss, '. ') AS pv
 FROM (SELECT *, list_filter(list_transform(string_split(replace(ct, chr(10), ' '), '.'), lambda s: {trim('s')}),
                             lambda s: s <> '')[1:2] AS ss
  FROM (SELECT *, {truncate('c0', 3000)} AS ct FROM (SELECT *, {trim(content)} AS c0 FROM {source}))))
"""


def addresses(x: str) -> str:
    return f"list_filter(string_split({x}, ','), lambda a: a <> '')"


EMAILS0 = f"""
SELECT email_id AS id, archive_id, message_id, in_reply_to, references_header, sender,
 {addresses('receivers_csv')} AS receivers, {addresses('cc_csv')} AS cc, subject, body_text, sent_at,
 concat('mail-', email_id, '.eml') AS source_file,
 TIMESTAMP '2024-01-01 00:00:00' + email_id * INTERVAL 1 SECOND AS created_at,
 CASE WHEN {norm_subject('subject')} <> '' THEN {norm_subject('subject')} ELSE 'archive-' || archive_id END AS thread_key
FROM mail
"""
EMAILS = summary("emails0", "subject || '. ' || body_text", "* EXCLUDE (c0, ct, ss, pv)")
THREADED = "SELECT *, sha256(archive_id || chr(31) || thread_key) AS thread_id FROM emails"

ORDER = "sent_at ASC NULLS FIRST, created_at, id"

THREADS = f"""
SELECT t.thread_id AS id, t.archive_id, t.thread_key,
 CASE WHEN {norm_subject('f.subject')} <> '' THEN {norm_subject('f.subject')} ELSE t.thread_key END AS subject_normalized,
 CASE WHEN r.message_id IS NOT NULL THEN r.message_id ELSE f.message_id END AS root_message_id,
 p.participant_count, t.email_count, t.first_email_at, t.last_email_at
FROM (SELECT thread_id, any_value(archive_id) AS archive_id, min(thread_key) AS thread_key, count(*) AS email_count,
      min(sent_at) AS first_email_at, max(sent_at) AS last_email_at FROM threaded GROUP BY thread_id) t
JOIN (SELECT * FROM threaded QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY {ORDER}) = 1) f USING (thread_id)
LEFT JOIN (SELECT * FROM threaded WHERE message_id IS NOT NULL AND in_reply_to IS NULL
      QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY {ORDER}) = 1) r USING (thread_id)
JOIN (SELECT thread_id, count(DISTINCT a) AS participant_count FROM (
      SELECT thread_id, unnest(list_concat(list_concat([sender], receivers), cc)) AS a FROM threaded) GROUP BY thread_id) p
 USING (thread_id)
"""
ARCHIVES = """
SELECT archive_id AS id, archive_id || '.zip' AS filename,
 CASE WHEN count(*) = count(message_id) THEN 'completed' ELSE 'processing' END AS status,
 count(*) AS total_emails, count(message_id) AS processed_emails, CAST(NULL AS VARCHAR) AS error_message,
 min(created_at) AS created_at, max(created_at) AS updated_at
FROM emails GROUP BY archive_id
"""

_CHAIN = {
    "mail": MAIL, "emails0": EMAILS0, "emails": EMAILS, "threaded": THREADED, "threads": THREADS, "archives": ARCHIVES,
}
_NEEDS = {
    "mail": (), "emails0": ("mail",), "emails": ("mail", "emails0"), "threaded": ("mail", "emails0", "emails"),
    "threads": ("mail", "emails0", "emails", "threaded"), "archives": ("mail", "emails0", "emails"),
}


def using(*tables: str, **extra: str) -> str:
    """A WITH clause that defines the named derived tables, then the extra ones."""
    wanted = [name for name in _CHAIN if any(name == t or name in _NEEDS[t] for t in tables)]
    parts = [f"{name} AS ({_CHAIN[name]})" for name in wanted] + [f"{name} AS ({sql})" for name, sql in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n"
