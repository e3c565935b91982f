"""Scalar functions."""

from oracle.base import collapse, norm_subject, truncate, using

_AT = "instr(lower(text), 'the')"
_RAW = f"""CASE WHEN {_AT} = 0 THEN substr(text, 1, 200)
 ELSE substr(text, greatest({_AT} - 60, 1), {_AT} + 3 + 60 - greatest({_AT} - 60, 1)) END"""
_DECODED = ("replace(replace(replace(replace(html, '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', chr(34)), "
            "'&amp;', '&')")

SQL = {
    "x_address": using("mail") + "SELECT email_id, sender AS address FROM mail",
    "x_address_list": using("mail") + """SELECT email_id, array_to_string(list_filter(
 list_transform(range(1, len(a) + 1), lambda i: CASE WHEN list_position(a, a[i]) = i THEN a[i] END),
 lambda x: x IS NOT NULL AND x <> ''), '|') AS addresses
FROM (SELECT email_id, string_split(concat_ws(',', receivers_csv, cc_csv, sender, receivers_csv), ',') AS a FROM mail)""",
    "x_norm_subject": using("mail") + f"""SELECT email_id, {norm_subject('subject')} AS subject,
 {norm_subject("' RE:re: FWD:' || chr(9) || 'fw:  ' || subject || '  ' || chr(10) || ' x  Re: kept '")} AS stacked FROM mail""",
    "x_rfc2822_date": using("mail") + """SELECT email_id, CASE email_id % 9 WHEN 2 THEN date_trunc('second', sent_at) - INTERVAL 2 HOUR
 WHEN 3 THEN date_trunc('second', sent_at) + INTERVAL 330 MINUTE WHEN 4 THEN NULL
 WHEN 5 THEN date_trunc('second', sent_at) + INTERVAL 5 HOUR
 ELSE date_trunc('second', sent_at) END AS sent FROM mail""",
    "x_message_id": using("mail") + "SELECT email_id, message_id FROM mail",
    "x_snippet": f"SELECT doc_id, {truncate('s', 200)} AS snippet FROM (SELECT doc_id, {collapse(_RAW)} AS s FROM documents)",
    "x_html_to_text": f"SELECT page_id, {collapse(f"regexp_replace({_DECODED}, '<[^>]+>', ' ', 'g')")} AS text FROM pages",
    "x_clean_body": f"SELECT doc_id, {collapse('text')} AS text FROM documents",
    "x_truncate": f"SELECT doc_id, {truncate('text', 500)} AS text FROM documents",
    "x_extractive_summary": using("emails") + "SELECT id, summary FROM emails",
    "x_embedding_text": using("emails") + f"""SELECT id, 'Subject: ' || subject || chr(10) || 'From: ' || sender || chr(10)
 || 'Body: ' || {truncate('body_text', 3000)}
 || CASE WHEN in_reply_to IS NOT NULL THEN chr(10) || 'Summary: ' || summary ELSE '' END AS document FROM emails""",
}
