"""Keyword search: words, stems, postings, relevance, fuzzy terms."""

from __future__ import annotations

from oracle.base import norm_subject, using

QUERY = "Topic 7 thereader@example.com tion"
MISSPELT = "topc 7 theer"

# Stand-ins for separators inside a word while words are cut out.
_LETTER_JOINTS = ((".", ""), ("'", ""), (":", ""))
_DIGIT_JOINTS = ((".", ""), (",", ""), (";", ""))
_STANDINS = ""


def _joined(x: str) -> str:
    for kind, joints in ((r"\p{L}", _LETTER_JOINTS), (r"\p{N}", _DIGIT_JOINTS)):
        for mark, standin in joints:
            mark = "''" if mark == "'" else mark
            for _ in range(2):  # neighbouring joints share a letter, so a second pass is needed
                x = f"regexp_replace({x}, '({kind})[{mark}]({kind})', '\\1{standin}\\2', 'g')"
    return x


_IN_WORD = r"\p{L}\p{N}\p{M}_\x{E000}-\x{E004}"


def _plain(x: str) -> str:
    return f"translate({x}, '{_STANDINS}', '.'':,;')"


def word_list(x: str, lower: bool = True) -> str:
    found = f"regexp_extract_all({_joined(f'lower({x})' if lower else x)}, '[{_IN_WORD}]+')"
    return f"list_transform({found}, lambda w: {_plain('w')})"


def _runs(x: str) -> str:
    """Words and what stands between them, in turn; together they are the whole text."""
    found = f"regexp_extract_all({_joined(x)}, '[{_IN_WORD}]+|[^{_IN_WORD}]+')"
    return f"list_transform({found}, lambda w: {_plain('w')})"


FOLD = "replace(strip_accents(token), 'ß', 'ss')"

_FIELDS = " UNION ALL ".join(
    f"SELECT id, '{field}' AS field, {column} AS text FROM emails WHERE coalesce({column}, '') <> ''"
    for field, column in (("subject", "subject"), ("body_text", "body_text"), ("summary", "summary"), ("sender_text", "sender")))
_LISTS = f"SELECT id, field, {word_list('text')} AS l FROM field_rows"
_WORDS = "SELECT id, field, CAST(len(l) AS BIGINT) AS dl, unnest(l) AS token FROM lists"

_V, _C = "[aeiouy]", "[^aeiouy]"
_M0, _M1 = f"^{_C}*{_V}+{_C}", f"^{_C}*{_V}+{_C}+{_V}+{_C}"
_TWO = """ational ate tional tion enci ence anci ance izer ize bli ble alli al entli ent eli e ousli ous ization ize ation ate
ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble logi log""".split()
_THREE = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_FOUR = "al|ance|ence|er|ic|able|ible|ant|ement|ment|ent|ion|ou|ism|ate|iti|ous|ive|ize"


def _is(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def _less(x: str, n: str) -> str:
    return f"substr({x}, 1, length({x}) - {n})"


def _suffix_step(rules: list[tuple[str, str]], source: str) -> str:
    pattern = "|".join(a for a, _ in rules)
    new = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in rules)
    base = _less("w", "length(sx)")
    return (f"SELECT token, lg, CASE WHEN lg AND sx <> '' AND {_is(base, _M0)} THEN {base} || CASE sx {new} END ELSE w END AS w "
            f"FROM (SELECT *, regexp_extract(w, '({pattern})$', 1) AS sx FROM {source})")


def stems(source: str) -> dict[str, str]:
    """CTEs ending in ``stems(token, term)`` for the distinct words of ``source``."""
    two = list(zip(_TWO[::2], _TWO[1::2]))
    fixed = (
        f"CASE WHEN {_is('c', '(?:at|bl|iz)$')} THEN c || 'e' "
        f"WHEN length(c) > 1 AND lower(right(c, 1)) = lower(substr(c, length(c) - 1, 1)) AND {_is('c', _C + '$')} "
        f"THEN CASE WHEN {_is('c', '[lsz]$')} THEN c ELSE {_less('c', '1')} END "
        f"WHEN {_is('c', f'^{_C}+{_V}[^aeiouywxY]$')} THEN c || 'e' ELSE c END")
    base = _less("w", "length(sx)")
    short = _less("w", "1")
    return {
        "p0": f"SELECT DISTINCT token, {FOLD} AS w FROM {source}",
        "p1": r"""SELECT token, length(w) > 2 AS lg, CASE WHEN length(w) > 2 THEN regexp_replace(regexp_replace(
 regexp_replace(w, '^y', 'Y'), '([aeiou])y', '\1Y', 'g'), 'yy', 'yY', 'g') ELSE w END AS w FROM p0""",
        "p2": r"""SELECT token, lg, CASE WHEN lg THEN regexp_replace(w, '(?:(ss)es|(i)es|([^s])s)$', '\1\2\3') ELSE w END AS w FROM p1""",
        "p3": f"""SELECT token, lg, CASE WHEN NOT lg THEN w
 WHEN ends_with(w, 'eed') THEN CASE WHEN {_is(_less('w', '3'), _M0)} THEN {_less('w', '1')} ELSE w END
 WHEN c <> '' AND {_is('c', _V)} THEN {fixed} ELSE w END AS w
FROM (SELECT *, CASE WHEN ends_with(w, 'ed') THEN {_less('w', '2')} WHEN ends_with(w, 'ing') THEN {_less('w', '3')} ELSE '' END AS c FROM p2)""",
        "p4": f"SELECT token, lg, CASE WHEN lg AND {_is('w', f'{_V}.*[yY]$')} THEN {short} || 'i' ELSE w END AS w FROM p3",
        "p5": _suffix_step(two, "p4"),
        "p6": _suffix_step(_THREE, "p5"),
        "p7": f"""SELECT token, lg, CASE WHEN lg AND sx <> '' AND (sx <> 'ion' OR {_is(base, '[st]$')}) AND {_is(base, _M1)}
 THEN {base} ELSE w END AS w FROM (SELECT *, regexp_extract(w, '({_FOUR})$', 1) AS sx FROM p6)""",
        "p8": f"""SELECT token, lg, CASE WHEN lg AND ends_with(w, 'e') AND ({_is(short, _M1)} OR ({_is(short, _M0)}
 AND NOT {_is(short, f'{_C}{_V}[^aeiouywxY]$')})) THEN {short} ELSE w END AS w FROM p7""",
        "stems": f"""SELECT token, replace(CASE WHEN lg AND ends_with(w, 'll') AND {_is('w', _M1)} THEN {short} ELSE w END,
 'Y', 'y') AS term FROM p8""",
    }


_TOKEN_ROWS = """SELECT w.id, w.field, w.dl, s.term, count(*) AS tf FROM words w JOIN stems s USING (token)
GROUP BY w.id, w.field, w.dl, s.term"""
_WORD_CTES = {"field_rows": _FIELDS, "lists": _LISTS, "words": _WORDS}
COUNTED = using("emails", **_WORD_CTES, **stems("words"), token_rows=_TOKEN_ROWS)

_POSTINGS = """SELECT field, term, id, tf, dl FROM token_rows
UNION ALL SELECT 'sender', sender, id, CAST(1 AS BIGINT), CAST(1 AS BIGINT) FROM emails"""
_VOCAB = "SELECT field, term, count(*) AS df FROM postings GROUP BY field, term"
_STATS = """SELECT field, count(*) AS n, avg(len(l)) AS avgdl FROM lists WHERE len(l) > 0 GROUP BY field
UNION ALL SELECT 'sender', count(*), 1.0 FROM emails"""


# The built-in distance also lets a letter be put between two swapped ones; such pairs are more than two edits here.
_PROPER = """(levenshtein(qt.term, vocab.term) <= 2 OR damerau_levenshtein(qt.term, vocab.term) < 2 OR
 len(list_filter(range(1, length(qt.term)), lambda i: len(list_filter([-1, 0, 1], lambda s: i + s >= 1
  AND substr(vocab.term, i + s, 2) = substr(qt.term, i + 1, 1) || substr(qt.term, i, 1)
  AND damerau_levenshtein(substr(qt.term, 1, i - 1), substr(vocab.term, 1, i + s - 1))
    + damerau_levenshtein(substr(qt.term, i + 2), substr(vocab.term, i + s + 2)) <= 1)) > 0)) > 0)"""


def _search(queries: str, fuzzy: bool, **more: str) -> str:
    """All stages of a search over the relation ``queries(query_id, query)``."""
    everything = "SELECT token FROM words UNION ALL SELECT token FROM query_words"
    expanded = f"""SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY query_id, field, pos
 ORDER BY weight DESC, term) AS r FROM (
 SELECT q.query_id, q.field, q.pos, q.term AS query_term, v.term, d AS edits,
  CASE WHEN d = 0 THEN 1.0 ELSE 1.0 - d / least(length(q.term), length(v.term)) END AS weight
 FROM (SELECT qt.*, vocab.term AS vt, damerau_levenshtein(qt.term, vocab.term) AS d FROM query_terms qt
   JOIN vocab ON vocab.field = qt.field AND abs(length(vocab.term) - length(qt.term)) <= 2
    AND damerau_levenshtein(qt.term, vocab.term) <= 2 AND {_PROPER}) q, LATERAL (SELECT q.vt AS term) v
 WHERE d <= CASE WHEN length(q.term) <= 2 THEN 0 WHEN length(q.term) <= 5 THEN 1 ELSE 2 END)) WHERE r <= 50"""
    exact = "SELECT query_id, field, pos, term AS query_term, term, 0 AS edits, 1.0 AS weight FROM query_terms"
    return using(
        "emails", **_WORD_CTES, queries=queries,
        query_lists=f"SELECT query_id, {word_list('query')} AS l FROM queries",
        query_words="SELECT query_id, unnest(range(len(l))) AS pos, unnest(l) AS token FROM query_lists",
        all_words=everything, **stems("all_words"), token_rows=_TOKEN_ROWS, postings=_POSTINGS, vocab=_VOCAB, stats=_STATS,
        query_terms="""SELECT query_id, field, pos, term FROM query_words JOIN stems USING (token),
 (VALUES ('subject'), ('body_text'), ('summary'), ('sender_text')) f(field)
 UNION ALL SELECT query_id, 'sender', 0, query FROM queries""",
        expanded=expanded if fuzzy else exact,
        weighted="""SELECT query_id, field, term, sum(weight) * ln(1 + (n - df + 0.5) / (df + 0.5)) AS tw, avgdl
 FROM expanded JOIN vocab USING (field, term) JOIN stats USING (field) GROUP BY query_id, field, term, n, df, avgdl""",
        field_scores="""SELECT query_id, id, field, sum(tw * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
 FROM postings JOIN weighted USING (field, term) GROUP BY query_id, id, field""",
        best="""SELECT query_id, id, round(max(score * CASE field WHEN 'subject' THEN 4 WHEN 'summary' THEN 2 ELSE 1 END), 6) AS score
 FROM field_scores GROUP BY query_id, id""", **more)


def _snippets(hits: str) -> dict[str, str]:
    """CTEs ending in ``shown(id, score, total, snippet)`` for ``hits(id, score, total)``: cut around the first matched word, all of them marked."""
    return {
        "hits": hits,
        "hf": "SELECT f.* FROM field_rows f JOIN hits USING (id) WHERE field <> 'sender_text'",
        "hw": f"SELECT id, field, unnest({word_list('text', lower=False)}) AS word FROM hf",
        "mw": """SELECT id, field, list(DISTINCT word) AS words FROM hw JOIN stems ON stems.token = lower(word)
 JOIN (SELECT DISTINCT field, term FROM expanded) USING (field, term) GROUP BY id, field""",
        "cut": f"""SELECT id, field, words, text, CASE field WHEN 'body_text' THEN 150 WHEN 'summary' THEN 120 END AS size, {_runs('text')} AS r
 FROM hf JOIN mw USING (id, field)""",
        "placed": """SELECT *, 1 + coalesce(list_sum(list_transform(r[1:list_position(list_transform(r, lambda x: list_contains(words, x)), true) - 1],
 lambda x: length(x))), 0) AS spot FROM cut""",
        "parts": """SELECT *, CASE WHEN size IS NULL THEN text
 ELSE substr(text, greatest(1, least(spot - size // 3, length(text) - size + 1))::BIGINT, size) END AS part FROM placed""",
        "marked": f"""SELECT id, field, array_to_string(list_transform({_runs('part')},
 lambda x: CASE WHEN list_contains(words, x) THEN '<em>' || x || '</em>' ELSE x END), '') AS m FROM parts""",
        "shown": """SELECT h.id, h.score, h.total, coalesce(b.m, s.m, t.m, '') AS snippet FROM hits h
 LEFT JOIN marked b ON b.id = h.id AND b.field = 'body_text' LEFT JOIN marked s ON s.id = h.id AND s.field = 'summary'
 LEFT JOIN marked t ON t.id = h.id AND t.field = 'subject'""",
    }


def _one(text: str) -> str:
    return f"SELECT 0 AS query_id, '{text}' AS query"


_SENDER_IDS = """SELECT id FROM emails WHERE contains(sender, '{0}') UNION
SELECT id FROM token_rows WHERE field = 'sender_text' AND term = '{0}'"""

SQL = {
    "kw_tokens": using("emails", **_WORD_CTES, body="SELECT * FROM words WHERE field = 'body_text'", **stems("body")) + """
SELECT token, term, count(*) AS count FROM body JOIN stems USING (token) GROUP BY token, term""",
    "kw_fold": using("emails", **_WORD_CTES) + f"""SELECT {FOLD} AS term, CAST(sum(n) AS BIGINT) AS count, count(*) AS spellings
FROM (SELECT token, count(*) AS n FROM words WHERE field = 'body_text' GROUP BY token) GROUP BY 1""",
    "kw_field_rows": using("emails", field_rows=_FIELDS) + "SELECT id, field, text FROM field_rows",
    "kw_postings": COUNTED[:-1] + f", postings AS ({_POSTINGS}) SELECT field, term, id, tf, dl FROM postings",
    "kw_exact_terms": using("threaded") + """SELECT 'id' AS field, id::VARCHAR AS term, id FROM threaded
UNION ALL SELECT 'archive_id', archive_id, id FROM threaded WHERE archive_id IS NOT NULL
UNION ALL SELECT 'thread_id', thread_id, id FROM threaded UNION ALL SELECT 'message_id', message_id, id FROM threaded WHERE message_id IS NOT NULL
UNION ALL SELECT 'sender', sender, id FROM threaded WHERE sender IS NOT NULL
UNION ALL SELECT 'subject.exact', subject, id FROM threaded WHERE length(subject) <= 1024
UNION ALL SELECT DISTINCT 'receivers', unnest(receivers), id FROM threaded UNION ALL SELECT DISTINCT 'cc', unnest(cc), id FROM threaded""",
    "kw_vocab_df": COUNTED[:-1] + f", postings AS ({_POSTINGS}) {_VOCAB}",
    "kw_field_stats": using("emails", **_WORD_CTES, stats=_STATS) + "SELECT field, n, round(avgdl, 6) AS avgdl FROM stats",
    "kw_bm25_field": _search(_one(QUERY), False) + "SELECT id, field, round(score, 6) AS score FROM field_scores",
    "kw_best_fields": _search(_one(QUERY), False) + "SELECT id, score FROM best",
    "kw_fuzzy_terms": _search(_one(MISSPELT), True) + """SELECT field, query_term, term, round(weight, 6) AS weight,
 CAST(edits AS BIGINT) AS edits FROM expanded""",
    "kw_fuzzy_search": _search(
        f"SELECT row_number() OVER () AS query_id, query FROM (SELECT DISTINCT {norm_subject('subject')} AS query FROM emails) WHERE query <> ''",
        True) + """SELECT query, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)
 AS rank FROM best) JOIN queries USING (query_id) WHERE rank <= 10""",
    "kw_sender_filter": COUNTED + _SENDER_IDS.format("user12"),
    "kw_page_total": _search(_one(QUERY), False) + """
SELECT id, score, CAST(NULL AS BIGINT) AS total FROM (SELECT id, score FROM best ORDER BY score DESC, id LIMIT 15 OFFSET 15)
UNION ALL SELECT NULL, NULL, count(*) FROM best""",
    "kw_search": _search(_one(QUERY), True, **_snippets("""SELECT b.id, b.score, count(*) OVER () AS total FROM best b
 JOIN emails e ON e.id = b.id WHERE contains(e.sender, 'user1')
 AND e.sent_at >= TIMESTAMP '2024-01-10' AND e.sent_at <= TIMESTAMP '2024-01-20 12:00:00' ORDER BY b.score DESC, b.id LIMIT 20""")) + """
SELECT e.id, e.subject, e.sender, e.sent_at, e.summary, x.snippet, x.score, x.total FROM shown x JOIN emails e ON e.id = x.id""",
    "kw_highlight": _search(_one(QUERY), True, **_snippets("SELECT id, score, 0 AS total FROM best ORDER BY score DESC, id LIMIT 20")) + """
SELECT id, score, snippet FROM shown""",
}
