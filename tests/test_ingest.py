"""Archives written to disk, ingested in batch and as a stream."""

import io
import zipfile
from datetime import datetime

import pytest

from mailweave.operators import keyword as K
from mailweave.operators.ledger import archive_ledger
from mailweave.sources import archives as S
from mailweave.sources.tables import append_emails, read_emails
from mailweave.streaming import ingest

PLAIN = b"""From: "Lee, Ann" <Ann@X.org>\r
To: "Doe, Bob" <bob@x.org>, carol@x.org; DAN@x.org, bob@x.org\r
Subject: =?utf-8?q?Caf=C3=A9?= plans \r
Message-ID: <one@x.org>\r
References: <zero@x.org>\r
 <half@x.org>\r
Date: Mon, 1 Jan 2024 10:00:00 +0200\r
\r
Hello   there.\r
Second  line.\r
"""
BOTH = b"""From: bob@x.org\r
To: ann@x.org\r
Subject: Re: Cafe\r
In-Reply-To: <one@x.org>\r
MIME-Version: 1.0\r
Content-Type: multipart/alternative; boundary=B\r
\r
--B\r
Content-Type: text/plain; charset=utf-8\r
Content-Transfer-Encoding: quoted-printable\r
\r
Na=C3=AFve text\r
--B\r
Content-Type: text/html; charset=utf-8\r
\r
<p>other</p>\r
--B--\r
"""
HTML_PART = BOTH.replace(b"text/plain", b"image/png").replace(b"Re: Cafe", b"only markup")
HTML = b"From: a@x.org\nSubject: h\nContent-Type: text/html\nDate: not a date\n\n<b>&lt;i&gt;Bold&lt;/i&gt;</b> move&#33;\n"
BARE = b"just some words without any header\n"


def pack(path, members):
    with zipfile.ZipFile(path, "w") as target:
        for name, raw in members.items():
            target.writestr(name, raw)


@pytest.fixture
def inbox(tmp_path):
    box = tmp_path / "inbox"
    (box / "deep").mkdir(parents=True)
    pack(box / "good.zip", {
        "a/1.eml": PLAIN, "b/1.EML": BOTH, "c.mime": HTML, "d.txt": BARE, "e/photo.png": b"xx", "f.msg": S.COMPOUND_DOCUMENT + b"..",
        "g.eml": HTML_PART, "dir.eml/": b""})
    pack(box / "deep" / "empty.ZIP", {})
    (box / "broken.zip").write_bytes(b"not a zip at all")
    (box / "notes.tar").write_bytes(b"..")
    (box / "big.zip").write_bytes(b"0" * 50_000)
    return box


def test_batch_ingest(spark, inbox):
    files = S.archive_files(spark, str(inbox), max_bytes=40_000)
    names = sorted(r.path.rsplit("/", 1)[1] for r in files.select("path").collect())
    assert names == ["broken.zip", "empty.ZIP", "good.zip"]
    scanned = S.scan_archives(files)
    rows = {r.source_file + "|" + r.entry_path: r for r in S.emails_from_scan(scanned).collect()}
    assert set(rows) == {"1.eml|a/1.eml", "1.EML|b/1.EML", "c.mime|c.mime", "d.txt|d.txt", "g.eml|g.eml"}
    one = rows["1.eml|a/1.eml"]
    assert (one.sender, one.subject, one.message_id, one.in_reply_to) == ("ann@x.org", "Café plans", "one@x.org", None)
    assert one.receivers == ["bob@x.org", "carol@x.org", "dan@x.org"] or set(one.receivers) >= {"bob@x.org", "carol@x.org"}
    assert one.body_text == "Hello there. Second line." and one.sent_at == datetime(2024, 1, 1, 8)
    assert one.references_header.split() == ["<zero@x.org>", "<half@x.org>"]
    assert one.summary == "Café plans. Hello there."
    two = rows["1.EML|b/1.EML"]
    assert (two.body_text, two.body_html.strip(), two.in_reply_to, two.sent_at) == ("Naïve text", "<p>other</p>", "one@x.org", None)
    assert (rows["c.mime|c.mime"].body_text, rows["c.mime|c.mime"].sent_at) == ("Bold move!", None)
    assert rows["g.eml|g.eml"].body_text == "other"
    assert (rows["d.txt|d.txt"].sender, rows["d.txt|d.txt"].receivers) == ("unknown@local", [])
    assert len({r.id for r in rows.values()}) == 5
    again = {r.id for r in S.emails_from_scan(S.scan_archives(files)).collect()}
    assert again == {r.id for r in rows.values()}
    bad = {(r.archive_path.rsplit("/", 1)[1], r.entry_path): r.error for r in S.rejected(scanned).collect()}
    assert set(bad) == {("good.zip", "f.msg"), ("broken.zip", None)}


def test_ledger(spark, inbox):
    from pyspark.sql import functions as F

    files = S.archive_files(spark, str(inbox), max_bytes=40_000)
    listed = files.select(S.archive_id(F.col("path")).alias("archive_id"), F.element_at(F.split("path", "/"), -1).alias("filename"))
    members = S.scan_archives(files).withColumn("archive_id", S.archive_id())
    got = {r.filename: (r.status, r.total_emails, r.processed_emails) for r in archive_ledger(listed, members).collect()}
    assert got == {"good.zip": ("completed", 6, 5), "empty.ZIP": ("completed", 0, 0), "broken.zip": ("failed", 0, 0)}


def test_admission_reads_no_content(spark, inbox):
    plan = S.archive_files(spark, str(inbox)).select("path")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_stream_takes_new_archives_once_and_refreshes_threads(spark, inbox, tmp_path):
    root = str(tmp_path / "store")
    for _ in range(2):  # a second start finds nothing new
        ingest.start(ingest.archive_stream(spark, str(inbox)), root, ingest.Archives(40_000)).awaitTermination()
    assert ingest.read_table(spark, root, "emails").count() == 5
    errors = {r.source.rsplit("/", 1)[1]: r.error for r in ingest.read_table(spark, root, "rejects").collect()}
    assert len(errors) == 4 and "archive is too large" in errors.values() and "not a ZIP archive by its name" in errors.values()
    pack(inbox / "later.zip", {"x.eml": PLAIN.replace(b"one@x.org", b"two@x.org")})
    pack(inbox / "good2.zip", {"y.eml": BOTH.replace(b"bob@x.org", b"zed@x.org")})
    ingest.start(ingest.archive_stream(spark, str(inbox)), root, ingest.Archives(40_000)).awaitTermination()
    mails = ingest.read_table(spark, root, "emails")
    assert mails.count() == 7 and mails.select("id").distinct().count() == 7
    threads = ingest.current_threads(spark, root)
    assert threads.agg({"email_count": "sum"}).first()[0] == 7
    assert threads.count() == mails.select("thread_id").distinct().count()
    assert ingest.read_table(spark, root, "postings").select("id").distinct().count() == 7
    assert ingest.read_table(spark, root, "vectors").count() == 7
    ledger = {r.filename: r.status for r in ingest.read_table(spark, root, "archives").collect()}
    assert ledger == {"good.zip": "completed", "empty.ZIP": "completed", "broken.zip": "failed", "later.zip": "completed", "good2.zip": "completed"}
    # The index of three batches is that of one build over all mails.
    stored, built = ingest.stored_index(spark, root), K.Index.of(mails)
    assert sorted(map(str, stored.vocab.drop("length").collect())) == sorted(map(str, built.vocab.collect()))
    assert sorted(map(str, stored.stats.collect())) == sorted(map(str, built.stats.collect()))
    assert not (tmp_path / "store" / "decoded" / "batch=0").exists()


def test_refresh_reads_touched_folders_only(spark, inbox, tmp_path):
    root = str(tmp_path / "store")
    ingest.start(ingest.archive_stream(spark, str(inbox)), root, ingest.Archives(40_000)).awaitTermination()
    buckets = sorted(r.bucket for r in ingest.read_table(spark, root, "emails").select("bucket").distinct().collect())
    assert len(buckets) > 1
    touched = ingest.touched_mails(spark, root, 0, buckets[:1])
    plan = touched._jdf.queryExecution().executedPlan().toString()
    assert touched.count() and "bucket" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]


def test_long_values_and_repeated_names(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    pack(box / "a.zip", {"long.eml": PLAIN.replace(b"one@x.org", b"o" * 600 + b"@x.org"), "ok.eml": PLAIN})
    with zipfile.ZipFile(box / "twice.zip", "w") as target, pytest.warns(UserWarning):
        target.writestr("same.eml", PLAIN)
        target.writestr("same.eml", BOTH)
    root = str(tmp_path / "store")
    ingest.start(ingest.archive_stream(spark, str(box)), root).awaitTermination()
    mails = ingest.read_table(spark, root, "emails")
    assert mails.count() == mails.select("id").distinct().count() == 3
    assert [r.error for r in ingest.read_table(spark, root, "rejects").collect()] == ["message_id is longer than 512"]


def test_batch_repeated_after_a_failure_leaves_no_doubles(spark, inbox, tmp_path):
    root = str(tmp_path / "store")
    run = ingest.process_batch(root, ingest.Archives(40_000))
    files = S.archive_files(spark, str(inbox), max_bytes=40_000)
    run(files, 0)
    run(files, 0)
    assert ingest.read_table(spark, root, "emails").count() == 5


def test_sink_roundtrip(spark, inbox, tmp_path):
    mails = S.emails_from_scan(S.scan_archives(S.archive_files(spark, str(inbox), max_bytes=40_000)))
    append_emails(mails, str(tmp_path / "emails"))
    back = read_emails(spark, str(tmp_path / "emails"), like=mails)
    assert back.count() == 5 and back.columns[-1] == "archive_id"


def test_large_archive_is_handed_over_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "CHUNK_BYTES", 10)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as target:
        for i in range(5):
            target.writestr(f"{i}.eml", BARE)
    import pandas as pd

    pieces = list(S._scan(iter([pd.DataFrame({"path": ["p"], "content": [buffer.getvalue()]})])))
    assert [len(p) for p in pieces] == [1] * 5


def test_headers_are_parsed_once():
    raw = (b"From: A <a@x.org>\r\nTo: b@x.org\r\nSubject: s\r\nMIME-Version: 1.0\r\n"
           b"Content-Type: multipart/alternative; boundary=q\r\n\r\n--q\r\nContent-Type: text/plain\r\n\r\nhello\r\n"
           b"--q\r\nContent-Type: text/html\r\n\r\n<p>m</p>\r\n--q--\r\n")
    S._parsed_header.cache_clear()
    first = S.parse(raw)
    known = S._parsed_header.cache_info()
    assert known.misses <= 8 and known.hits > 10
    assert S.parse(raw) == first and S._parsed_header.cache_info().misses == known.misses
    assert first["error"] is None and first["text_body"].strip() == "hello" and first["receivers"] == ["b@x.org"]
