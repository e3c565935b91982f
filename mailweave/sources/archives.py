"""Archive and message sources: admission, ZIP scan, message parsing."""

from __future__ import annotations

import email
import email.policy
import io
import zipfile
from collections import Counter
from collections.abc import Iterator
from email.utils import parseaddr, parsedate_to_datetime
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.functions.headers import UNKNOWN_SENDER, message_id
from mailweave.functions.html import html_to_text
from mailweave.functions.text import clean_body, extractive_summary, strip
from mailweave.operators.skew import spread

# Fixed values of the ingest rules.
MAX_ARCHIVE_BYTES = 500 * 1024 * 1024
MAIL_SUFFIXES = (".eml", ".msg", ".txt", ".mime")

# First bytes of a compound document, the container of Outlook messages; there is no decoder for these.
COMPOUND_DOCUMENT = bytes.fromhex("d0cf11e0a1b11ae1")

# A worker hands rows back to Spark once this much message text has gathered.
CHUNK_BYTES = 16 * 1024 * 1024

_RAW_FIELDS = (
    "error string, message_id string, in_reply_to string, references_header string, sender string, "
    "receivers array<string>, cc array<string>, subject string, text_body string, html_body string, "
    "sent_at timestamp"
)
RAW_NAMES = [part.split()[0] for part in _RAW_FIELDS.split(", ")]
SCAN_SCHEMA = f"archive_path string, entry_path string, {_RAW_FIELDS}"


def archive_files(spark: SparkSession, path: str, max_bytes: int = MAX_ARCHIVE_BYTES) -> DataFrame:
    """Admitted archive files; name and size are tested on the listing, before any content is read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return listing.filter(admitted(max_bytes))


def refused(files: DataFrame, max_bytes: int = MAX_ARCHIVE_BYTES) -> DataFrame:
    """``(source, error)`` of the files that are not admitted; their content is not read."""
    wrong_name = ~F.endswith(F.lower("path"), F.lit(".zip"))
    return files.filter(~admitted(max_bytes)).select(
        F.col("path").alias("source"), F.when(wrong_name, "not a ZIP archive by its name").otherwise("archive is too large").alias("error"))


def admitted(max_bytes: int = MAX_ARCHIVE_BYTES):
    return F.endswith(F.lower("path"), F.lit(".zip")) & (F.col("length") <= max_bytes)


def _address_list(message, header: str) -> list[str]:
    """Distinct lower-case addresses; commas inside quoted names do not part them, semicolons do."""
    found = []
    for value in message.get_all(header, []):
        groups = getattr(value, "addresses", None)
        listed = [a.addr_spec for a in groups] if groups and ";" not in str(value) else [
            parseaddr(piece)[1] for piece in str(value).replace(";", ",").split(",")]
        found.extend(a.lower() for a in listed if a)
    return list(dict.fromkeys(found))


REMEMBERED_HEADERS = 256
REMEMBERED_CHARS = 4096  # longer headers are parsed anew each time


@lru_cache(REMEMBERED_HEADERS)
def _parsed_header(name: str, value: str):
    return email.policy.default.header_fetch_parse(name, value)


class _Policy(email.policy.EmailPolicy):
    """The default policy, which parses a header each time that it is asked for, some 25 times a message; here it is parsed once."""

    def header_fetch_parse(self, name, value):
        short = type(value) is str and len(value) <= REMEMBERED_CHARS
        return _parsed_header(name, value) if short else super().header_fetch_parse(name, value)


POLICY = _Policy()


def _decode(raw: bytes) -> dict:
    """Message bytes to raw values; text is cleaned later by column expressions."""
    if raw.startswith(COMPOUND_DOCUMENT):
        raise ValueError("compound document, not an internet message")
    message = email.message_from_bytes(raw, policy=POLICY)

    def header(name):
        value = message.get(name)
        return None if value is None else str(value)

    text = markup = None
    for part in message.walk():
        if part.is_multipart():
            continue
        kind = part.get_content_type()
        single = part is message
        if kind == "text/html" and not markup:
            markup = part.get_content()
        elif (kind == "text/plain" or single) and not (text or "").strip():
            content = part.get_content()
            if not isinstance(content, str):
                raise ValueError(f"no readable text in {kind}")
            text = content
    sent = None
    date = header("Date")
    if date:
        try:
            sent = pd.Timestamp(parsedate_to_datetime(date))
            sent = sent.tz_localize("UTC") if sent.tzinfo is None else sent.tz_convert("UTC")
        except (TypeError, ValueError, IndexError, OverflowError):
            sent = None
    return {
        "message_id": header("Message-ID"), "in_reply_to": header("In-Reply-To"),
        "references_header": header("References"), "sender": parseaddr((header("From") or "").strip())[1],
        "receivers": _address_list(message, "To"), "cc": _address_list(message, "Cc"), "subject": header("Subject"),
        "text_body": text, "html_body": markup, "sent_at": sent,
    }


def parse(raw: bytes) -> dict:
    try:
        return {"error": None, **_decode(raw)}
    except Exception as problem:  # one bad message must not end the task
        return {"error": f"{type(problem).__name__}: {problem}", "receivers": [], "cc": []}


def frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    out["sent_at"] = pd.to_datetime(out["sent_at"], utc=True)
    text = [c for c in columns if c not in ("sent_at", "receivers", "cc")]
    out[text] = out[text].astype(object).where(out[text].notna(), None)
    return out


def is_mail(name: str) -> bool:
    return name.lower().endswith(MAIL_SUFFIXES)


def why_not_opened(problem: Exception) -> str:
    return "not a valid ZIP archive" if isinstance(problem, zipfile.BadZipFile) else f"{type(problem).__name__}: {problem}"


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["archive_path", "entry_path", *RAW_NAMES]
    for batch in batches:
        rows, held = [], 0
        for path, content in zip(batch["path"], batch["content"]):
            try:
                archive = zipfile.ZipFile(io.BytesIO(content))
            except Exception as problem:  # a damaged file must not end the task
                rows.append({"archive_path": path, "error": why_not_opened(problem), "receivers": [], "cc": []})
                continue
            seen = Counter()
            for entry in sorted((i for i in archive.infolist() if not i.is_dir()), key=lambda i: i.filename):
                if not is_mail(entry.filename):
                    continue
                # A name may come again in one archive: later ones are numbered, so that ids differ.
                seen[entry.filename] += 1
                name = entry.filename if seen[entry.filename] == 1 else f"{entry.filename}#{seen[entry.filename]}"
                try:
                    raw = archive.read(entry)
                    parsed = parse(raw)
                except Exception as problem:  # damaged member
                    raw, parsed = b"", {"error": f"{type(problem).__name__}: {problem}", "receivers": [], "cc": []}
                rows.append({"archive_path": path, "entry_path": name, **parsed})
                held += len(raw)
                if held > CHUNK_BYTES:
                    yield frame(rows, columns)
                    rows, held = [], 0
        if rows:
            yield frame(rows, columns)


def scan_archives(files: DataFrame) -> DataFrame:
    """Members of small archives at hand, one row per mail file, decoded in the same pass; each archive is one row with its content.

    ``files`` has the columns of Spark's binaryFile source.  An archive that cannot be opened gives one row with
    a null ``entry_path`` and its error.  Content goes from the scan to the workers; the driver sees none of it.  Archives that lie in
    files are better read by range (:mod:`mailweave.sources.archive_ranges`).
    """
    return files.select("path", "content").mapInPandas(_scan, SCAN_SCHEMA)


def parse_messages(messages: DataFrame, keep: tuple[str, ...] = ("id",), raw: str = "raw") -> DataFrame:
    """Decode a column of message bytes next to the columns of ``keep``, of which the first is unique.

    Decoding is the costly part, so a small input is spread over all cores by that column first.  What a worker holds decoded is
    bounded by ``CHUNK_BYTES`` of messages and one more.
    """
    kept = messages.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def run(batches):
        for batch in batches:
            ends = np.cumsum([len(r or b"") for r in batch[raw]]) // CHUNK_BYTES
            for _, part in batch.groupby(ends):
                decoded = frame([parse(bytes(r)) for r in part[raw]], RAW_NAMES)
                yield pd.concat([part[list(keep)].reset_index(drop=True), decoded], axis=1)

    return spread(messages.select(*keep, raw), keep[0]).mapInPandas(run, f"{schema}, {_RAW_FIELDS}")


def accepted(decoded: DataFrame) -> DataFrame:
    """Clean the decoded values; rows with an error are left to :func:`rejected`."""
    keep = [c for c in decoded.columns if c not in RAW_NAMES]
    plain = clean_body(F.col("text_body"))
    markup = F.when(F.col("html_body") != "", F.col("html_body"))
    return decoded.filter(F.col("error").isNull()).select(
        *keep, message_id(F.col("message_id")).alias("message_id"), message_id(F.col("in_reply_to")).alias("in_reply_to"),
        "references_header",
        F.when(F.col("sender") != "", F.lower("sender")).otherwise(UNKNOWN_SENDER).alias("sender"),
        "receivers", "cc", strip(F.coalesce("subject", F.lit(""))).alias("subject"),
        F.when(plain != "", plain).otherwise(html_to_text(markup)).alias("body_text"),
        markup.alias("body_html"), "sent_at",
    )


def rejected(decoded: DataFrame) -> DataFrame:
    keep = [c for c in decoded.columns if c not in RAW_NAMES]
    return decoded.filter(F.col("error").isNotNull()).select(*keep, "error")


def archive_id(path=None):
    """Archives are identified by their path, so a repeated run gives the same ids."""
    return F.sha2(F.col("archive_path") if path is None else path, 256)


def emails_from_scan(scanned: DataFrame) -> DataFrame:
    """Fact-table rows of scanned archive members."""
    return accepted(scanned).select(
        F.sha2(F.concat_ws("\u001f", archive_id(), "entry_path"), 256).alias("id"), archive_id().alias("archive_id"),
        "message_id", "in_reply_to", "references_header", "sender", "receivers", "cc", "subject", "body_text",
        "body_html", "sent_at", extractive_summary(F.col("subject"), F.col("body_text")).alias("summary"),
        F.element_at(F.split("entry_path", "/"), -1).alias("source_file"), "entry_path",
        F.current_timestamp().alias("created_at"),
    )
