"""Archives read by range: directories first, then members dealt out by bytes, each read and inflated by its own task.

No archive is ever held whole.  A first pass opens every archive, reads its end record and central directory, and gives a row for each mail file
in it; neighbouring files of an archive are put together into slices of ``SLICE_BYTES``.  Slices, not archives, are what tasks take, so
one large archive is read by as many tasks as its bytes ask for, and a task holds one member and the rows not yet handed over.
Workers open files through Arrow's file systems: local or mounted paths, ``hdfs://``, ``s3://`` and the like.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweave.sources import archives as S

SLICE_BYTES = 16 * 1024 * 1024
LOCAL_HEADER = 30  # bytes
MEMBERS = (
    "archive_path string, slice int, entry_path string, name string, header_at long, packed long, plain long, method int, crc long, flags int, error string"
)


class RangeFile:
    """A file of any file system that workers reach, for readers that expect an ``OSError`` where a place lies before its start."""

    def __init__(self, path: str):
        from pyarrow import fs

        if path.startswith("file:"):
            path = "/" + path[5:].lstrip("/")
        system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        self.file = system.open_input_file(name)
        self.size = self.file.size()

    def seek(self, offset: int, whence: int = 0) -> int:
        at = offset + (0, self.tell(), self.size)[whence]
        if at < 0:
            raise OSError("a place before the start of the file")
        self.file.seek(at)
        return at

    def tell(self) -> int:
        return self.file.tell()

    def read(self, n: int | None = -1) -> bytes:
        return self.file.read() if n is None or n < 0 else self.file.read(n)

    def seekable(self) -> bool:
        return True

    def close(self) -> None:
        self.file.close()

    def __enter__(self) -> RangeFile:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def directory(path: str, slice_bytes: int = SLICE_BYTES) -> list[dict]:
    """A row for each mail file of an archive, in the order of names; one row with the error of an archive that cannot be opened."""
    try:
        with RangeFile(path) as file, zipfile.ZipFile(file) as archive:
            entries = [i for i in archive.infolist() if not i.is_dir() and S.is_mail(i.filename)]
    except Exception as problem:  # a damaged file must not end the task
        nothing = dict.fromkeys(("slice", "header_at", "packed", "plain", "method", "crc", "flags"), 0)
        return [{"archive_path": path, **nothing, "error": S.why_not_opened(problem)}]
    seen, names = Counter(), {}
    for entry in sorted(entries, key=lambda i: i.filename):
        # A name may come again in one archive: later ones are numbered, so that ids differ.
        seen[entry.filename] += 1
        names[id(entry)] = entry.filename if seen[entry.filename] == 1 else f"{entry.filename}#{seen[entry.filename]}"
    rows, held, part = [], 0, 0
    for entry in sorted(entries, key=lambda i: i.header_offset):
        size = max(entry.compress_size, entry.file_size)
        if held and held + size > slice_bytes:
            held, part = 0, part + 1
        held += size
        rows.append({"archive_path": path, "slice": part, "entry_path": names[id(entry)], "name": entry.filename, "header_at": entry.header_offset,
                     "packed": entry.compress_size, "plain": entry.file_size, "method": entry.compress_type, "crc": entry.CRC, "flags": entry.flag_bits})
    return rows


def members(files: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The mail files of admitted archives (``path``): where each one lies, and the slice that it belongs to."""
    columns = [c.split()[0] for c in MEMBERS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                rows = pd.DataFrame(directory(path, slice_bytes), columns=columns)
                yield rows.assign(**{c: rows[c].astype(object).where(rows[c].notna(), None) for c in ("entry_path", "name", "error")})

    # Paths alone are dealt out, so that archives are opened side by side.
    parts = files.sparkSession.sparkContext.defaultParallelism
    return files.select("path").repartition(parts, "path").mapInPandas(run, MEMBERS)


def read_member(file, row) -> bytes:
    """The content of one member, from its local header on: two reads, of which the first is 30 bytes."""
    if row.flags & 1:
        raise RuntimeError(f"File {row.name!r} is encrypted, password required for extraction")
    file.seek(row.header_at)
    head = file.read(LOCAL_HEADER)
    if len(head) < LOCAL_HEADER or head[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile("Bad magic number for file header")
    file.seek(row.header_at + LOCAL_HEADER + sum(struct.unpack_from("<HH", head, 26)))
    info = zipfile.ZipInfo(row.name)
    info.compress_type, info.compress_size, info.file_size, info.CRC, info.flag_bits = row.method, row.packed, row.plain, row.crc, row.flags
    return zipfile.ZipExtFile(io.BytesIO(file.read(row.packed)), "r", info).read()


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns, opened, at = ["archive_path", "entry_path", *S.RAW_NAMES], None, None
    for batch in batches:
        rows, held = [], 0
        for row in batch.itertuples(index=False):
            if row.error is not None:
                rows.append({"archive_path": row.archive_path, "error": row.error, "receivers": [], "cc": []})
                continue
            if at != row.archive_path:
                if opened is not None:
                    opened.close()
                opened, at = RangeFile(row.archive_path), row.archive_path
            try:
                raw = read_member(opened, row)
                parsed = S.parse(raw)
            except Exception as problem:  # a damaged member must not end the task
                raw, parsed = b"", {"error": f"{type(problem).__name__}: {problem}", "receivers": [], "cc": []}
            rows.append({"archive_path": row.archive_path, "entry_path": row.entry_path, **parsed})
            held += len(raw)
            if held > S.CHUNK_BYTES:
                yield S.frame(rows, columns)
                rows, held = [], 0
        if rows:
            yield S.frame(rows, columns)
    if opened is not None:
        opened.close()


def scan_archive_files(files: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Members of admitted archives, one row per mail file, with the columns of :func:`mailweave.sources.archives.scan_archives`.

    ``files`` has a ``path`` and a ``length``; content is never asked for.  There are as many tasks as slices, at least one a core.
    """
    total = files.agg(F.sum("length")).first()[0] or 0
    parts = max(files.sparkSession.sparkContext.defaultParallelism, -(-total // slice_bytes))
    dealt = members(files, slice_bytes).repartition(int(parts), "archive_path", "slice").sortWithinPartitions("archive_path", "slice", "header_at")
    return dealt.mapInPandas(_read, S.SCAN_SCHEMA)
