"""Archives read by range give what reading them whole gives, with work dealt by bytes."""

import collections
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from mailweave.sources import archive_ranges as R
from mailweave.sources import archives as S
from tests.test_ingest import BARE, BOTH, HTML, PLAIN, inbox, pack  # noqa: F401


def plain(rows):
    return sorted(map(str, rows.select([c for c in rows.columns if c != "archive_path"]).collect()))


def test_rows_and_rejects_are_those_of_whole_archives(spark, inbox):  # noqa: F811
    with zipfile.ZipFile(inbox / "kinds.zip", "w", zipfile.ZIP_DEFLATED) as target:
        target.writestr("deflated.eml", PLAIN * 50)
        target.writestr("bz.eml", BOTH, compress_type=zipfile.ZIP_BZIP2)
        target.writestr("lzma.eml", BOTH, compress_type=zipfile.ZIP_LZMA)
        target.writestr("ü/ünï.eml", HTML)
    with zipfile.ZipFile(inbox / "twice.zip", "w") as target, pytest.warns(UserWarning):
        target.writestr("same.eml", PLAIN)
        target.writestr("same.eml", BARE)
    damaged = bytearray((inbox / "kinds.zip").read_bytes())
    damaged[60:64] = b"\0\0\0\0"
    (inbox / "damaged.zip").write_bytes(bytes(damaged))
    files = S.archive_files(spark, str(inbox), max_bytes=40_000)
    whole, ranged = S.scan_archives(files), R.scan_archive_files(files.select("path", "length"))
    assert plain(ranged) == plain(whole) and ranged.count() > 15
    assert {r.archive_path for r in ranged.collect()} == {r.archive_path for r in whole.collect()}
    assert S.rejected(ranged).count() >= 3


def test_one_archive_is_read_by_many_tasks(spark, tmp_path):
    body = os.urandom(3000).hex().encode()
    pack(tmp_path / "large.zip", {f"{i:03d}.eml": PLAIN + str(i).encode() + body for i in range(200)})
    size = os.path.getsize(tmp_path / "large.zip")
    files = S.archive_files(spark, str(tmp_path)).select("path", "length")
    slices = R.members(files, slice_bytes=50_000).groupBy("slice").agg(F.sum("packed").alias("bytes"), F.count("*").alias("n")).collect()
    assert len(slices) >= size // 50_000 and max(r.bytes for r in slices) <= 50_000 and sum(r.n for r in slices) == 200
    scanned = R.scan_archive_files(files, slice_bytes=50_000)
    tasks = scanned.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks >= 10 and scanned.count() == 200 and S.rejected(scanned).count() == 0


def test_nothing_but_ranges_is_read(tmp_path, monkeypatch):
    pack(tmp_path / "a.zip", {"big.bin": os.urandom(2_000_000), "x.eml": PLAIN, "y.eml": BOTH})
    read = []

    class Counted(R.RangeFile):
        def read(self, n=-1):
            out = super().read(n)
            read.append(len(out))
            return out

    monkeypatch.setattr(R, "RangeFile", Counted)
    rows = R.directory(str(tmp_path / "a.zip"))
    assert [r["entry_path"] for r in rows] == ["x.eml", "y.eml"]
    with Counted(str(tmp_path / "a.zip")) as file:
        Row = collections.namedtuple("Row", rows[0])
        assert [R.read_member(file, Row(**r)) for r in rows] == [PLAIN, BOTH]
    assert sum(read) < 100_000


def test_encrypted_members_are_rejected(tmp_path):
    pack(tmp_path / "a.zip", {"x.eml": PLAIN})
    row = R.directory(str(tmp_path / "a.zip"))[0] | {"flags": 1}
    with R.RangeFile(f"file:{tmp_path}/a.zip") as file, pytest.raises(RuntimeError, match="encrypted"):
        R.read_member(file, collections.namedtuple("Row", row)(**row))


def test_no_archives(spark, tmp_path):
    (tmp_path / "notes.tar").write_bytes(b"..")
    assert R.scan_archive_files(S.archive_files(spark, str(tmp_path)).select("path", "length")).count() == 0
