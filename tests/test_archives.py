"""Archives and dumps as streams of lines."""

import bz2
import gzip
import io
import os
import resource
import tarfile
import zipfile

import pytest

from fabrel.sources import archives
from fabrel.sources.archives import ArchiveReader, Member, archive_lines


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("dumps")
    text = lambda k, n: "".join(f"{k} line {i} é\n" for i in range(n)).encode()
    with zipfile.ZipFile(d / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("one.txt", text("one", 25_000))
        z.writestr("sub/two.txt", text("two", 3) + b"last\xff")
        z.writestr("skip.csv", text("csv", 2))
    with tarfile.open(d / "b.tar.gz", "w:gz") as t:
        for name, n in (("x.txt", 4), ("y.csv", 1), ("z.txt", 2)):
            info = tarfile.TarInfo(name)
            info.size = len(text(name, n))
            t.addfile(info, io.BytesIO(text(name, n)))
    (d / "c.txt.gz").write_bytes(gzip.compress(text("gz", 7)))
    (d / "d.txt.bz2").write_bytes(bz2.compress(text("bz", 5)))
    return d


def test_lines_of_all_kinds(spark, folder):
    df = archive_lines(spark, f"file://{folder}")
    counts = {r["member"]: r["count"] for r in df.groupBy("member").count().collect()}
    assert counts == {"one.txt": 25_000, "sub/two.txt": 4, "skip.csv": 2, "x.txt": 4, "y.csv": 1, "z.txt": 2, "c.txt.gz": 7, "d.txt.bz2": 5}
    assert df.rdd.getNumPartitions() == 6
    assert {r["line"] for r in archive_lines(spark, str(folder / "a.zip"), suffix="two.txt").collect()} == {"two line 0 é", "two line 1 é", "two line 2 é", "last�"}


def test_pattern_and_limit(spark, folder):
    assert [r["line"] for r in archive_lines(spark, str(folder / "a.zip"), suffix="one.txt", pattern="line .*7 ", limit=3).collect()] == ["one line 7 é", "one line 17 é", "one line 27 é"]
    assert archive_lines(spark, f"file://{folder}", limit=9).count() == 9 and archive_lines(spark, str(folder / "d.txt.bz2"), limit=0).count() == 0


def test_the_rest_is_not_read(folder, monkeypatch):
    """A limited read takes little of a large member, and an unlimited one holds little of it."""
    path = folder / "large.zip"
    block = b"".join(b"%09d of many lines of a large member\n" % i for i in range(200_000))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z, z.open("large.txt", "w", force_zip64=True) as m:
        for _ in range(24):
            m.write(block)  # 200 MB
    taken = []
    opened = archives._opened

    class Counted(io.RawIOBase):
        def __init__(self, f):
            self.f = f

        def readable(self):
            return True

        def seekable(self):
            return True

        def seek(self, *a):
            return self.f.seek(*a)

        def tell(self):
            return self.f.tell()

        def read(self, n=-1):
            b = self.f.read(n) if n >= 0 else self.f.read()
            taken.append(len(b))
            return b

    monkeypatch.setattr(archives, "_opened", lambda p: Counted(opened(p)))
    rows = sum(b.num_rows for b in ArchiveReader({"path": str(path), "limit": "12000"}).read(Member(str(path), "large.txt")))
    assert rows == 12_000 and sum(taken) < path.stat().st_size / 10
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert sum(b.num_rows for b in ArchiveReader({"path": str(path)}).read(Member(str(path), "large.txt"))) == 4_800_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000  # KB


def test_hidden_files_of_a_folder_are_not_read(spark, tmp_path):
    folder = str(tmp_path / "dump")
    spark.createDataFrame([("a",), ("b",)], "value string").write.text(folder, compression="gzip")
    assert {n[0] for n in os.listdir(folder)} >= {"_", "."}
    assert sorted(r.line for r in archive_lines(spark, f"file://{folder}").collect()) == ["a", "b"]
