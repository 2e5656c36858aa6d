"""Readers with partitions of their own."""

import zipfile

import numpy as np
import pytest

from tessella.sources import ranges


def test_matrices_are_read_in_ranges(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(1)
    a = r.integers(0, 3, (1000, 7)) * r.random((1000, 7))
    np.save(tmp_path / "a.npy", a)
    df = ranges.read_npy(spark, str(tmp_path / "a.npy"), 7 * 8 * 90)
    assert df.rdd.getNumPartitions() == 12
    got = {(x.row, x.col): x.count_ for x in df.withColumnRenamed("count", "count_").collect()}
    assert got == {(int(i), int(j)): a[i, j] for i, j in zip(*np.nonzero(a), strict=True)}
    small = r.integers(0, 2, 50).astype("<i2")
    np.save(tmp_path / "v.npy", small)
    assert ranges.read_npy(spark, f"file://{tmp_path}/v.npy").count() == small.sum()
    assert ranges.read_npy(spark, str(tmp_path)).count() == small.sum() + np.count_nonzero(a)
    np.save(tmp_path / "e.npy", np.zeros((0, 4)))
    assert ranges.read_npy(spark, str(tmp_path / "e.npy")).count() == 0


def test_other_matrices_are_refused(spark, tmp_path):
    np.save(tmp_path / "f.npy", np.asfortranarray(np.ones((3, 3))))
    with pytest.raises(Exception, match="one behind the other"):
        ranges.read_npy(spark, str(tmp_path / "f.npy")).count()
    np.save(tmp_path / "cut.npy", np.ones((1000, 3)))
    raw = (tmp_path / "cut.npy").read_bytes()
    (tmp_path / "cut.npy").write_bytes(raw[:-100])
    with pytest.raises(Exception, match="ends before"):
        ranges.read_npy(spark, str(tmp_path / "cut.npy")).count()


def test_members_of_archives_are_partitions(spark, tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "x.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("one.txt", "\n".join(f"line {i}" for i in range(25_000)))
        z.writestr("in/two.txt", "ünï\r\n\nlast\n")
        z.writestr("empty.txt", "")
    df = ranges.read_zip(spark, str(tmp_path / "x.zip"))
    assert df.rdd.getNumPartitions() == 3
    rows = sorted(tuple(x) for x in df.collect())
    two = [x for x in rows if x[0].endswith("two.txt")]
    assert [x[1:] for x in two] == [(0, "ünï"), (1, ""), (2, "last")]
    one = [x for x in rows if x[0].endswith("one.txt")]
    assert [x[1] for x in one] == list(range(25_000)) and one[24_999][2] == "line 24999"
