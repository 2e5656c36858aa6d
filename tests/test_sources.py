"""Sources and sinks by round trips on small files."""

import gzip
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.sources import tables as t


def test_names(spark, tmp_path):
    (tmp_path / "n.txt").write_text("#Genes\na\nb\na\nNone\n")
    n = t.read_names(spark, str(tmp_path / "n.txt"), skip=1)
    got = sorted(map(tuple, t.unique_names(n).collect()))
    assert got == [(0, "a__1"), (1, "b"), (2, "a__2"), (3, "None")]


def test_matrix_market(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%\n3 2 3\n1 1 5\n3 2 7\n2 2 0\n")
    assert sorted(map(tuple, t.read_matrix_market(spark, str(tmp_path / "m.mtx")).collect())) == [(1, 1, 5.0), (3, 2, 7.0)]
    names = lambda v: spark.createDataFrame(list(enumerate(v)), "position bigint, name string")
    got = t.read_matrix_market(spark, str(tmp_path / "m.mtx"), cells=names(["c1", "c2"]), genes=names(["g1", "g2", "g3"]))
    assert sorted(map(tuple, got.collect())) == [("c1", "g1", 5.0), ("c2", "g3", 7.0)]


def test_text_matrices(spark, tmp_path):
    body = "cell\tg1\tg2\tg3\nx\t1\t0\t2\ny\t0\t0.5\t0\n"
    (tmp_path / "m.tsv").write_text(body)
    with gzip.open(tmp_path / "z.tsv.gz", "wt") as f:
        f.write(body)
    want = [("x", "g1", 1.0), ("x", "g3", 2.0), ("y", "g2", 0.5)]
    for name in ("m.tsv", "z.tsv.gz"):
        assert sorted(map(tuple, t.read_counts_text(spark, str(tmp_path / name)).collect())) == want
    flip = t.read_counts_text(spark, str(tmp_path / "m.tsv"), transpose=True, columns=spark.createDataFrame([("x",)], "name string"))
    assert sorted(map(tuple, flip.collect())) == [("g1", "x", 1.0), ("g3", "x", 2.0)]
    assert sorted(map(tuple, t.read_unlabelled_text(spark, str(tmp_path / "m.tsv")).collect())) == [(0, 0, 1.0), (0, 2, 2.0), (1, 1, 0.5)]
    (tmp_path / "bad.tsv").write_text("a\tb\nx\t1\ny\t1\t2\n")
    with pytest.raises(ValueError):
        t.read_counts_text(spark, str(tmp_path / "bad.tsv"))


def test_numpy_and_archives(spark, tmp_path):
    a = np.array([[0.0, 2.0], [3.0, 0.0]])
    np.save(tmp_path / "a.npy", a)
    assert sorted(map(tuple, t.read_numpy(spark, str(tmp_path / "a.npy")).collect())) == [(0, 1, 2.0), (1, 0, 3.0)]
    np.savez(tmp_path / "s.npz", indptr=np.array([0, 1, 2]), indices=np.array([1, 0]), data=np.array([3.0, 2.0]), format=np.array("csc".encode()), shape=np.array([2, 2]))
    assert sorted(map(tuple, t.read_numpy(spark, str(tmp_path / "s.npz")).collect())) == [(0, 1, 2.0), (1, 0, 3.0)]
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("in.txt", "one\ntwo\n")
    assert [r.value for r in t.read_zipped_lines(spark, str(tmp_path / "x.zip")).orderBy("line").collect()] == ["one", "two"]


def test_fastq(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"r{k}.fastq").write_text("".join(f"@n{i if k == 1 or i != 2 else 9} x\nACGT{'A' * i}\n+\nIIII{'I' * i}\n" for i in range(4)))
    s = {str(k): t.read_fastq(spark, str(tmp_path / f"r{k}.fastq")) for k in (1, 2)}
    with pytest.raises(Exception, match="names of record 2 differ"):
        t.weave(s).collect()
    got = t.weave(s, strict=False).orderBy("record").collect()
    assert [(r.name, r.r1, r.r2) for r in got] == [(f"n{i}", "ACGT" + "A" * i, "ACGT" + "A" * i) for i in (0, 1, 3)]
    t.write_fastq(s["1"].withColumn("library", F.lit("L")), str(tmp_path / "out"))
    back = t.read_fastq(spark, str(tmp_path / "out/library=L/*"))
    assert sorted(r.name for r in back.collect()) == ["n0", "n1", "n2", "n3"]
    (tmp_path / "h.fastq").write_text("@CELL1:UMI1:x\nA\n+\nI\n@CELL2:UMI2:x\nA\n+\nI\n")
    assert sorted(map(tuple, t.header_barcodes(spark, str(tmp_path / "h.fastq")).collect())) == [("h", "CELL1", "UMI1"), ("h", "CELL2", "UMI2")]


def test_sinks_and_reshapes(spark, tmp_path):
    e = spark.createDataFrame([(1, 2), (2, 3)], "src bigint, dst bigint")
    t.write_edges(e.coalesce(1), str(tmp_path / "e"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "e")).collect()) == ["1;2", "2;3"]
    nodes = spark.createDataFrame([(1, "a")], "id bigint, label string")
    assert t.graph_json(nodes, e).count() == 3
    tr = spark.createDataFrame([("t", 1, 0.5), ("t", 0, 2.0), ("a", 0, 1.0)], "name string, pos int, value double")
    assert [r.value for r in t.color_tracks(tr).collect()] == ["a,1.000", "t,2.000,0.500"]
    al = t.allow_list(spark.createDataFrame([("L", "AC-1"), ("L", "AC-2")], "lib string, bc string"), "lib", "bc")
    assert list(map(tuple, al.collect())) == [("L", "AC")]
    txt = "NAME x\nCLASS Human Diseases\nGENE        101  TP53; tumor\n            102  MYC; myc\nCOMPOUND C1\n"
    p = spark.createDataFrame([("p1", "ENTRY p1\n" + txt), ("p2", "ENTRY p2\n" + txt.replace("Human Diseases", "Metabolism"))], "name string, text string")
    assert sorted(map(tuple, t.pathway_sets(p, ["Human Diseases"]).collect())) == [("p2", "MYC"), ("p2", "TP53")]
    wide = spark.createDataFrame([("p", 1.0, 2.0, "m")], "pair string, `a|b` double, `b|a` double, meta string")
    assert sorted(map(tuple, t.long_pairs(wide, "pair", ["meta"]).collect())) == [("p", "a|b", 1.0), ("p", "b|a", 2.0)]
    t.write_by(spark.createDataFrame([("x", 1), ("y", 2)], "condition string, v int"), str(tmp_path / "by"), "condition")
    assert sorted(p.name for p in (tmp_path / "by").glob("condition=*")) == ["condition=x", "condition=y"]
    (tmp_path / "lib1.tsv").write_text("Barcode\tReads\nA\t5\nNone\t\n")
    got = t.read_csv(spark, str(tmp_path / "lib1.tsv"), sep="\t", library=True).orderBy("Barcode").collect()
    assert [(r.Barcode, r.Reads, r.library) for r in got] == [("A", 5, "lib1"), ("None", None, "lib1")]
