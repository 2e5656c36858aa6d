"""Corrections of the sequences that occur are those of the whole neighbourhood, without writing it out."""

import random

from pyspark.sql import functions as F

from tessella.operators import reads


def test_corrections_are_the_rows_of_the_table_that_occur(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("ACGT") for _ in range(5))
    barcodes = sorted({word() for _ in range(60)} | {"ACGTN", "ACG"})
    seqs = sorted({word() for _ in range(500)} | {"ACGTA", "ANGTN", "AC#TN", "ACT", "", *barcodes[:20]})
    w, s = spark.createDataFrame([(b,) for b in barcodes], "barcode string"), spark.createDataFrame([(x,) for x in seqs], "seq string")
    want = reads.correction_table(w, 1).join(s, "seq", "left_semi")
    got = reads.corrections(s, w)
    assert sorted(map(tuple, got.select("seq", "barcode").collect())) == sorted(map(tuple, want.collect())) and want.count() > 100
    # a sequence and a barcode are repeated once for each of their places
    assert "substring(barcode" in got._jdf.queryExecution().optimizedPlan().toString() and got.where(F.col("barcode").isNull()).count() == 0
