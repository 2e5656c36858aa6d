"""Doublets are simulated from the features and the sums of cells, not from whole cells."""

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import classify, matrix
from tessella.plans import pipelines


def table(spark, cells=40, genes=60):
    r = np.random.default_rng(1)
    x = r.poisson(1.5, (cells, genes))
    expr = spark.createDataFrame([(i, j, int(x[i, j])) for i in range(cells) for j in range(genes) if x[i, j]], "cell_id bigint, gene bigint, count bigint")
    return expr, spark.createDataFrame([(i, i % 2) for i in range(cells)], "cell_id bigint, batch int")


def test_norms_are_those_of_whole_cells(spark, monkeypatch):
    expr, obs = table(spark)
    chosen = expr.select("gene").distinct().where("gene < 10")
    seen, norms = [], []
    simulate, fit = classify.simulate_doublets, pipelines.components.sparse_components

    def watched(e, *a, **k):
        seen.append(e.count())
        return simulate(e, *a, **k)

    def kept(e, *a, **k):
        norms.append(e)
        return fit(e, *a, **k)

    monkeypatch.setattr(pipelines.classify, "simulate_doublets", watched)
    monkeypatch.setattr(pipelines, "features", lambda *a, **k: (None, chosen))
    monkeypatch.setattr(pipelines.components, "sparse_components", kept)
    pipelines.call_doublets(expr, obs, "batch", 40, n_components=2, k=3, ratio=1.0, rounds=2)
    assert sorted(seen) == sorted([expr.where("gene < 10").count(), 40])
    whole = expr.union(simulate(expr, obs, "batch", 1.0).select("cell_id", "gene", "count"))
    want = {(r.cell_id, r.gene): r.norm for r in matrix.per_cell(whole).where("gene < 10").select("cell_id", "gene", F.log1p("norm").alias("norm")).collect()}
    got = {(r.cell_id, r.gene): r.norm for r in norms[0].collect()}
    assert got.keys() == want.keys() and max(abs(got[p] - want[p]) for p in got) < 1e-12
