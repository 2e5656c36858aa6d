"""Sparse components against dense decompositions; parallel analysis on planted ranks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import components


def table(spark, x):
    rows = [(int(i), f"g{j:03d}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    return spark.createDataFrame(rows, "cell_id bigint, gene string, norm double")


def planted(seed, n=120, g=60, rank=3, noise=0.3):
    r = np.random.default_rng(seed)
    x = np.abs(r.normal(size=(n, g))) * noise
    for k in range(rank):
        on = r.random(n) < 0.4
        x[np.ix_(on, range(k * 12, k * 12 + 12))] += 2.5 - 0.5 * k + r.random((on.sum(), 1))
    x[x < 0.25] = 0
    x[7] = 0
    return x


def matrices(c, n, g, k, key=0):
    s, l = np.zeros((n, k)), np.zeros((g, k))
    for r in c.scores.where(F.col("key") == key).collect():
        s[r.cell_id] = r[2:]
    for r in c.loadings.where(F.col("key") == key).collect():
        l[int(r.gene[1:])] = r[2:]
    return s, l


@pytest.mark.parametrize("center", [True, False])
def test_components_equal_the_dense_form(spark, center):
    x = planted(1)
    z = (x - x.mean(0) * center) / x.std(0)
    u, d, vt = np.linalg.svd(z, full_matrices=False)
    c = components.sparse_components(table(spark, x), len(x), 3, center=center)
    s, l = matrices(c, *x.shape, 3)
    sign = np.sign((vt[:3].T * l).sum(0))
    assert np.abs(l - vt[:3].T * sign).max() < 1e-6
    # a cell without a value is a row of its own: all minus the means
    filled = np.arange(len(x)) != 7
    assert np.abs((s - u[:, :3] * d[:3] * sign)[filled]).max() < 1e-5
    assert np.allclose(c.variances[0], d[:3] ** 2 / len(x), rtol=1e-8)
    assert (l[np.abs(l).argmax(0), range(3)] > 0).all()


def test_components_of_a_base(spark):
    x = planted(2)
    base = np.arange(len(x)) % 2 == 0
    z = (x - x[base].mean(0)) / x[base].std(0)
    vt = np.linalg.svd(z[base], full_matrices=False)[2]
    some = spark.createDataFrame([(int(i),) for i in np.flatnonzero(base)], "cell_id bigint")
    c = components.sparse_components(table(spark, x), int(base.sum()), 2, base=some)
    s, l = matrices(c, *x.shape, 2)
    sign = np.sign((vt[:2].T * l).sum(0))
    want = z @ vt[:2].T * sign
    filled = np.arange(len(x)) != 7
    assert np.abs((s - want)[filled]).max() < 1e-5


def test_shuffles_keep_values_and_break_ties_between_genes(spark):
    x = planted(3)
    e = table(spark, x)
    cells = spark.range(len(x)).withColumnRenamed("id", "cell_id")
    got = components.shuffled(e, cells, "norm", 2).collect()
    assert len({(r.iter, r.cell_id, r.gene) for r in got}) == len(got) == 2 * np.count_nonzero(x)
    for j in range(5):
        for i in (0, 1):
            assert sorted(r.norm for r in got if r.gene == f"g{j:03d}" and r.iter == i) == pytest.approx(sorted(x[x[:, j] > 0, j]))


@pytest.mark.parametrize("rank", [2, 4])
def test_parallel_analysis_finds_the_planted_rank(spark, rank):
    x = planted(4 + rank, n=200, g=60, rank=rank)
    found, real, null = components.significant(table(spark, x), spark.range(len(x)).withColumnRenamed("id", "cell_id"), 7, rounds=3)
    assert found == rank and len(null) == 3
