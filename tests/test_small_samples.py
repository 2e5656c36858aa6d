"""Paired counts against published p-values, exact rank sums against full enumeration, correlations in tiles."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import exact
from tessella.operators import linear, stats

# fixed values: totals of five controls and five treated samples, counts of sixteen states in them, and the published p
TOTALS = [12329, 13982, 9846, 7866, 2546, 6053, 14304, 10104, 2466, 2957]
STATES = [
    ([168, 234, 147, 117, 60, 202, 718, 536, 128, 114], 0.0002177271),
    ([7, 11, 14, 8, 0, 26, 86, 37, 12, 8], 4.057692e-05),
    ([756, 1315, 776, 673, 170, 190, 461, 214, 29, 91], 0.0007904614),
    ([70, 122, 86, 64, 19, 40, 132, 121, 19, 21], 0.1213262),
    ([6, 21, 11, 8, 3, 1, 8, 3, 2, 0], 0.004097619),
    ([76, 91, 107, 63, 24, 67, 232, 119, 20, 19], 0.2058659),
    ([236, 362, 265, 168, 78, 213, 579, 368, 98, 160], 0.0001547909),
    ([2464, 1056, 816, 547, 121, 777, 2486, 1527, 289, 481], 0.06708271),
    ([379, 790, 340, 262, 92, 90, 359, 139, 47, 57], 1.437957e-05),
    ([38, 19, 30, 12, 9, 35, 106, 54, 10, 12], 0.01246733),
    ([554, 664, 590, 389, 103, 256, 528, 307, 54, 82], 0.0125549),
    ([6, 2, 1, 2, 2, 5, 21, 15, 3, 4], 0.00329251),
    ([22, 52, 40, 28, 18, 77, 284, 130, 43, 72], 8.085408e-06),
    ([1902, 2497, 2011, 1302, 446, 524, 890, 636, 92, 178], 0.0001976922),
    ([49, 58, 44, 25, 12, 34, 146, 34, 17, 13], 0.1421056),
    ([170, 240, 96, 94, 23, 46, 74, 83, 9, 9], 0.004912005),
]


def test_paired_counts_give_the_published_p(spark):
    rows = [(i, j % 5, 1 + j // 5, n, TOTALS[j]) for i, (x, _) in enumerate(STATES) for j, n in enumerate(x)]
    # a state of one sample only: its pair doesn't count; a state without counts
    rows += [(98, 0, 1, 5, 100), (99, 0, 1, 0, 100), (99, 0, 2, 0, 100)]
    df = spark.createDataFrame(rows, "state int, pair int, grp int, n int, total int").repartition(3)
    got = {r.state: r for r in linear.paired_beta_binomial(df, "state", "pair", "grp", "n", "total").collect()}
    for i, (_, p) in enumerate(STATES):
        assert abs(math.log10(got[i].p / p)) < 0.02, (i, got[i].p, p)
    assert 98 not in got and got[99].p > 0.999


@pytest.mark.parametrize("n1,n2", [(1, 1), (2, 3), (4, 4), (3, 5), (2, 6)])
def test_exact_rank_sums_equal_enumeration(n1, n2):
    n = n1 + n2
    us = [sum(c) - n1 * (n1 - 1) // 2 for c in itertools.combinations(range(n), n1)]
    for u in range(n1 * n2 + 1):
        low, high = sum(x <= u for x in us) / len(us), sum(x >= u for x in us) / len(us)
        assert abs(exact.exact_p(n1, n2, u, "less") - low) < 1e-12
        assert abs(exact.exact_p(n1, n2, u, "greater") - high) < 1e-12
        assert abs(exact.exact_p(n1, n2, u) - min(1, 2 * min(low, high))) < 1e-12


def test_small_samples_are_exact_others_corrected_for_ties(spark):
    r = random.Random(1)
    rows = [("few", "ab"[i % 2], float(v)) for i, v in enumerate(r.sample(range(100), 9))]
    rows += [("ties", "ab"[i % 2], float(v)) for i, v in enumerate([1, 1, 2, 2, 2, 3, 4, 4])]
    rows += [("many", "ab"[i % 2], float(v)) for i, v in enumerate(r.sample(range(10_000), 80))]
    got = {x.k: x for x in stats.mann_whitney(spark.createDataFrame(rows, "k string, g string, v double"), "g", "a", "b", "v", ["k"], small=True).collect()}
    few = [(g, v) for k, g, v in rows if k == "few"]
    u = sum(x > y for g, x in few for h, y in few if g == "a" and h == "b")
    assert got["few"].u == u and abs(got["few"].p - exact.exact_p(5, 4, u)) < 1e-12
    # four values of each side: ties take sum(t^3 - t) / (n (n - 1)) from n + 1
    z = (got["ties"].u - 8) / math.sqrt(16 * (9 - (6 + 24 + 6) / 56) / 12)
    assert abs(got["ties"].z - z) < 1e-12 and abs(got["ties"].p - math.erfc(abs(z) / math.sqrt(2))) < 1e-9
    assert abs(got["many"].p - math.erfc(abs(got["many"].z) / math.sqrt(2))) < 1e-9


def test_correlations_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(stats, "TILE", 7)
    r = np.random.default_rng(2)
    x = r.integers(0, 9, (40, 12)).astype(float)
    x[5] = 3
    rows = [(f"r{i:02d}", j, float(v)) for i, row in enumerate(x) for j, v in enumerate(row)]
    df = spark.createDataFrame(rows, "a string, c int, v double")
    rank = np.array([[(row < v).sum() + ((row == v).sum() + 1) / 2 for v in row] for row in x])
    with np.errstate(all="ignore"):
        want = np.corrcoef(rank)
    got = {(q.a, q.b): q.rho for q in stats.spearman_matrix(df, "a", "c", "v").collect()}
    assert len(got) == 40 * 39
    for (a, b), v in got.items():
        i, j = int(a[1:]), int(b[1:])
        assert v is None if 5 in (i, j) else abs(v - want[i, j]) < 1e-9
    best = {}
    for q in stats.spearman_matrix(df, "a", "c", "v", top=3).collect():
        best.setdefault(int(q.a[1:]), []).append(int(q.b[1:]))
    for i in set(range(40)) - {5}:
        order = sorted((j for j in range(40) if j not in (i, 5)), key=lambda j: (-round(want[i, j], 9), j))[:3]
        assert sorted(best[i]) == sorted(order)


def test_random_partners(spark):
    genes = spark.createDataFrame([(f"g{i}",) for i in range(400)], "gene string")
    same = genes.select(F.col("gene").alias("gene_a"), F.col("gene").alias("gene_b"))
    got = stats.random_partners(genes.limit(50), genes, same, 100).collect()
    assert len(got) == len(set(got)) == 5000 and all(r.gene_a != r.gene_b for r in got)
