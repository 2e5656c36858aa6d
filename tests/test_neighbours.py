"""Exact neighbours in blocks against plain sums: copies, ties, groups, cosine, odd vectors."""

import math

import numpy as np
import pytest

from tessella.operators import neighbors


DIM = 6


def plain(x, y, metric):
    if x is None or y is None or len(x) != DIM or len(y) != DIM or any(v is None for v in [*x, *y]):
        return None
    add = lambda z: float(np.cumsum([0.0, *z])[-1])
    if metric == "cosine":
        n = math.sqrt(add(a * a for a in x) * add(b * b for b in y))
        return round(1 - add(a * b for a, b in zip(x, y, strict=True)) / n, 9) if n else None
    return round(math.sqrt(add((a - b) ** 2 for a, b in zip(x, y, strict=True))), 9)


def brute(queries, refs, k, metric, itself, grouped):
    out = set()
    for i, x, _ in queries:
        for g in {g for *_, g in refs} if grouped else {None}:
            d = [(plain(x, y, metric), j) for j, y, h in refs if (not grouped or h == g) and (itself or i != j)]
            d = sorted(d, key=lambda t: (t[0] is None, t[0], t[1]) if t[0] is not None else (True, 0.0, t[1]))
            out |= {(i, j, v, n + 1, g) for n, (v, j) in enumerate(d[:k])}
    return out


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("itself", [False, True])
def test_blocks_against_brute_force(spark, monkeypatch, metric, itself):
    monkeypatch.setattr(neighbors, "TILE_R", 32)
    monkeypatch.setattr(neighbors, "TILE_Q", 16)
    r = np.random.default_rng(5)
    base = r.normal(1000, 1, (40, 6)).round(2)
    rows = [(i, base[i % 40].tolist(), i % 3) for i in range(200)]
    rows += [(200 + i, (base[i] + r.integers(-1, 2, 6) * 1e-10).tolist(), 1) for i in range(20)]
    rows += [(220, None, 0), (221, [1.0, None, 0.0, 0.0, 0.0, 1.0], 1), (222, [1.0, 2.0], 2), (223, [0.0] * 6, 2)]
    df = spark.createDataFrame(rows, "id bigint, vec array<double>, grp int")
    queries = [x for x in rows if x[0] % 7 == 0 or x[0] > 215]
    q = spark.createDataFrame(queries, df.schema)
    for within in (None, "grp"):
        for blocks in (1, 3):
            got = neighbors.knn(q, df, 4, metric, itself, blocks, within).collect()
            want = brute(queries, rows, 4, metric, itself, within is not None)
            assert {(x.src, x.dst, x.dist, x["rank"], x.grp if within else None) for x in got} == want and len(got) == len(want)


def test_queries_in_several_deals(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK", 64)
    r = np.random.default_rng(6)
    rows = [(i, r.normal(size=DIM).tolist(), 0) for i in range(70)]
    df = spark.createDataFrame(rows, "id bigint, vec array<float>, grp int")
    exact = [(x.id, x.vec, x.grp) for x in df.collect()]
    got = neighbors.knn(df, df, 3).collect()
    assert {(x.src, x.dst, x.dist, x["rank"], None) for x in got} == brute(exact, exact, 3, "euclidean", False, False)
    assert neighbors.knn(df.where("id < 0"), df, 3).collect() == [] and neighbors.knn(df, df.where("id < 0"), 3).collect() == []


def test_buckets_against_the_similarity_join(spark, monkeypatch):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    monkeypatch.setattr(neighbors, "TILE_R", 32)
    r = np.random.default_rng(7)
    df = spark.createDataFrame([(i, r.normal(size=DIM).tolist()) for i in range(120)], "id bigint, vec array<double>")
    for width, reach in ((0.4, None), (3.0, 2.0)):
        v = df.select("id", array_to_vector("vec").alias("features"))
        model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=width, numHashTables=3, seed=2).fit(v)
        near = {}
        for x in model.approxSimilarityJoin(v, v, reach or 1e9, distCol="dist").selectExpr("datasetA.id src", "datasetB.id dst", "dist").where("src <> dst").collect():
            near.setdefault(x.src, []).append((x.dist, x.dst))
        want = {(s, d, n + 1) for s, l in near.items() for n, (_, d) in enumerate(sorted(l)[:4])}
        got = neighbors.knn_approximate(df, 4, width, 3, reach, 2)
        assert {(x.src, x.dst, x["rank"]) for x in got.collect()} == want
        assert "Generate explode(buckets" not in got._jdf.queryExecution().toString() and "datasetA" not in got._jdf.queryExecution().toString()
