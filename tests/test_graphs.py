"""Neighbour descent, fuzzy weights and modularity clustering against numpy."""

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import communities, descent, neighbors
from tessella.plans import graph_queries


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, vec array<double>")


def test_descent_recall_and_bounds(spark):
    """Skewed vectors: half of them in one dense spot."""
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(size=(600, 16)) * 0.05, r.normal(size=(600, 16)) * 3])
    k, log, width = 10, [], 15
    got = descent.neighbours(vectors(spark, x), k, log=log).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    mine = defaultdict(set)
    for row in got:
        assert abs(row.dist - d[row.src, row.dst]) < 1e-8
        mine[row.src].add(row.dst)
    assert all(len(mine[i]) == k for i in range(len(x)))
    asked = range(0, len(x), 100)
    assert np.mean([len(mine[i] & set(near[i])) / k for i in asked]) >= 0.9
    assert np.mean([len(mine[i] & set(near[i])) / k for i in range(len(x))]) >= 0.9
    # lists are bounded, so are the comparisons of a vector in a round
    assert all(c <= 2 * width * (2 * width - 1) / 2 for _, c in log)


def test_descent_cosine_and_small_tables(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(60, 8))
    got = descent.neighbours(vectors(spark, x), 4, metric="cosine").collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert all(abs(row.dist - (1 - u[row.src] @ u[row.dst])) < 1e-6 for row in got)
    few = descent.neighbours(vectors(spark, x[:3]), 5).collect()
    assert sorted((row.src, row.dst) for row in few) == [(a, b) for a in range(3) for b in range(3) if a != b]
    assert descent.neighbours(vectors(spark, x[:0]), 5).collect() == []


def brute_weights(pairs):
    lists = defaultdict(list)
    for s, t, d in pairs:
        lists[s].append((d, t))
    one = {}
    for s, n in lists.items():
        near = min((d for d, _ in n if d > 0), default=0.0)
        total = lambda w: sum(math.exp(-max(0.0, d - near) / w) for d, _ in n)  # noqa: B023, E731
        lo, hi, w = 0.0, math.inf, 1.0
        for _ in range(64):
            if total(w) > math.log2(len(n)):
                hi = w
            else:
                lo = w
            w = lo * 2 if hi == math.inf else (lo + hi) / 2
        w = max(w, sum(d for d, _ in n) / len(n) / 1000)
        for d, t in n:
            one[s, t] = math.exp(-max(0.0, d - near) / w)
    out = {}
    for s, t in set(one) | {(t, s) for s, t in one}:
        a, b = one.get((s, t), 0.0), one.get((t, s), 0.0)
        out[s, t] = a + b - a * b
    return out


def test_batch_balanced_weights(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(80, 5))
    v = vectors(spark, x).withColumn("batch", F.col("id") % 3)
    near = neighbors.knn_by_batch(v, "batch", 3)
    rows = near.collect()
    per = defaultdict(int)
    for row in rows:
        per[row.src, row.batch] += 1
        assert row.dst % 3 == row.batch
    assert set(per.values()) == {3} and len(per) == 240
    want = brute_weights([(row.src, row.dst, row.dist) for row in rows])
    got = {(row.src, row.dst): row.weight for row in communities.connectivities(near).collect()}
    assert got.keys() == want.keys() and max(abs(got[p] - want[p]) for p in got) < 1e-9
    assert all(abs(got[a, b] - got[b, a]) < 1e-12 for a, b in got)


def test_balanced_weights_of_all_vectors(spark):
    """The query against brute force: every vector has neighbours of its own, not each hundredth alone."""
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, label = np.array([row.vec_id for row in rows]), np.array([row.label for row in rows])
    x = np.array([row.embedding for row in rows], dtype=float)
    near = []
    for i in range(len(ids)):
        d = np.round(np.sqrt(((x - x[i]) ** 2).sum(1)), 9)
        for t in np.unique(label):
            at = [j for j in np.flatnonzero(label == t) if j != i]
            near += [(ids[i], ids[j], d[j]) for j in sorted(at, key=lambda j: (d[j], ids[j]))[:2]]
    want = brute_weights(near)
    got = {(row.src, row.dst): row.weight for row in graph_queries.balanced_weights(spark, sf).collect()}
    assert {s for s, _ in got} == set(ids)
    assert got.keys() == want.keys() and max(abs(got[p] - want[p]) for p in got) < 1e-6


def planted_graph(seed, groups=8, size=25, inside=0.35, outside=0.01):
    r = np.random.default_rng(seed)
    n = groups * size
    return [(i, j) for i in range(n) for j in range(i + 1, n) if r.random() < (inside if i // size == j // size else outside)]


def modularity_of(pairs, label):
    m, k, inside = len(pairs), defaultdict(int), 0
    for a, b in pairs:
        k[label[a]] += 1
        k[label[b]] += 1
        inside += label[a] == label[b]
    return inside / m - sum(v * v for v in k.values()) / (2 * m) ** 2


def test_modularity_clusters_find_planted_groups(spark):
    pairs = planted_graph(4)
    e = spark.createDataFrame(pairs, "src bigint, dst bigint")
    log = []
    label = {row.id: row.cluster for row in communities.modularity_clusters(e, log=log).collect()}
    assert all(b >= a for a, b in zip(log, log[1:], strict=False))
    q = modularity_of(pairs, label)
    assert abs(q - log[-1]) < 1e-9
    truth = {i: i // 25 for i in label}
    assert q >= modularity_of(pairs, truth) - 0.02
    assert len(set(label.values())) in range(7, 11)
    again = {row.id: row.cluster for row in communities.modularity_clusters(e.repartition(7)).collect()}
    assert again == label and all(label[c] == c for c in label.values())


def test_modularity_beats_label_propagation(spark):
    pairs = planted_graph(5, groups=6, size=20, inside=0.3, outside=0.05)
    e = spark.createDataFrame(pairs, "src bigint, dst bigint")
    label = {row.id: row.cluster for row in communities.modularity_clusters(e).collect()}
    other = {row.id: row.cluster for row in neighbors.label_propagation(e, 5).collect()}
    assert modularity_of(pairs, label) > modularity_of(pairs, other)
    assert communities.modularity_clusters(e.limit(0)).collect() == []
