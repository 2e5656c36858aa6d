"""One pass over the edges tells modularity and every node's best move."""

from collections import defaultdict

import numpy as np
import pytest

from tessella.operators import communities


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_a_pass_finds_the_best_moves(spark, kind, monkeypatch):
    monkeypatch.setattr(communities, "BLOCK", 40)
    r = np.random.default_rng(7)
    name = (lambda i: i) if kind == "bigint" else (lambda i: f"n{i:03d}")
    w = {}
    for i in range(50):
        for j in range(i):
            if r.random() < 0.15:
                w[name(i), name(j)] = w[name(j), name(i)] = float(r.integers(1, 4))
    # a loop counts twice, and a node has nothing but a loop
    w[name(3), name(3)] = w[name(60), name(60)] = 4.0
    e = spark.createDataFrame([(a, b, v) for (a, b), v in w.items()], f"src {kind}, dst {kind}, weight double").repartition(5)
    k, total = defaultdict(float), sum(w.values())
    for (a, _), v in w.items():
        k[a] += v
    ids = sorted(k)
    cluster = {a: ids[n % 7] for n, a in enumerate(ids)}
    tot = defaultdict(float)
    for a in ids:
        tot[cluster[a]] += k[a]
    now = spark.createDataFrame([(a, k[a], cluster[a]) for a in ids], f"id {kind}, k double, cluster {kind}")
    edges = communities._Edges(e)
    best, q = communities._survey(edges, now, 8.0, total, 1.0)
    rows = {row.id: row for row in best.collect()}
    assert rows.keys() == set(ids)
    assert abs(q - communities.weighted_modularity(e, now)) < 1e-12
    for a in ids:
        to = defaultdict(float)
        for (x, b), v in w.items():
            if x == a and b != a:
                to[cluster[b]] += v
        worth = {c: v - k[a] * (tot[c] - (k[a] if c == cluster[a] else 0)) / total for c, v in to.items()}
        stay = worth.get(cluster[a], -k[a] * (tot[cluster[a]] - k[a]) / total)
        assert abs(rows[a].stay - stay) < 1e-9 and rows[a].inside == to.get(cluster[a], 0.0)
        if worth:
            c = min(worth, key=lambda c: (-round(worth[c], 9), c))
            assert rows[a].next == c and abs(rows[a].gain - worth[c]) < 1e-9
        else:
            assert rows[a].next == cluster[a]
    nodes = spark.createDataFrame([(a, k[a], w.get((a, a), 0.0)) for a in ids], f"id {kind}, k double, loop double")
    less = communities._contracted(edges, nodes, now.select("id", now.cluster.alias("next")))
    want = defaultdict(float)
    for (a, b), v in w.items():
        want[cluster[a], cluster[b]] += v
    assert {(row.src, row.dst): row.weight for row in less.collect()} == dict(want)
    edges.blocks.unpersist()
