"""Standard chains on planted cells."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from tessella.operators import classify
from tessella.plans import pipelines


def counts(spark, x, first=0):
    return spark.createDataFrame([(int(i) + first, f"g{j:02d}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "cell_id bigint, gene string, count double")


def kinds(seed, n, kinds=3, per=12):
    r = np.random.default_rng(seed)
    rates = np.full((kinds, kinds * per), 0.4)
    for k in range(kinds):
        rates[k, k * per : (k + 1) * per] = 6
    label = np.arange(n) % kinds
    return r.poisson(rates[label]), label, r


def test_doublets_are_called(spark):
    x, label, r = kinds(1, 180)
    planted = np.stack([x[a] + x[b] for a, b in ((0, 1), (4, 3), (6, 8), (9, 11), (12, 13), (16, 15), (18, 20), (21, 22))])
    every = np.concatenate([x, planted])
    obs = spark.createDataFrame([(i, "one") for i in range(len(every))], "cell_id bigint, batch string")
    out = {v.cell_id: v for v in pipelines.call_doublets(counts(spark, every), obs, "batch", len(every), top=36, n_components=4, k=12, rounds=8).collect()}
    assert len(out) == len(every)
    called = {i for i, v in out.items() if v.doublet}
    assert len(called & set(range(180, 188))) >= 7 and len(called & set(range(180))) <= 18


def test_valley(spark):
    r = np.random.default_rng(2)
    two = np.clip(np.concatenate([r.normal(0.2, 0.05, 500), r.normal(0.8, 0.05, 200)]), 0, 1)
    one = np.clip(r.normal(0.4, 0.05, 500), 0, 1)
    df = lambda v: spark.createDataFrame([(float(a),) for a in v], "s double")
    assert 0.35 < classify.valley(df(two), "s") < 0.65
    assert classify.valley(df(one), "s") is None and classify.valley(df([]), "s") is None


@pytest.mark.parametrize("kind", ["softmax", "svm", "forest"])
def test_labels_are_carried_over(spark, kind):
    x, label, _ = kinds(3, 120)
    y, truth, _ = kinds(4, 60)
    labels = spark.createDataFrame([(i, f"kind {k}") for i, k in enumerate(label)], "cell_id bigint, state string")
    # a seed gene that three others follow: they leave the features, and the labels still come over
    seeds = spark.createDataFrame([("g00",)], "gene string") if kind == "softmax" else None
    got = pipelines.label_query(counts(spark, x), labels, "state", counts(spark, y, 1000), len(x), top=30, n_components=4, kind=RandomForestClassifier(numTrees=5, seed=1) if kind == "forest" else kind, seeds=seeds)
    right = [f"kind {truth[r.cell_id - 1000]}" == r.predicted for r in got.collect()]
    assert len(right) == 60 and np.mean(right) > 0.9
