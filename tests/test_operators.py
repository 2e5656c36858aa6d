"""Operators against numpy or hand-worked cases."""

import inspect
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import dna, tails
from tessella.operators import classify, groups, linear, matrix, neighbors, ranks, reads, resample, sets, stats


@pytest.fixture(scope="module")
def counts(spark):
    r = np.random.default_rng(3)
    x = r.poisson(0.7, (40, 15)).astype(float)
    e = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(40) for j in range(15) if x[i, j]], "cell_id bigint, gene bigint, count double").repartition(3)
    return x, e


def test_moments_and_variance(counts):
    x, e = counts
    got = {r.gene: r for r in matrix.moments(e, "count", 40).collect()}
    for j in range(15):
        assert got[j].mean == pytest.approx(x[:, j].mean()) and got[j].variance == pytest.approx(x[:, j].var())


def test_rank_sum_equals_dense_ranks(spark, counts):
    x, e = counts
    lab = spark.createDataFrame([(i, 1 if i < 15 else 2) for i in range(40)], "cell_id bigint, grp int")
    got = {r.gene: r for r in stats.rank_sum_test(e, lab).collect()}
    for j in range(15):
        v = x[:, j]
        rk = np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
        r1 = rk[:15].sum()
        assert got[j].u == pytest.approx(r1 - 15 * 16 / 2)
        z = (r1 - 15 * 41 / 2) / math.sqrt(15 * 25 * 41 / 12)
        assert got[j].z == pytest.approx(z)
        assert got[j].p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=3e-7)


def test_bh_is_monotone_and_keeps_nulls(spark):
    p = [0.01, 0.02, 0.02, 0.5, None, 0.04, 1.0]
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    got = {r.i: r.fdr for r in stats.bh(df, "p").collect()}
    v = [x for x in p if x is not None]
    for i, x in enumerate(p):
        want = None if x is None else min(1.0, min(y * len(v) / sum(z <= y for z in v) for y in v if y >= x))
        assert got[i] is None if want is None else got[i] == pytest.approx(want)


def test_tails(spark):
    rows = [(5, 3, 2, 9), (0, 4, 7, 1), (10, 0, 0, 12), (120, 340, 200, 500), (1, 1, 1, 1)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    got = df.select("*", *[tails.fisher_exact(F.col("a"), F.col("b"), F.col("c"), F.col("d"), s).alias(s) for s in ("two", "greater", "less")]).collect()
    for r in got:
        n, k, m = r.a + r.b + r.c + r.d, r.a + r.b, r.a + r.c
        pm = {i: math.comb(m, i) * math.comb(n - m, k - i) / math.comb(n, k) for i in range(max(0, k + m - n), min(k, m) + 1)}
        assert r.two == pytest.approx(sum(v for v in pm.values() if v <= pm[r.a] * (1 + 1e-7)), rel=1e-5)
        assert r.greater == pytest.approx(sum(v for i, v in pm.items() if i >= r.a), rel=1e-5)
        assert r.less == pytest.approx(sum(v for i, v in pm.items() if i <= r.a), rel=1e-5)
    x = spark.createDataFrame([(3.84,), (9.0,)], "x double")
    assert [round(r[0], 3) for r in x.select(tails.chi2_sf(F.col("x"), 1)).collect()] == [0.05, 0.003]
    assert x.select(tails.chi2_sf(F.col("x"), 4)).first()[0] == pytest.approx(math.exp(-1.92) * 2.92)


def test_linear_models_equal_least_squares(spark):
    r = np.random.default_rng(0)
    n = 120
    d = r.integers(0, 2, (n, 3))
    y = np.maximum(0, np.round(2 + d[:, 0] * 3 - d[:, 1] + d[:, 0] * d[:, 2] * 2 + r.normal(0, 1, n)))
    design = spark.createDataFrame([(i, *map(int, d[i])) for i in range(n)], "cell_id bigint, O int, I int, E int")
    e = spark.createDataFrame([(i, "g", float(y[i])) for i in range(n) if y[i]], "cell_id bigint, gene string, count double")
    m = {"m5": [t for t in linear.design_terms(["O", "I", "E"]) if len(t) < 3], "m0": linear.reduced(["I", "E", "I:E"])}
    fits = linear.fit(e, design, ["O", "I", "E"], m)
    got = {(x.model, x.term): x for x in fits.collect()}

    def rss(terms):
        cols = [np.ones(n), *[np.prod([d[:, "OIE".index(c)] for c in t], axis=0) for t in terms]]
        a = np.column_stack(cols)
        beta = np.linalg.lstsq(a, y, rcond=None)[0]
        return ((y - a @ beta) ** 2).sum(), beta

    full, beta = rss(linear.design_terms(["O", "I", "E"]))
    assert got["full", "1"].rss == pytest.approx(full) and got["full", "1"].coef == pytest.approx(beta[0])
    lr = {x.model: x for x in linear.likelihood_ratio(fits, {"m5": 1, "m0": 4}).collect()}
    for k in m:
        assert lr[k].stat == pytest.approx(n * math.log(rss(m[k])[0] / full))
    eff = {x.model: x.effect for x in linear.effects(fits, {"m0": ["O"], "m5": ["E:I:O"]}).collect()}
    assert eff["m0"] == ("up" if beta[1 + linear.design_terms(["O", "I", "E"]).index(("O",))] > 0 else "down")


def test_enrichment_equals_running_sum(spark):
    r = np.random.default_rng(2)
    s = np.sort(r.normal(0, 1, 60))[::-1]
    rank = spark.createDataFrame([(f"g{i:02d}", float(v)) for i, v in enumerate(s)], "gene string, score double")
    mine = {"a": [0, 2, 3, 7, 20], "b": [50, 55, 58, 59], "c": [5, 30, 45]}
    ms = spark.createDataFrame([(k, f"g{i:02d}") for k, v in mine.items() for i in v], "set_name string, gene string")
    got = {x.set_name: x for x in sets.running_enrichment(rank, ms).collect()}
    for k, v in mine.items():
        hit = np.zeros(60)
        hit[v] = abs(s[v]) / abs(s[v]).sum()
        run = np.cumsum(hit) - np.cumsum(np.isin(np.arange(60), v, invert=True)) / (60 - len(v))
        assert got[k].es == pytest.approx(run.max() if run.max() >= -run.min() else run.min())
    assert got["b"].leading == ["g50", "g55", "g58", "g59"] and got["a"].leading[:2] == ["g00", "g02"]
    p = {x.set_name: x.p for x in sets.preranked(rank, ms, rounds=60, least=1).collect()}
    assert p["a"] < 0.1 and p["b"] < 0.1 and p["c"] > 0.1


def test_auroc_and_conservation(spark):
    r = np.random.default_rng(1)
    v, y = r.integers(0, 20, 200), r.integers(0, 2, 200)
    df = spark.createDataFrame([("k", float(a), int(b)) for a, b in zip(v, y, strict=True)], "k string, v double, y int")
    want = np.mean([(a > b) + 0.5 * (a == b) for a in v[y == 1] for b in v[y == 0]])
    assert stats.auroc(df, ["k"], "v", F.col("y") == 1).first().auroc == pytest.approx(want)
    assert stats.auroc(df.withColumn("v", -F.col("v")), ["k"], "v", F.col("y") == 1).first().auroc == pytest.approx(1 - want)


def test_barcodes(spark):
    wl = spark.createDataFrame([("AAAA",), ("CCCC",), ("AACC",)], "barcode string")
    t = {r.seq: r.barcode for r in reads.correction_table(wl, 2).collect()}
    for a in ("AAAA", "AAAT", "AANN", "ACCC", "GGCC", "TTTT", "ACAC"):
        d = sorted((sum(x != y for x, y in zip(a, b, strict=True)), b) for b in ("AAAA", "CCCC", "AACC"))
        best = [b for k, b in d if k == d[0][0] and k <= 2]
        assert t.get(a) == (best[0] if len(best) == 1 else None)


def test_dna_functions(spark):
    df = spark.createDataFrame([("ACGTNAAAAAAA", "IIII!IIII###")], "s string, q string")
    r = df.select(dna.reverse_complement(F.col("s")).alias("rc"), dna.trim_poly_a(F.col("s")).alias("t"), dna.low_complexity_fraction(F.col("s")).alias("lc"), dna.trimmed_span(F.col("q"), 28, 4, 20).alias("sp"), dna.mouse_symbol(F.lit("HLA-DRA_X")).alias("m"), dna.mouse_symbol(F.lit("FASLG")).alias("f"), dna.kmers(F.col("s"), 10).alias("k")).first()
    assert (r.rc, r.t, r.lc) == ("TTTTTTTNACGT", "ACGTNAAAA", 7 / 12) and r.m == "Hla-Dra_X" and r.f == "Fasl" and r.k == ["ACGTNAAAAA", "CGTNAAAAAA", "GTNAAAAAAA"]
    q = [ord(c) - 33 for c in "IIII!IIII###"]
    start = next(i for i, v in enumerate(q) if v >= 28)
    poor = next((i for i in range(start, len(q) - 3) if sum(q[i : i + 4]) < 80), len(q))
    assert (r.sp.start, r.sp.length) == (start, poor - start)


def test_abundances_and_folds(spark):
    obs = spark.createDataFrame([(i, f"s{i % 3}", f"c{i % 2}") for i in range(50)], "cell_id bigint, cell_state string, condition string")
    a = groups.abundance(obs, "condition", "cell_state").groupBy("condition").agg(F.sum("share").alias("s")).collect()
    assert all(r.s == pytest.approx(100) for r in a)
    t = {(r.a, r.b): r.n for r in groups.contingency(spark.createDataFrame([("x", "p"), ("y", "q")], "a string, b string"), "a", "b").collect()}
    assert t == {("x", "p"): 1, ("x", "q"): 0, ("y", "p"): 0, ("y", "q"): 1}
    with pytest.raises(ValueError):
        groups.contingency(spark.createDataFrame([("x", None)], "a string, b string"), "a", "b")


def test_graph(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)], "src bigint, dst bigint")
    c = {r.id: r.cluster for r in neighbors.label_propagation(e, 6).collect()}
    assert c[0] == c[1] and c[4] == c[5] and set(c) == set(range(6))
    g = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("a", "c", 0.7), ("c", "d", 0.1)], "t1 string, t2 string, weight double")
    assert sorted((r.t1, r.t2) for r in neighbors.maximum_spanning_tree(g).collect()) == [("a", "b"), ("b", "c"), ("c", "d")]


def test_knn_exact(spark):
    r = np.random.default_rng(4)
    v = r.normal(0, 1, (60, 5)).round(3)
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(60)], "id bigint, vec array<double>")
    got = {}
    for x in neighbors.knn(df, df, 4, blocks=3).collect():
        got.setdefault(x.src, {})[x.rank] = x.dst
    for i in range(60):
        d = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
        want = [j for j in sorted(range(60), key=lambda j: (round(d[j], 9), j)) if j != i][:4]
        assert [got[i][k] for k in range(1, 5)] == want
    ap = neighbors.knn_approximate(df, 4, bucket=2.0, tables=5).groupBy("src").count()
    assert ap.count() > 40


def test_classifiers(spark):
    prof = spark.createDataFrame([("a", "g1", 9.0), ("a", "g2", 1.0), ("b", "g1", 1.0), ("b", "g2", 9.0)], "label string, gene string, mean double")
    e = spark.createDataFrame([(1, "g1", 5.0), (1, "g2", 1.0), (2, "g2", 4.0)], "cell_id bigint, gene string, count double")
    best = {r.cell_id: r.label for r in ranks.best_label(classify.max_likelihood(e, prof), "cell_id", "label", "loglik").collect()}
    assert best == {1: "a", 2: "b"}
    obs = spark.createDataFrame([(i, i % 2) for i in range(20)], "cell_id bigint, lib int")
    x = spark.createDataFrame([(i, "g", 1.0) for i in range(20)], "cell_id bigint, gene string, count double")
    sim = classify.simulate_doublets(x, obs, "lib", 1.0)
    assert {r["count"] for r in sim.select("count").collect()} <= {1.0, 2.0} and sim.count() == 20


def test_resampling_ignores_partitions(spark):
    items = spark.createDataFrame([("p", f"g{i}") for i in range(20)], "program string, gene string")
    a = sorted(map(tuple, resample.draws(items, ["program"], "gene", 5, 7).collect()))
    assert a == sorted(map(tuple, resample.draws(items.repartition(7), ["program"], "gene", 5, 7).collect())) and len(a) == 35
    p = resample.unique_pairs(50, spark, 100).collect()
    assert len(p) == len({(r.a, r.b) for r in p}) == 100 and all(r.a != r.b for r in p)


def test_v_scores_and_signature(counts):
    x, e = counts
    v = matrix.v_scores(e, "count", 40, bins=5, fit_percentile=10).collect()
    assert len(v) == 15 and all(r.v > 0 for r in v)
    r = {(g.gene, g.seed): g.r for g in matrix.seed_correlation(e, "count", e.where("gene < 3").select("gene").distinct(), 40).collect()}
    for j in range(15):
        if (j, 1) in r:
            assert r[j, 1] == pytest.approx(np.corrcoef(x[:, j], x[:, 1])[0, 1])


def test_phase_and_rules(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (6.5,), (-1.0,)], "x double")
    got = [r[0] for r in df.select(ranks.phase(F.col("x"), [(0, 1, "a"), (1, 3, "b")], "z")).collect()]
    assert got == ["a", "a", "b", "a", "z"]
    assert [r[0] for r in df.select(ranks.first_rule([(F.col("x") > 1, "hi"), (F.col("x") > -2, "lo")], "no", last_wins=True)).collect()] == ["lo"] * 5


def test_beta_binomial(spark):
    rows = [("s", 1 if i < 5 else 2, (80 if i < 5 else 200) + i, 2000) for i in range(10)] + [("t", 1 if i < 5 else 2, 100 + i, 2000) for i in range(10)]
    df = spark.createDataFrame(rows, "state string, grp int, n int, total int")
    p = {r.state: r for r in linear.beta_binomial(df, "state", "grp", "n", "total").collect()}
    assert p["s"].p < 1e-6 and p["t"].p > 0.05 and p["s"].mu1 == pytest.approx(82 / 2000, rel=0.05)


def test_overlaps(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("x", 3), ("y", 3)], "ga string, gene int")
    b = spark.createDataFrame([("p", 2), ("p", 3), ("q", 9)], "gb string, gene int")
    got = {(r.ga, r.gb): (r.shared, r.pct, round(r.jaccard, 4)) for r in sets.overlaps(a, b, "ga", "gb").collect()}
    assert got == {("x", "p"): (2, 100.0, 0.6667), ("y", "p"): (1, 100.0, 0.5)}


def test_registered_rounds_are_the_references(spark, monkeypatch):
    from tessella.plans import statistics_queries as q

    seen = {}
    for module, name in ((q.sets, "preranked"), (q.resample, "bootstrap_fold"), (q.resample, "binomial_rounds")):

        def spy(*a, f=getattr(module, name), name=name, **k):
            bound = inspect.signature(f).bind(*a, **k)
            bound.apply_defaults()
            seen[name] = bound.arguments
            return f(*a, **k)

        monkeypatch.setattr(module, name, spy)
    for f in (q.prerank_permutations, q.bootstrap_fold, q.binomial_bootstrap_sd):
        f(spark, "/root/testdata/sf0.001")
    assert seen["preranked"]["rounds"] == 1000 and seen["binomial_rounds"]["rounds"] == 1000
    assert (seen["bootstrap_fold"]["rounds"], seen["bootstrap_fold"]["size"]) == (101, 7)


def test_bootstrap_fold_of_a_small_program(spark):
    values = spark.createDataFrame([(c, 1 + c % 2, g, float(1 + c % 2 + (c // 2 % 2) * 0.5)) for c in range(8) for g in ("a", "b")], "cell_id bigint, grp int, gene string, value double")
    genes = spark.createDataFrame([("small", "a"), ("small", "b")], "program string, gene string")
    (r,) = resample.bootstrap_fold(values, genes, "grp").collect()
    assert r.fc == pytest.approx((2.25 + 0.01) / (1.25 + 0.01))


def test_fold_of_absent_states(spark):
    rows = [("c", "d1", "A", 0.5), ("c", "d1", "B", 0.5), ("x", "d1", "A", 0.0), ("x", "d1", "B", 1.0), ("c", "d2", "A", 0.0), ("x", "d2", "A", 0.3)]
    df = spark.createDataFrame(rows, "cond string, donor string, state string, share double")
    got = {(r.cond, r.state): r.log2fc for r in groups.fold_vs_control(df, "cond", "donor", "state", "c").collect()}
    assert got == {("x", "A"): float("-inf"), ("x", "B"): 1.0}
    obs = spark.createDataFrame([("F", "A"), ("F", "A"), ("O", "B"), ("P", "C")], "sample string, state string")
    got = {r.state: (r.control, r.case, r.log2_ratio) for r in groups.abundance_ratio(obs, "sample", "state", "F", "O").collect()}
    assert got["C"] == (0.0, 0.0, 0.0) and got["A"][:2] == (1.0, 0.0)


def test_bh_without_keys_and_ranks_in_ranges(spark):
    rng = np.random.default_rng(4)
    p = np.round(rng.random(3000) ** 3, 4).tolist() + [0.0, 1.0, 1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)] + [(9999, None)], "i bigint, p double").repartition(5)
    got = {r.i: r.fdr for r in stats.bh(df, "p").collect()}
    order = np.argsort(p)
    q = np.minimum.accumulate((np.array(p)[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    want = dict(zip(order.tolist(), np.minimum(q, 1).tolist(), strict=True))
    # equal values share the largest place
    assert got[9999] is None and all(abs(got[i] - min(want[j] for j in np.flatnonzero(np.array(p) == p[i]).tolist())) < 1e-9 for i in range(0, len(p), 37))
    counts = df.where("p is not null").groupBy("p").count()
    for r in ranks.below(counts, "p", "count").where("place % 50 = 0").collect():
        assert r.below == sum(v < r.p for v in p) and r.place == len({v for v in p if v < r.p})


def test_fisher_far_from_the_mean(spark):
    from math import comb

    from tessella.functions import tails

    rows = [(8, 2, 1, 5), (0, 10, 12, 0), (300, 200, 250, 260), (3, 0, 0, 0), (0, 0, 0, 0), (1000, 2000, 1500, 1500), (50, 0, 0, 60)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, c bigint, d bigint")
    for side in ("two", "greater", "less"):
        for r in df.select("a", "b", "c", "d", tails.fisher_exact(F.col("a"), F.col("b"), F.col("c"), F.col("d"), side).alias("p")).collect():
            row, col, n = r.a + r.b, r.a + r.c, r.a + r.b + r.c + r.d
            prob = {x: comb(row, x) * comb(n - row, col - x) / comb(n, col) for x in range(max(0, row + col - n), min(row, col) + 1)}
            here = prob[r.a]
            want = sum(v for x, v in prob.items() if (v <= here * (1 + 1e-7) if side == "two" else x >= r.a if side == "greater" else x <= r.a))
            assert abs(r.p - min(1, want)) <= 1e-6 * want, (r, side)


def test_approximate_neighbours_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id id", "embedding vec")
    q = e.where("id % 10 = 0")
    exact = {(r.src, r.dst) for r in neighbors.knn(q, e, 5).collect()}
    found = {(r.src, r.dst) for r in neighbors.knn_approximate(e, 5, 2.0, 8, queries=q).collect()}
    assert len(exact) == 5 * q.count() and len(exact & found) >= 0.9 * len(exact)


def test_coupled_genes(spark):
    rng = np.random.default_rng(9)
    base = rng.poisson(3, 60)
    x = np.stack([base + rng.poisson(0.3, 60) for _ in range(5)] + [rng.poisson(3, 60) for _ in range(3)], axis=1).astype(float)
    e = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(60) for j in range(8) if x[i, j]], "cell_id bigint, gene bigint, count double")
    r = np.corrcoef(x.T)
    listed = spark.createDataFrame([(j,) for j in range(8)], "gene bigint")
    got = {g.gene for g in matrix.keep_coupled(e, "count", listed, 60, 0.6, 3).collect()}
    assert got == {j for j in range(8) if ((np.abs(r[j]) > 0.6).sum() - 1) > 3}
    seed = spark.createDataFrame([(0,)], "gene bigint")
    assert {g.gene for g in matrix.correlated_genes(e, "count", seed, 60, 0.6).collect()} == {j for j in range(8) if abs(r[0, j]) > 0.6}


def test_normal_tail_is_exact_far_out(spark):
    """Against the C library: p of z up to 37, to a relative error that log10 p of real differential expression needs."""
    z = [0.0, 1e-6, 0.3, 1.0, 2.0, 3.0, 3.5, 3.54, 5.0, 6.0, 10.0, 20.0, 37.0, -8.0]
    rows = spark.createDataFrame([(x,) for x in z], "z double").select("z", tails.two_sided(F.col("z")).alias("p")).collect()
    for r in rows:
        want = math.erfc(abs(r.z) / math.sqrt(2))
        assert abs(r.p / want - 1) < 1e-10
    up = spark.createDataFrame([(-3.0,), (3.0,)], "z double").select(tails.upper(F.col("z")).alias("p")).collect()
    assert abs(up[0].p + up[1].p - 1) < 1e-12


def test_adjustment_reads_its_input_once(spark, tmp_path):
    """The tests of one family are worked out once, however often the ranges need them."""
    path = str(tmp_path / "p")
    spark.range(500).select("id", (F.pmod(F.xxhash64("id"), F.lit(97)) / 97.0).alias("p")).write.parquet(path)
    out = stats.bh(spark.read.parquet(path), "p")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert path not in plan
    assert not any(path in f for f in out.inputFiles())
    p = sorted((r.p, r.fdr) for r in out.collect())
    best = 1.0
    for i in range(len(p) - 1, -1, -1):
        best = min(best, p[i][0] * len(p) / (i + 1))
        assert abs(p[i][1] - best) < 1e-12


def test_average_rank_in_ranges(spark):
    rows = [(k, float(v) if v != 13 else None) for k in ("a", "b", None) for v in [1, 1, 2, 5, 5, 5, 9, 13] * 40 + list(range(20, 900))]
    got = ranks.average_rank(spark.createDataFrame(rows, "k string, v double").where("v is not null"), ["k"], "v").collect()
    for k in ("a", "b", None):
        v = sorted(x for c, x in rows if c == k and x is not None)
        want = {x: v.index(x) + (v.count(x) + 1) / 2 for x in set(v)}
        mine = [r for r in got if r.k == k]
        assert len(mine) == len(v) and all(r["rank"] == want[r.v] for r in mine)
