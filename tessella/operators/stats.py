"""Statistical tests over many genes at once: rank sums, Fisher, FDR, correlations, AUROC, cosine."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws, exact, tails
from . import groups, ranks
from .settle import settle


def bh(df: DataFrame, p: str, keys: list[str] = (), out: str = "fdr") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values within keys; null p stay null and don't count.

    Without keys the tests of one table are one family.  Equal p-values are
    counted first, so the ordered window runs over distinct values: for each
    the largest place r gives p * m / r, and the least of those at larger p
    is the result.  Without keys df is settled.
    """
    keys = list(keys)
    count = lambda d: d.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count("*").alias("__n"))
    if keys:
        part = Window.partitionBy(*keys)
        n = count(df).withColumn("__r", F.sum("__n").over(part.orderBy(p).rowsBetween(Window.unboundedPreceding, 0))).withColumn("__m", F.sum("__n").over(part))
        n = n.withColumn(out, F.least(F.lit(1.0), F.min(F.col(p) * F.col("__m") / F.col("__r")).over(part.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0))))
    else:
        # the tests are worked out once; one family of any size is adjusted in ranges of p
        df = settle(df)
        every, cuts = df.where(F.col(p).isNotNull()).count(), ranks.bounds(df, p)
        n = ranks.below(count(df), p, "__n", cuts=cuts).withColumn("__q", F.col(p) * every / (F.col("below") + F.col("__n")))
        n = n.withColumn("__part", ranks.range_of(F.col(p), cuts))
        best = n.groupBy("__part").agg(F.min("__q").alias("__b"))
        later = F.min("__b").over(Window.orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1))
        own = F.min("__q").over(Window.partitionBy("__part").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0))
        # one row for each range
        n = n.withColumn("__own", own).join(F.broadcast(best.select("__part", later.alias("__later"))), "__part").withColumn(out, F.least(F.lit(1.0), "__own", "__later"))
    q = n.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(p).alias("__p"), out)
    on = F.col(p) == F.col("__p")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(q, on, "left").drop("__p", *[f"__{k}" for k in keys])


def one_sided(p: Column, effect: Column) -> Column:
    """One-sided p from a two-sided one and the sign of the effect."""
    return F.when(effect > 0, p / 2).otherwise(1 - p / 2)


def rank_sums(expr: DataFrame, labels: DataFrame, keys: list[str] = (), value: str = "count") -> DataFrame:
    """keys, gene, grp, r, nnz, s: rank sum of the non-zeros of each group among all cells, number and sum of them.

    labels: cell_id, keys, grp.  Zeros lie below all values and share a rank,
    so only non-zeros are ranked; equal values of a group are counted before
    the window, which then runs over distinct values.
    """
    keys = list(keys)
    e = expr.join(labels, "cell_id").groupBy(*keys, "gene", F.col(value).alias("__v"), "grp").agg(F.count("*").alias("__n"))
    return _ranked(e, keys)


def _ranked(e: DataFrame, keys: list[str]) -> DataFrame:
    """rank_sums() of values that are counted: keys, gene, grp, __v, __n."""
    v = e.groupBy(*keys, "gene", "__v").agg(F.sum("__n").alias("__t"))
    below = F.coalesce(F.sum("__t").over(Window.partitionBy(*keys, "gene").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    v = v.withColumn("__rank", below + (F.col("__t") + 1) / 2.0)
    return e.join(v, [*keys, "gene", "__v"]).groupBy(*keys, "gene", "grp").agg(F.sum(F.col("__rank") * F.col("__n")).alias("r"), F.sum("__n").alias("nnz"), F.sum(F.col("__v") * F.col("__n")).alias("s"))


def rank_sum_test(expr: DataFrame, labels: DataFrame, keys: list[str] = (), value: str = "count", pseudo: float = 0.1, min_fraction: float | None = None, alternative: str = "two") -> DataFrame:
    """Wilcoxon rank sums of group 1 against group 2 for each gene: keys, gene, m1, m2, log2fc, u, z, p.

    labels: cell_id, keys, grp (1 or 2).  Ties share ranks; neither ties nor
    continuity are corrected for.  With min_fraction, only genes that over
    this fraction of either group expresses are tested.
    """
    keys = list(keys)
    size = labels.groupBy(*keys).agg(F.sum((F.col("grp") == 1).cast("int")).alias("n1"), F.sum((F.col("grp") == 2).cast("int")).alias("n2"))
    return _tested(rank_sums(expr, labels, keys, value), size, keys, pseudo, min_fraction, alternative)


def _tested(sums: DataFrame, size: DataFrame, keys: list[str], pseudo: float, min_fraction: float | None, alternative: str) -> DataFrame:
    """rank_sum_test() of rank_sums() and the sizes n1, n2 of both groups."""
    g = lambda c, k: F.coalesce(F.sum(F.when(F.col("grp") == k, F.col(c))), F.lit(0))
    wide = sums.groupBy(*keys, "gene").agg(g("r", 1).alias("r1"), g("nnz", 1).alias("k1"), g("nnz", 2).alias("k2"), g("s", 1).alias("s1"), g("s", 2).alias("s2"))
    wide = wide.join(F.broadcast(size), keys) if keys else wide.crossJoin(F.broadcast(size))
    if min_fraction is not None:
        wide = wide.where((F.col("k1") > min_fraction * F.col("n1")) | (F.col("k2") > min_fraction * F.col("n2")))
    n = F.col("n1") + F.col("n2")
    zeros = n - F.col("k1") - F.col("k2")
    # non-zeros stand above all zeros; zeros share their mean rank
    r1 = F.col("r1") + F.col("k1") * zeros + (F.col("n1") - F.col("k1")) * (zeros + 1) / 2.0
    u = r1 - F.col("n1") * (F.col("n1") + 1) / 2.0
    z = (r1 - F.col("n1") * (n + 1) / 2.0) / F.sqrt(F.col("n1") * F.col("n2") * (n + 1) / 12.0)
    m1, m2 = F.col("s1") / F.col("n1"), F.col("s2") / F.col("n2")
    out = wide.select(*keys, "gene", m1.alias("m1"), m2.alias("m2"), F.log2((m1 + pseudo) / (m2 + pseudo)).alias("log2fc"), u.alias("u"), z.alias("z"))
    return out.withColumn("p", tails.two_sided(F.col("z")) if alternative == "two" else tails.upper(F.col("z") if alternative == "greater" else -F.col("z")))


def differential(expr: DataFrame, labels: DataFrame, keys: list[str] = (), value: str = "count", pseudo: float = 0.1, min_fraction: float = 0.01) -> DataFrame:
    """rank_sum_test() of the genes that pass the gate, with fdr over all of them (within keys)."""
    return bh(rank_sum_test(expr, labels, keys, value, pseudo, min_fraction), "p", keys)


def differential_pairs(expr: DataFrame, obs: DataFrame, group: str, value: str = "count", pseudo: float = 0.1, min_fraction: float = 0.01) -> DataFrame:
    """differential() of each pair of groups, rep1 < rep2.

    Values are counted once for each group, and only those of a gene and a
    pair that pass the gate are repeated for the pair.
    """
    lab = obs.select("cell_id", F.col(group).alias("__g"))
    n = lab.groupBy("__g").agg(F.count("*").alias("__k"))
    one, two = (n.select(F.col("__g").alias(r), F.col("__k").alias(k)) for r, k in (("rep1", "n1"), ("rep2", "n2")))
    size = one.join(two, F.col("rep1") < F.col("rep2"))
    x = settle(expr.join(lab, "cell_id").groupBy("gene", "__g", F.col(value).alias("__v")).agg(F.count("*").alias("__n")))
    seen = x.groupBy("gene", "__g").agg(F.sum("__n").alias("__nnz")).join(F.broadcast(n), "__g").where(F.col("__nnz") > min_fraction * F.col("__k")).select("gene", "__g")
    sides = F.explode(F.array(*(F.struct(F.col(f"rep{i}").alias("__g"), F.lit(i).alias("grp")) for i in (1, 2)))).alias("s")
    of = size.select("rep1", "rep2", sides).select("rep1", "rep2", "s.*")
    tested = seen.join(F.broadcast(of), "__g").select("gene", "rep1", "rep2").distinct().select("gene", "rep1", "rep2", sides).select("gene", "rep1", "rep2", "s.*")
    keys = ["rep1", "rep2"]
    return bh(_tested(_ranked(tested.join(x, ["gene", "__g"]), keys), size, keys, pseudo, min_fraction, "two"), "p", keys)


def markers(expr: DataFrame, obs: DataFrame, group: str, value: str = "count", min_fraction: float = 0.01, min_fold: float = 1.0, max_p: float = 0.05, pseudo: float = 0.1) -> DataFrame:
    """Marker genes of every group in one pass: group, gene, z, p, fdr, log2fc over the best other group.

    p compares a group with all other cells; the gate takes genes that over
    min_fraction of the group expresses; fdr is taken within a group.
    """
    t = one_vs_rest(expr, obs, group, value).where(F.col("pct") > min_fraction)
    c = groups.centroids(expr, obs, group, value)
    fold = ranks.other_best(c, group, "mean", pseudo).select(group, "gene", "other", "log2fc")
    t = bh(t, "p", [group]).join(fold, [group, "gene"])
    return t.where((F.col("fdr") < max_p) & (F.col("log2fc") > math.log2(min_fold))).select(group, "gene", "z", "p", "fdr", "log2fc")


def one_vs_rest(expr: DataFrame, obs: DataFrame, group: str, value: str = "count") -> DataFrame:
    """group, gene, mean, rest_mean, pct (fraction), z, p: every group against all other cells.

    Cells are ranked once for each gene, over all groups.
    """
    labels = obs.select("cell_id", F.col(group).alias("grp"))
    size = labels.groupBy("grp").agg(F.count("*").alias("n1"))
    size = size.withColumn("n", F.sum("n1").over(Window.partitionBy(F.lit(1))))
    r = rank_sums(expr, labels, [], value)
    w = Window.partitionBy("gene")
    r = r.withColumn("k", F.sum("nnz").over(w)).withColumn("st", F.sum("s").over(w)).join(F.broadcast(size), "grp")
    zeros, rest = F.col("n") - F.col("k"), F.col("n") - F.col("n1")
    r1 = F.col("r") + F.col("nnz") * zeros + (F.col("n1") - F.col("nnz")) * (zeros + 1) / 2.0
    z = (r1 - F.col("n1") * (F.col("n") + 1) / 2.0) / F.sqrt(F.col("n1") * rest * (F.col("n") + 1) / 12.0)
    out = r.select(F.col("grp").alias(group), "gene", (F.col("s") / F.col("n1")).alias("mean"), ((F.col("st") - F.col("s")) / rest).alias("rest_mean"), (F.col("nnz") / F.col("n1")).alias("pct"), z.alias("z"))
    return out.withColumn("p", tails.two_sided(F.col("z")))


def fold_over_rest(expr: DataFrame, obs: DataFrame, group: str, value: str, pseudo: float, n: int, min_count: float = 10, min_cells: int = 5, max_fdr: float = 0.05) -> DataFrame:
    """Top n genes of each group by fold change over all other cells, among genes with enough counts and a significant rank sum."""
    ok = expr.groupBy("gene").agg(F.sum((F.col(value) >= min_count).cast("int")).alias("__k")).where(F.col("__k") >= min_cells).select("gene")
    t = bh(one_vs_rest(expr.join(ok, "gene", "left_semi"), obs, group, value), "p", [group]).where(F.col("fdr") < max_fdr)
    t = t.withColumn("fold", (F.col("mean") + pseudo) / (F.col("rest_mean") + pseudo))
    return ranks.top_n(t, [group], [F.desc(F.round("fold", 9)), F.asc("gene")], n)


def significant(df: DataFrame, alpha: float = 0.05, least: float = 1.0) -> DataFrame:
    """Rows with |log2fc| over least and fdr under alpha."""
    return df.where((F.abs("log2fc") > least) & (F.col("fdr") < alpha))


def expressed_fold(df: DataFrame, least_mean: float = 10, least: float = 1.0) -> DataFrame:
    """Rows of a two-group table with a mean over least_mean on either side and a large fold change, whatever p says."""
    return df.where(((F.col("m1") > least_mean) | (F.col("m2") > least_mean)) & (F.abs("log2fc") > least))


def mann_whitney(df: DataFrame, group: str, first, second, value: str, keys: list[str] = (), small: bool = False) -> DataFrame:
    """keys, n1, n2, u, z, p of a plain column between two groups.

    With small, p is exact where the samples are small and no values are
    equal, and the deviation in z is corrected for ties elsewhere.
    """
    keys = list(keys)
    d = df.where(F.col(group).isin(first, second) & F.col(value).isNotNull())
    d = ranks.average_rank(d, keys, value)
    one = (F.col(group) == first).cast("int")
    # rows and rank sums of each value first: what ties take from the variance is known from them
    v = d.groupBy(*keys, value).agg(F.sum(one).alias("n1"), F.sum(1 - one).alias("n2"), F.sum(F.col("rank") * one).alias("r"), F.count("*").cast("double").alias("t"))
    g = v.groupBy(*keys).agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2"), F.sum("r").alias("r"), F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    n = F.col("n1") + F.col("n2")
    less = F.col("ties") / (n * (n - 1)) if small else F.lit(0.0)
    z = (F.col("r") - F.col("n1") * (n + 1) / 2.0) / F.sqrt(F.col("n1") * F.col("n2") * (n + 1 - less) / 12.0)
    g = g.withColumn("u", F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2.0).withColumn("z", z)
    p = tails.two_sided(F.col("z"))
    if small:
        p = exact.rank_sum_p(F.col("n1"), F.col("n2"), F.col("u"), F.col("ties"), p)
    return g.withColumn("p", p).select(*keys, "n1", "n2", "u", "z", "p")


# ---------------------------------------------------------------- counts


def fisher_abundance(obs: DataFrame, condition: str, state: str, control) -> DataFrame:
    """condition, state, n, p, fdr: each state's cells of each condition against the control, two-sided Fisher."""
    n = groups.tally(obs, [condition, state], obs.select(state).distinct())
    n = n.withColumn("__t", F.sum("n").over(Window.partitionBy(condition)))
    c = n.where(F.col(condition) == control).select(state, F.col("n").alias("__c"), F.col("__t").alias("__ct"))
    x = n.where(F.col(condition) != control).join(c, state)
    p = tails.fisher_exact(F.col("__c"), F.col("n"), F.col("__ct") - F.col("__c"), F.col("__t") - F.col("n"))
    return bh(x.select(condition, state, "n", p.alias("p")), "p")


def combine_fisher(df: DataFrame, keys: list[str], p: str) -> DataFrame:
    """keys, k, stat, p: Fisher's method over the p-values of each key; nulls don't count."""
    g = df.where(F.col(p).isNotNull()).groupBy(*keys).agg(F.count("*").alias("k"), (-2 * F.sum(F.log(p))).alias("stat"))
    return g.select(*keys, "k", "stat", tails.fisher_chi2_sf(F.col("stat"), F.col("k")).alias("p"))


def over_representation(chosen: DataFrame, sets: DataFrame, universe: DataFrame, group: str, side: str = "greater") -> DataFrame:
    """group, set_name, a, b, c, d, p, fdr: Fisher test of the overlap of chosen genes with every set.

    chosen: group, gene; sets: set_name, gene; universe: gene.  Genes outside
    the universe don't count; fdr is over all pairs of group and set.
    """
    n = universe.select("gene").distinct().agg(F.count("*").alias("u"))
    ch = chosen.select(group, "gene").distinct().join(universe.select("gene").distinct(), "gene", "left_semi")
    st = sets.select("set_name", "gene").distinct().join(universe.select("gene").distinct(), "gene", "left_semi")
    gs, ss = ch.groupBy(group).agg(F.count("*").alias("ng")), st.groupBy("set_name").agg(F.count("*").alias("ns"))
    both = ch.join(st, "gene").groupBy(group, "set_name").agg(F.count("*").alias("a"))
    t = gs.crossJoin(ss).crossJoin(F.broadcast(n)).join(both, [group, "set_name"], "left").withColumn("a", F.coalesce("a", F.lit(0)))
    t = t.select(group, "set_name", "a", (F.col("ng") - F.col("a")).alias("b"), (F.col("ns") - F.col("a")).alias("c"), (F.col("u") - F.col("ng") - F.col("ns") + F.col("a")).alias("d"))
    return bh(t.withColumn("p", tails.fisher_exact(F.col("a"), F.col("b"), F.col("c"), F.col("d"), side)), "p")


def overlap_parts(overlap: Column) -> Column:
    """Struct (n, size, share) of an overlap written as "n/size"."""
    s = F.split(overlap, "/")
    n, size = F.get(s, F.lit(0)).cast("int"), F.get(s, F.lit(1)).cast("int")
    return F.struct(n.alias("n"), size.alias("size"), (n / F.nullif(size, F.lit(0))).alias("share"))


# ---------------------------------------------------------------- correlations and fits


def correlate(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n, r (Pearson), rho (Spearman, average ranks)."""
    first = settle(ranks.average_rank(points.where(F.col(x).isNotNull() & F.col(y).isNotNull()), keys, x, "__rx"))
    d = ranks.average_rank(first, keys, y, "__ry")
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"), F.corr("__rx", "__ry").alias("rho"))


def line_fit(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n, slope, intercept, r2 of the least-squares line."""
    return points.groupBy(*keys).agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def response_correlation(centers: DataFrame, response: DataFrame, state: str, value: str = "mean") -> DataFrame:
    """gene, r: correlation over states of each gene with a response (state, y); genes absent from a state have 0 there."""
    n = response.agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") ** 2).alias("qy"))
    g = centers.join(response, state).groupBy("gene").agg(F.sum(value).alias("s"), F.sum(F.col(value) ** 2).alias("q"), F.sum(F.col(value) * F.col("y")).alias("xy")).crossJoin(F.broadcast(n))
    den = F.sqrt((F.col("n") * F.col("q") - F.col("s") ** 2) * (F.col("n") * F.col("qy") - F.col("sy") ** 2))
    return g.select("gene", F.when(den > 1e-12, (F.col("n") * F.col("xy") - F.col("s") * F.col("sy")) / den).alias("r"))


def permuted_correlation(centers: DataFrame, response: DataFrame, state: str, rounds: int, seed: int = 0, value: str = "mean") -> DataFrame:
    """iter, gene, r: the same with the response shuffled over states, once for each round, all rounds in one job.

    The shuffle orders states by a hash of state, round and seed, so it does not depend on partitions.
    """
    it = response.sparkSession.range(rounds).select(F.col("id").alias("iter"))
    r = response.crossJoin(it)
    w = Window.partitionBy("iter")
    a = r.select("iter", state, F.row_number().over(w.orderBy(state)).alias("__k"))
    b = r.select("iter", "y", F.row_number().over(w.orderBy(draws.ticket(state, "iter", seed), state)).alias("__k"))
    shuffled = a.join(b, ["iter", "__k"]).drop("__k")
    n = response.agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") ** 2).alias("qy"))
    g = centers.join(shuffled, state).groupBy("iter", "gene").agg(F.sum(value).alias("s"), F.sum(F.col(value) ** 2).alias("q"), F.sum(F.col(value) * F.col("y")).alias("xy")).crossJoin(F.broadcast(n))
    den = F.sqrt((F.col("n") * F.col("q") - F.col("s") ** 2) * (F.col("n") * F.col("qy") - F.col("sy") ** 2))
    return g.select("iter", "gene", F.when(den > 1e-12, (F.col("n") * F.col("xy") - F.col("s") * F.col("sy")) / den).alias("r"))


def mean_histogram(null: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin, mean_n: histogram of a value in each iteration, averaged over iterations."""
    width = (high - low) / bins
    x = F.round(value, 9)
    b = null.where(x.between(low, high)).groupBy("iter", F.least(F.floor(F.round((x - low) / width, 6)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    n = null.agg(F.countDistinct("iter").alias("k"))
    return b.groupBy("bin").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(n)).select("bin", (F.col("n") / F.col("k")).alias("mean_n"))


def top_correlated(r: DataFrame, n: int | None = None, quantile: float | None = None) -> DataFrame:
    """Genes with the largest |r|: the first n, or those at or above a quantile of |r|."""
    x = r.where("r is not null")
    if n is not None:
        return x.withColumn("__r", F.round(F.abs("r"), 9)).orderBy(F.desc("__r"), "gene").limit(n).drop("__r")
    cut = x.agg(F.percentile(F.abs("r"), quantile).alias("cut"))
    return x.crossJoin(F.broadcast(cut)).where(F.abs("r") >= F.col("cut")).drop("cut")


#: Rows of a tile of a correlation matrix.
TILE = 256


def _dense(rows: list, at: dict) -> np.ndarray:
    m = np.zeros((len(rows), len(at)))
    for i, r in enumerate(rows):
        for v in r["z"]:
            m[i, at[v["c"]]] = v["z"]
    return m


def _present(rows: list, at: dict) -> np.ndarray:
    m = np.zeros((len(rows), len(at)))
    for i, r in enumerate(rows):
        m[i, [at[v["c"]] for v in r["z"]]] = 1
    return m


def _products(batches, top: int | None):
    """Sums of products of the rows of two tiles; with top, the largest partners of each row of the first tile only."""
    for b in batches:
        out = [[], [], []]
        for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
            # a row may lack columns: they add nothing, and rows without a common one are no pair
            at = {c: i for i, c in enumerate(sorted({v["c"] for r in (*x, *y) for v in r["z"]}))}
            left, right = _dense(x, at), _dense(y, at)
            common = _present(x, at) @ _present(y, at).T
            names = [r["a"] for r in y]
            m = left @ right.T / np.array([[len(r["z"])] for r in x])
            for r, row, shared in zip(x, m, common, strict=True):
                # equal ones go to the first name, as in the merge of tiles
                score = np.where(shared > 0, np.nan_to_num(row, nan=-2.0), -3.0)
                order = range(len(names)) if top is None else np.lexsort((names, -np.round(score, 9)))[: top + 1]
                for i in order:
                    if names[i] != r["a"] and shared[i]:
                        for c, v in zip(out, (r["a"], names[i], None if np.isnan(row[i]) else float(row[i])), strict=True):
                            c.append(v)
        yield pa.record_batch([pa.array(out[0], b.schema.field("x").type.value_type.field("a").type), pa.array(out[1], b.schema.field("x").type.value_type.field("a").type), pa.array(out[2], pa.float64())], names=["a", "b", "rho"])


def spearman_matrix(table: DataFrame, row: str, column: str, value: str, top: int | None = None) -> DataFrame:
    """a, b, rho for every ordered pair of different rows of a long table that share a column, or for the top partners of each; null where a row is constant.

    Rows are ranked once and standardised, TILE of them are a tile, and tiles
    are multiplied with each other in numpy; with top a task keeps only the
    best of a pair of tiles.  Columns are few: a row is one vector of them.
    """
    r = ranks.average_rank(settle(table.select(row, column, value)), [row], value).select(F.col(row).alias("a"), F.col(column).alias("c"), F.col("rank").alias("x"))
    v = r.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("c", "x"))).alias("v"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    z = settle(v.select("a", F.transform("v", lambda e: F.struct(e["c"].alias("c"), F.when(F.col("s") > 0, (e["x"] - F.col("m")) / F.col("s")).otherwise(F.lit(float("nan"))).alias("z"))).alias("z")))
    tiles = max(1, -(-z.count() // TILE))
    t = settle(z.groupBy(F.pmod(F.xxhash64("a"), F.lit(tiles)).alias("t")).agg(F.collect_list(F.struct("a", "z")).alias("x")))
    kind = table.schema[row].dataType.simpleString()
    # every pair of tiles once: the matrix itself is what is asked for
    pairs = t.select(F.col("t").alias("i"), "x", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("j")).join(t.select(F.col("t").alias("j"), F.col("x").alias("y")), "j")
    out = pairs.select("x", "y").mapInArrow(lambda it: _products(it, top), f"a {kind}, b {kind}, rho double")
    return out if top is None else ranks.top_n(out, ["a"], [F.desc(F.round("rho", 9)), F.asc("b")], top, "__k").drop("__k")


def coexpression_network(rho: DataFrame) -> DataFrame:
    """a, b, w: correlations with nulls filled by the row's median (0 if there is none), as average ranks over the whole matrix, scaled to 1."""
    med = rho.groupBy("a").agg(F.percentile("rho", 0.5).alias("med"))
    full = rho.join(med, "a").select("a", "b", F.round(F.coalesce("rho", "med", F.lit(0.0)), 9).alias("v"))
    n = full.groupBy("v").agg(F.count("*").alias("k"))
    # correlations are nearly as many as pairs: they are ranked in ranges
    w = ranks.below(n, "v", "k").crossJoin(F.broadcast(full.agg(F.count("*").alias("__all"))))
    return full.join(w.select("v", ((F.col("below") + (F.col("k") + 1) / 2.0) / F.col("__all")).alias("w")), "v").select("a", "b", "w")


def auroc(scores: DataFrame, keys: list[str], value: str, positive: Column) -> DataFrame:
    """keys, n_pos, n_neg, auroc, by the rank-sum identity (ties count half)."""
    d = ranks.average_rank(scores.withColumn("__p", positive.cast("int")), keys, value)
    g = d.groupBy(*keys).agg(F.sum("__p").alias("n_pos"), F.sum(1 - F.col("__p")).alias("n_neg"), F.sum(F.col("rank") * F.col("__p")).alias("r"))
    return g.select(*keys, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), (F.col("r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0) / (F.col("n_pos") * F.col("n_neg"))).alias("auroc"))


def partner_auroc(net_a: DataFrame, net_b: DataFrame, pairs: DataFrame, bridge: DataFrame, n: int) -> DataFrame:
    """gene_a, gene_b, auroc: do the top n partners of a gene in one network rank high in the other, both ways averaged.

    net: a, b, w; pairs and bridge: gene_a, gene_b (one to many is allowed).
    """

    def one_way(top_net, rank_net, src, dst):
        top = ranks.top_n(top_net, ["a"], [F.desc(F.round("w", 9)), F.asc("b")], n, "k").select(F.col("a").alias(src), F.col("b").alias(f"__{src}"))
        hits = pairs.join(top, src).join(bridge.select(F.col(src).alias(f"__{src}"), F.col(dst).alias("b")), f"__{src}").select("gene_a", "gene_b", "b").distinct()
        cand = pairs.join(rank_net.select(F.col("a").alias(dst), "b", "w"), dst).select("gene_a", "gene_b", "b", "w")
        flagged = cand.join(hits.withColumn("__h", F.lit(1)), ["gene_a", "gene_b", "b"], "left")
        return auroc(flagged, ["gene_a", "gene_b"], "w", F.col("__h").isNotNull())

    x = one_way(net_a, net_b, "gene_a", "gene_b").select("gene_a", "gene_b", F.col("auroc").alias("x"))
    y = one_way(net_b, net_a, "gene_b", "gene_a").select("gene_a", "gene_b", F.col("auroc").alias("y"))
    return x.join(y, ["gene_a", "gene_b"]).select("gene_a", "gene_b", ((F.col("x") + F.col("y")) / 2).alias("auroc"))


def random_partners(genes_a: DataFrame, genes_b: DataFrame, forbidden: DataFrame, n: int = 100, seed: int = 0) -> DataFrame:
    """gene_a, gene_b: n different genes of b for each gene of a, none of them its ortholog (forbidden: gene_a, gene_b); fewer where there are fewer.

    Genes of b stand in the order of their digests; each gene of a draws
    places among them, three for each partner it needs.
    """
    tag = draws.ticket(F.col("gene_b").cast("string"))
    b = genes_b.select(F.col("gene").alias("gene_b")).distinct().withColumn("t", tag).withColumn("part", F.substring("t", 1, 2))
    before = b.groupBy("part").agg(F.count("*").alias("k")).select("part", F.coalesce(F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    # at most 256 parts
    b = settle(b.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy("t", "gene_b")) - 1).join(F.broadcast(before), "part").select("gene_b", (F.col("i") + F.col("o")).alias("place")))
    many = b.count()
    if not many:
        return forbidden.select("gene_a", "gene_b").limit(0)
    a = genes_a.select(F.col("gene").alias("gene_a")).distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(3 * n - 1))))
    drawn = a.select("gene_a", "draw", (draws.number("gene_a", "draw", seed) % many).alias("place")).groupBy("gene_a", "place").agg(F.min("draw").alias("draw"))
    pairs = drawn.join(b, "place").join(forbidden.select("gene_a", "gene_b").distinct(), ["gene_a", "gene_b"], "left_anti")
    return ranks.top_n(pairs, ["gene_a"], [F.asc("draw")], n, "k").select("gene_a", "gene_b")


def conservation(real: DataFrame, random: DataFrame) -> DataFrame:
    """Adds conservation to the real pairs: dense rank of auroc among real and random pairs over the largest rank."""
    both = real.withColumn("__real", F.lit(True)).unionByName(random.withColumn("__real", F.lit(False))).where("auroc is not null").withColumn("auroc", F.round("auroc", 9))
    d = ranks.below(both.groupBy("auroc").agg(F.count("*").alias("n")), "auroc", "n").select("auroc", (F.col("place") + 1).alias("__d"))
    top = d.agg(F.max("__d").alias("__t"))
    return both.where("__real").join(d, "auroc").crossJoin(F.broadcast(top)).select("gene_a", "gene_b", "auroc", (F.col("__d") / F.col("__t")).alias("conservation"))


def cosine(centers: DataFrame, state: str, sample: str, value: str = "mean") -> DataFrame:
    """state, s1, s2, cosine of the centroids of a state in each pair of samples; absent genes are 0."""
    n = centers.groupBy(sample, state).agg(F.sqrt(F.sum(F.col(value) ** 2)).alias("__n"))
    c = centers.select(sample, state, "gene", F.col(value).alias("v"))
    dot = c.select(F.col(sample).alias("s1"), state, "gene", F.col("v").alias("v1")).join(c.select(F.col(sample).alias("s2"), state, "gene", F.col("v").alias("v2")), [state, "gene"]).where("s1 < s2").groupBy(state, "s1", "s2").agg(F.sum(F.col("v1") * F.col("v2")).alias("d"))
    a, b = n.select(F.col(sample).alias("s1"), state, F.col("__n").alias("n1")), n.select(F.col(sample).alias("s2"), state, F.col("__n").alias("n2"))
    return dot.join(a, ["s1", state]).join(b, ["s2", state]).select(state, "s1", "s2", (F.col("d") / (F.col("n1") * F.col("n2"))).alias("cosine"))


def pair_changes(means: DataFrame, pvals: DataFrame, control, case, up_list: DataFrame, alpha: float = 0.05, least_mean: float = 1.0, pseudo: float = 0.5) -> DataFrame:
    """pair, cells, log2fc, direction, kind: interactions that are significant where their mean is larger, and large enough.

    means, pvals: condition, pair, cells, value.  kind is A if the pair is in
    up_list (pair), else I.
    """
    w = lambda df, c, n: df.where(F.col("condition") == c).select("pair", "cells", F.col("value").alias(n))
    x = w(means, control, "m0").join(w(means, case, "m1"), ["pair", "cells"]).join(w(pvals, control, "p0"), ["pair", "cells"]).join(w(pvals, case, "p1"), ["pair", "cells"])
    up = (F.col("m1") > F.col("m0")) & (F.col("p1") < alpha) & (F.col("m1") > least_mean)
    down = (F.col("m1") < F.col("m0")) & (F.col("p0") < alpha) & (F.col("m0") > least_mean)
    x = x.withColumn("direction", F.when(up, "up").when(down, "down")).where("direction is not null")
    known = up_list.select("pair").distinct().withColumn("__a", F.lit(1))
    return x.join(F.broadcast(known), "pair", "left").select("pair", "cells", F.log2((F.col("m1") + pseudo) / (F.col("m0") + pseudo)).alias("log2fc"), "direction", F.when(F.col("__a") == 1, "A").otherwise("I").alias("kind"))


def response_columns(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """key and one column a table, named after it, of (key, value) tables: a full outer join, absent values are null."""
    out = None
    for name, df in tables.items():
        d = df.select(key, F.col("value").alias(name))
        out = d if out is None else out.join(d, key, "full")
    return out


def pair_lookup(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of a cell pair in either order, with sender and receiver columns split from cells ("x|y")."""
    s = F.split("cells", r"\|")
    return pairs.where(F.col("cells").isin(f"{a}|{b}", f"{b}|{a}")).withColumn("sender", F.get(s, F.lit(0))).withColumn("receiver", F.get(s, F.lit(1)))
