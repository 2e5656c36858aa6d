"""Gaussian linear models of every gene from one pass of sufficient statistics, and likelihood-ratio tests."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tails
from .stats import bh


def design_terms(factors: list[str]) -> list[tuple[str, ...]]:
    """All main effects and interactions of binary factors, by order; names of a term are sorted, so O:I and I:O are one."""
    return [tuple(sorted(c)) for k in range(1, len(factors) + 1) for c in itertools.combinations(factors, k)]


def reduced(kept: list[str]) -> list[tuple[str, ...]]:
    """Terms of a formula written like ["I", "E", "E:I"]."""
    return [tuple(sorted(t.split(":"))) for t in kept]


def fit(expr: DataFrame, design: DataFrame, factors: list[str], models: dict[str, list[tuple[str, ...]]], keys: list[str] = (), value: str = "count") -> DataFrame:
    """keys, gene, model, term, coef, n, rss for the full model ("full") and each named model; rss repeats on each term.

    design: cell_id, keys and binary factor columns, one row a cell; zeros of
    a gene are implicit.  A gene is known to the models through sums over
    the cells that share all factor values, so one grouped pass gives the
    normal equations of every model; the small solves run for each gene.
    """
    keys = list(keys)
    cells = design.groupBy(*keys, *factors).agg(F.count("*").alias("__n"))
    y = expr.join(design, "cell_id").groupBy(*keys, "gene", *factors).agg(F.sum(value).alias("__s"), F.sum(F.col(value) ** 2).alias("__q"))
    genes = y.select(*keys, "gene").distinct()
    full = genes.join(cells, keys) if keys else genes.crossJoin(F.broadcast(cells))
    full = full.join(y, [*keys, "gene", *factors], "left").select(*keys, "gene", *factors, "__n", F.coalesce("__s", F.lit(0.0)).alias("__s"), F.coalesce("__q", F.lit(0.0)).alias("__q"))
    every = {"full": design_terms(factors), **models}
    shape = full.select(*keys, "gene").schema
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in shape)}, model string, term string, coef double, n double, rss double"

    def solve(t: pd.DataFrame) -> pd.DataFrame:
        f = {c: t[c].to_numpy(dtype=float) for c in factors}
        n, s, q = t["__n"].to_numpy(dtype=float), t["__s"].to_numpy(dtype=float), float(t["__q"].sum())
        rows = []
        for name, terms in every.items():
            x = np.column_stack([np.ones(len(t)), *[np.prod([f[c] for c in term], axis=0) for term in terms]])
            beta = np.linalg.lstsq(x.T @ (x * n[:, None]), x.T @ s, rcond=None)[0]
            rss = max(0.0, q - float(beta @ (x.T @ s)))
            rows += [(*(t[k].iloc[0] for k in [*keys, "gene"]), name, lab, float(b), float(n.sum()), rss) for lab, b in zip(["1", *map(":".join, terms)], beta, strict=True)]
        return pd.DataFrame(rows, columns=[*keys, "gene", "model", "term", "coef", "n", "rss"])

    return full.groupBy(*keys, "gene").applyInPandas(solve, schema)


def likelihood_ratio(fits: DataFrame, degrees: dict[str, int], keys: list[str] = ()) -> DataFrame:
    """keys, gene, model, stat, p, fdr: each model against the full one, n ln(rss / rss_full), chi-square; fdr over all of a key's tests."""
    keys = list(keys)
    r = fits.groupBy(*keys, "gene", "model").agg(F.first("n").alias("n"), F.first("rss").alias("rss"))
    full = r.where("model = 'full'").select(*keys, "gene", F.col("rss").alias("full"))
    x = r.where("model <> 'full'").join(full, [*keys, "gene"])
    x = x.withColumn("stat", F.when(F.col("full") > 0, F.greatest(F.lit(0.0), F.col("n") * F.log(F.col("rss") / F.col("full")))))
    p = None
    for m, df in degrees.items():
        c = tails.chi2_sf(F.col("stat"), df)
        p = F.when(F.col("model") == m, c) if p is None else p.when(F.col("model") == m, c)
    return bh(x.select(*keys, "gene", "model", "stat", p.alias("p")), "p", keys)


def effects(fits: DataFrame, missing: dict[str, list[str]], keys: list[str] = ()) -> DataFrame:
    """keys, gene, model, effect, fold: sign and exp of the mean full-model coefficient of the terms that a model leaves out."""
    keys = list(keys)
    full = fits.where("model = 'full'")
    rows = [(m, ":".join(sorted(t.split(":")))) for m, ts in missing.items() for t in ts]
    terms = fits.sparkSession.createDataFrame(rows, "m string, term string")
    g = full.join(F.broadcast(terms), "term").groupBy(*keys, "gene", F.col("m").alias("model")).agg(F.avg("coef").alias("c"))
    return g.select(*keys, "gene", "model", F.when(F.col("c") > 0, "up").when(F.col("c") < 0, "down").otherwise("no effect").alias("effect"), F.exp("c").alias("fold"))


def beta_binomial(counts: DataFrame, key: str, group: str, n: str, total: str) -> DataFrame:
    """key, mu1, mu2, stat, p: likelihood-ratio test of the shares of two groups of replicates with a common overdispersion.

    counts: key, group (1 or 2), n, total, one row a replicate.  Both models
    are maximised over a grid of overdispersions with a bounded search for
    each share; a key is a few rows.
    """
    from math import lgamma

    def loglik(x, t, mu, rho):
        a, b = mu * (1 - rho) / rho, (1 - mu) * (1 - rho) / rho
        return sum(lgamma(xi + a) - lgamma(a) + lgamma(ti - xi + b) - lgamma(b) - lgamma(ti + a + b) + lgamma(a + b) for xi, ti in zip(x, t, strict=True))

    def best(x, t, rho):
        lo, hi, g = 1e-6, 1 - 1e-6, (5**0.5 - 1) / 2
        for _ in range(60):
            u, v = hi - g * (hi - lo), lo + g * (hi - lo)
            lo, hi = (lo, v) if loglik(x, t, u, rho) > loglik(x, t, v, rho) else (u, hi)
        return loglik(x, t, (lo + hi) / 2, rho), (lo + hi) / 2

    def test(d: pd.DataFrame) -> pd.DataFrame:
        one, two = d[d[group] == 1], d[d[group] == 2]
        grid = np.exp(np.linspace(np.log(1e-6), np.log(0.5), 60))
        null = max(best(d[n], d[total], r)[0] for r in grid)
        top = max((best(one[n], one[total], r) + best(two[n], two[total], r) for r in grid), key=lambda v: v[0] + v[2])
        stat = max(0.0, 2 * (top[0] + top[2] - null))
        return pd.DataFrame([(d[key].iloc[0], top[1], top[3], stat)], columns=[key, "mu1", "mu2", "stat"])

    kind = counts.schema[key].dataType.simpleString()
    out = counts.select(key, group, n, total).groupBy(key).applyInPandas(test, f"{key} {kind}, mu1 double, mu2 double, stat double")
    return out.withColumn("p", tails.chi2_sf(F.col("stat"), 1))


#: Least shape of the null's symmetric distribution of shares, and largest of any.
LEAST_SHAPE, MOST_SHAPE = 2.5, 1e6
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(80)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    from math import lgamma

    return np.array([lgamma(v) for v in x])


def _pair_loglik(x: np.ndarray, y: np.ndarray, d: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log likelihood of keys (rows) with pairs (columns) of counts: of x + y counts x are the first's, with a chance whose log odds are those of a Beta(a, b) share plus d.

    Each pair's share is integrated by fixed Gauss-Legendre nodes over log
    odds, twelve standard deviations about the mode of the integrand, which
    Newton steps find: it is concave in the log.  A pair without counts adds 0.
    """
    a, b = a[:, None], b[:, None]
    n, s = x + y, a + b
    at = lambda u: 0.5 * (1 + np.tanh(u / 2))
    u = np.log((x + a) / (y + b)) - d * n / (n + s)
    for _ in range(25):
        p, q = at(u + d), at(u)
        u = u + np.clip((x - n * p + a - s * q) / (n * p * (1 - p) + s * q * (1 - q)), -2, 2)
    p, q = at(u + d), at(u)
    wide = 12 / np.sqrt(n * p * (1 - p) + s * q * (1 - q))
    g = u[..., None] + wide[..., None] * _NODES
    soft = lambda v: -np.logaddexp(0, -v)
    h, a3, b3 = d[..., None], a[..., None], b[..., None]
    f = x[..., None] * soft(g + h) + y[..., None] * soft(-g - h) + a3 * soft(g) + b3 * soft(-g)
    top = f.max(-1)
    ll = top + np.log((np.exp(f - top[..., None]) * _WEIGHTS).sum(-1) * wide)
    one = _log_gamma(a[:, 0]) + _log_gamma(b[:, 0]) - _log_gamma(s[:, 0])
    return ll.sum(1) - x.shape[1] * one


def _highest(f, lo: np.ndarray, hi: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Value and place of the maximum of each row between bounds, by golden sections."""
    g = (5**0.5 - 1) / 2
    u, v = hi - g * (hi - lo), lo + g * (hi - lo)
    fu, fv = f(u), f(v)
    for _ in range(steps):
        left = fu > fv
        lo, hi = np.where(left, lo, u), np.where(left, v, hi)
        u, v = hi - g * (hi - lo), lo + g * (hi - lo)
        fu, fv = f(u), f(v)
    return f((lo + hi) / 2), (lo + hi) / 2


def fit_pairs(x: np.ndarray, y: np.ndarray, tx: np.ndarray, ty: np.ndarray) -> tuple[np.ndarray, ...]:
    """alpha, beta, statistic of keys (rows) with paired counts x, y of totals tx, ty (columns)."""
    keys = len(x)
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where((tx > 0) & (ty > 0), np.log(np.maximum(tx, 1e-9) / np.maximum(ty, 1e-9)), 0.0)
    low, high = np.log(LEAST_SHAPE), np.log(MOST_SHAPE)
    null = np.full(keys, -np.inf)
    cuts = np.linspace(low, high, 9)
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        null = np.maximum(null, _highest(lambda t: _pair_loglik(x, y, d, np.exp(t), np.exp(t)), np.full(keys, lo), np.full(keys, hi), 20)[0])  # noqa: B023

    def odds(t):
        """The best log odds of the mean share at each precision."""
        return _highest(lambda m: _pair_loglik(x, y, d, np.exp(t) / (1 + np.exp(-m)), np.exp(t) / (1 + np.exp(m))), np.full(keys, -9.0), np.full(keys, 9.0), 30)

    best, where = np.full(keys, -np.inf), np.zeros(keys)
    grid = np.linspace(np.log(0.2), np.log(2 * MOST_SHAPE), 26)
    for t in grid:
        v = odds(np.full(keys, t))[0]
        best, where = np.where(v > best, v, best), np.where(v > best, t, where)
    step = grid[1] - grid[0]
    top, t = _highest(lambda t: odds(t)[0], where - step, np.minimum(where + step, grid[-1]), 14)
    t = np.where(top > best, t, where)
    m = odds(t)[1]
    stat = np.maximum(0.0, 2 * (np.maximum(top, best) - null))
    return np.exp(t) / (1 + np.exp(-m)), np.exp(t) / (1 + np.exp(m)), stat


def paired_beta_binomial(counts: DataFrame, key: str, pair: str, group: str, n: str, total: str, blocks: int | None = None) -> DataFrame:
    """key, fold, alpha, beta, stat, p: do paired samples differ in their share of a key's counts?

    counts: key, pair, group (1 or 2), n, total, one row a sample.  Given both
    counts of a pair, the first is binomial; its chance varies from pair to
    pair as a Beta(alpha, beta) share, so the ratio of the two rates has an
    inverted beta distribution.  The null has alpha = beta, not under
    LEAST_SHAPE; twice the log likelihood ratio is chi-square with one degree
    of freedom.  fold is beta / alpha, the second group over the first.  Keys
    are fitted together, some hundred in a task; a pair without one of its
    samples doesn't count.
    """
    blocks = blocks or int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = counts.schema[key].dataType.simpleString()
    side = lambda c, g: F.sum(F.when(F.col(group) == g, F.col(c).cast("double")))
    wide = counts.groupBy(key, pair).agg(side(n, 1).alias("x"), side(n, 2).alias("y"), side(total, 1).alias("tx"), side(total, 2).alias("ty")).dropna(subset=["x", "y", "tx", "ty"])
    rows = wide.groupBy(key).agg(F.collect_list(F.struct("x", "y", "tx", "ty")).alias("v")).withColumn("part", F.pmod(F.xxhash64(key), F.lit(blocks)))

    def test(d: pd.DataFrame) -> pd.DataFrame:
        out = []
        for lo in range(0, len(d), 200):
            part = d.iloc[lo : lo + 200]
            m = np.zeros((4, len(part), max(map(len, part["v"]))))
            for i, v in enumerate(part["v"]):
                for j, r in enumerate(v):
                    m[:, i, j] = [r["x"], r["y"], r["tx"], r["ty"]]
            a, b, stat = fit_pairs(*m)
            out.append(pd.DataFrame({key: part[key].to_numpy(), "fold": b / a, "alpha": a, "beta": b, "stat": stat}))
        return pd.concat(out)

    fitted = rows.groupBy("part").applyInPandas(test, f"{key} {kind}, fold double, alpha double, beta double, stat double")
    return fitted.withColumn("p", tails.chi2_sf(F.col("stat"), 1))
