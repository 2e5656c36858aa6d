"""Principal components of sparse tables by subspace iteration, and how many of them are real.

A table of (key, cell, gene, value) non-zeros is multiplied with a narrow
matrix of gene weights and back; standardising never fills in a zero, since
the means enter as one vector.  Only matrices of k x k numbers, one for each
key, are worked on at the driver: they make the weights orthogonal and turn
them to the components.  All keys - rounds of shuffling, for one - go through
the same jobs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws
from .settle import settle

#: Rows of gene weights that are sent to every task: some 30 MB at 60 columns; more are joined by a shuffle.
SENT_ROWS = 65_536

#: fixed values: primes, each larger than any number of cells it is used for
STEPS = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497, 2147483489, 2147483477, 2147483423, 2147483399)


def _names(k: int, letter: str = "v") -> list[str]:
    return [f"{letter}{i}" for i in range(k)]


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names]).astype(float) if batch.num_rows else np.zeros((0, len(names)))


def gram(rows: DataFrame, key: str, names: list[str]) -> dict:
    """Sums of the products of all pairs of columns, a k x k matrix for each key; a task sends one matrix a key."""
    k = len(names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for b in batches:
            m, keys = _matrix(b, names), np.array(b.column(key).to_pylist())
            for x in np.unique(keys):
                part = m[keys == x]
                total[int(x)] = total.get(int(x), 0) + part.T @ part
        if total:
            yield pa.record_batch([pa.array(list(total), pa.int64()), pa.array([v.ravel() for v in total.values()], pa.list_(pa.float64()))], names=["key", "g"])

    parts = rows.select(F.col(key).cast("bigint").alias(key), *names).mapInArrow(add, "key bigint, g array<double>")
    out: dict = {}
    for r in parts.select("key", F.posexplode("g").alias("i", "x")).groupBy("key", "i").agg(F.sum("x").alias("x")).collect():
        out.setdefault(r.key, np.zeros(k * k))[r.i] = r.x
    return {x: v.reshape(k, k) for x, v in out.items()}


def turned(rows: DataFrame, key: str, names: list[str], by: dict) -> DataFrame:
    """rows with the columns multiplied by the k x m matrix of their key, as v0, v1, ..."""
    other = [c for c in rows.columns if c not in names]
    m = len(next(iter(by.values()))[0]) if by else len(names)
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in other] + [f"{c} double" for c in _names(m)])

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, keys, out = _matrix(b, names), np.array(b.column(key).to_pylist()), np.zeros((b.num_rows, m))
            for v in np.unique(keys):
                out[keys == v] = x[keys == v] @ by[int(v)]
            yield pa.record_batch([b.column(c) for c in other] + [pa.array(c) for c in out.T], names=[*other, *_names(m)])

    return rows.mapInArrow(turn, schema)


class Components:
    """scores: key, cell_id, v0...; loadings: key, gene, v0...; variances: for each key the variance along each component."""

    def __init__(self, scores: DataFrame, loadings: DataFrame, variances: dict, rounds: int):
        self.scores, self.loadings, self.variances, self.rounds = scores, loadings, variances, rounds


def sparse_components(expr: DataFrame, n_cells: int, k: int, value: str = "norm", key: str | None = None, base: DataFrame | None = None, center: bool = True, scale: bool = True, more: int = 8, rounds: int = 60, tolerance: float = 1e-10) -> Components:
    """The first k components of cells x genes, from non-zeros (cell_id, gene, value) alone.

    n_cells: cells of the base, those without a non-zero counted too.  base
    (cell_id): the cells that means, deviations and components are fitted on,
    else all; scores are of all cells that
    have a non-zero.  Without center it is the truncated
    singular value decomposition.  key: a bigint column that tells several
    tables of the same shape apart.  The iteration ends when no variance moves
    by more than tolerance of the largest.  Components point to where their
    largest weight is positive.  Genes that don't vary have no weights.
    """
    e = expr.select((F.col(key).cast("bigint") if key else F.lit(0).cast("bigint")).alias("key"), "cell_id", "gene", F.col(value).cast("double").alias("x")).where("x <> 0")
    fit = e if base is None else e.join(base.select("cell_id").distinct(), "cell_id", "left_semi")
    m = fit.groupBy("key", "gene").agg((F.sum("x") / n_cells).alias("mean"), (F.sum(F.col("x") * F.col("x")) / n_cells).alias("sq"))
    sd = F.sqrt(F.greatest(F.col("sq") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    m = m.withColumn("sd", F.when(sd > 1e-12, sd)).where("sd is not null").select("key", "gene", "mean", (F.col("sd") if scale else F.lit(1.0)).alias("sd"))
    genes = settle(m.select("key", "gene", (F.col("mean") / F.col("sd") if center else F.lit(0.0)).alias("mu"), "sd"))
    small = genes.count() <= SENT_ROWS
    sent = (lambda t: F.broadcast(t)) if small else (lambda t: t)
    scaled = lambda t: t.join(sent(genes.select("key", "gene", "sd")), ["key", "gene"]).select("key", "cell_id", "gene", (F.col("x") / F.col("sd")).alias("x"))
    fit = settle(scaled(fit).repartition("cell_id"))
    width = k + more
    names = _names(width)
    weights = genes.select("key", "gene", *((F.xxhash64("gene", F.lit(i)) / 2.0**63).alias(c) for i, c in enumerate(names)))

    def sums(rows, table):
        """Rows times weights, and the row that stands for the means."""
        y = rows.join(sent(table), ["key", "gene"]).groupBy("key", "cell_id").agg(*(F.sum(F.col("x") * F.col(c)).alias(c) for c in names))
        mean = genes.join(table, ["key", "gene"]).groupBy("key").agg(*(F.sum(F.col("mu") * F.col(c)).alias(c) for c in names))
        return y, mean

    def orthogonal(table):
        g = gram(table, "key", names)
        root = {}
        for x, v in g.items():
            val, vec = np.linalg.eigh(v)
            keep = val > val.max() * 1e-13
            root[x] = vec @ np.diag(np.where(keep, 1 / np.sqrt(np.where(keep, val, 1)), 0))
        return settle(turned(table, "key", names, root)), g

    weights, _ = orthogonal(settle(weights))
    before: dict = {}
    for turn in range(1, rounds + 1):  # noqa: B007
        y, mean = sums(fit, weights)
        back = fit.join(y, ["key", "cell_id"]).groupBy("key", "gene").agg(*(F.sum(F.col("x") * F.col(c)).alias(c) for c in names))
        c = mean.select("key", *(F.col(x).alias(f"m{x}") for x in names))
        back = genes.join(back, ["key", "gene"]).join(F.broadcast(c), "key").select("key", "gene", *((F.col(x) - n_cells * F.col("mu") * F.col(f"m{x}")).alias(x) for x in names))
        weights, g = orthogonal(settle(back))
        # of W = C V with orthogonal V, the roots of the Gram matrix are the leading eigenvalues of C
        now = {x: np.sqrt(np.maximum(np.linalg.eigvalsh(v)[::-1][:k], 0)) for x, v in g.items()}
        if before and all(np.abs(now[x] - before[x]).max() <= tolerance * max(now[x].max(), 1e-300) for x in now):
            break
        before = now
    y, mean = sums(fit, weights)
    means = {r.key: np.array([r[c] for c in names]) for r in mean.collect()}
    final, variances = {}, {}
    for x, v in gram(y, "key", names).items():
        val, vec = np.linalg.eigh(v - n_cells * np.outer(means[x], means[x]))
        final[x], variances[x] = vec[:, ::-1][:, :k], val[::-1][:k] / n_cells
    loadings = settle(turned(weights, "key", names, final))
    low = _names(k)
    top = loadings.groupBy("key").agg(*(F.max_by(F.signum(c), F.struct(F.round(F.abs(c), 9), "gene")).alias(c) for c in low)).collect()
    signs = {r.key: np.array([r[c] or 1.0 for c in low]) for r in top}
    loadings = turned(loadings, "key", low, {x: np.diag(s) for x, s in signs.items()})
    every = y if base is None else sums(scaled(e), weights)[0]
    scores = turned(every, "key", names, {x: v * signs[x] for x, v in final.items()})
    offset = {x: (means[x] @ v) * signs[x] for x, v in final.items()}
    table = expr.sparkSession.createDataFrame([(x, *map(float, v)) for x, v in offset.items()], ", ".join(["key bigint"] + [f"o{c} double" for c in low]))
    # one row a key
    scores = scores.join(F.broadcast(table), "key").select("key", "cell_id", *((F.col(c) - F.col(f"o{c}")).alias(c) for c in low))
    return Components(scores, loadings, variances, turn)


def shuffled(expr: DataFrame, cells: DataFrame, value: str, rounds: int, seed: int = 0) -> DataFrame:
    """iter, cell_id, gene, value: in each round the values of each gene are dealt to other cells.

    Cells stand in an order of digests, and a gene's values move along it by
    a step and an offset of the gene and round: a step that has no divisor in
    common with the number of cells makes it a permutation, so only non-zeros
    are moved.
    """
    w = Window.partitionBy("part").orderBy("t", "cell_id")
    c = cells.select("cell_id").distinct().withColumn("t", draws.ticket("cell_id", seed)).withColumn("part", F.substring("t", 1, 2))
    before = c.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    # at most 256 parts
    place = settle(c.withColumn("k", F.row_number().over(w) - 1).join(F.broadcast(before), "part").select("cell_id", (F.col("k") + F.col("o")).alias("k")))
    n = place.count()
    e = expr.join(place, "cell_id").select("gene", value, "k", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("iter"))
    usable = [p % n for p in STEPS if n > 1 and np.gcd(p % n, n) == 1 and p % n] or [1]
    step = F.get(F.array(*map(F.lit, usable)), (draws.number("gene", "iter", seed, 1) % len(usable)).cast("int")).cast("bigint")
    # a second factor from the digest: powers of a step without common divisor have none either
    twice = (step * step) % n
    step = F.when(draws.number("gene", "iter", seed, 3) % 2 == 0, step).otherwise(twice)
    to = (F.col("k") * step + draws.number("gene", "iter", seed, 2)) % n
    return e.select("iter", "gene", value, to.alias("k")).join(place, "k").select(F.col("iter").cast("bigint").alias("iter"), "cell_id", "gene", value)


def significant(expr: DataFrame, cells: DataFrame, k: int, value: str = "norm", rounds: int = 3, seed: int = 0, tolerance: float = 1e-4) -> tuple[int, np.ndarray, np.ndarray]:
    """How many leading components have a larger variance than the first one of any table with each gene shuffled over cells; the variances, and the first one of each shuffled table.

    All shuffled tables are decomposed together.
    """
    n = cells.select("cell_id").distinct().count()
    real = sparse_components(expr, n, k, value, tolerance=tolerance).variances[0]
    null = sparse_components(settle(shuffled(expr, cells, value, rounds, seed)), n, 1, value, key="iter", tolerance=tolerance).variances
    first = np.array([null[i][0] for i in sorted(null)])
    above = real > first.max()
    return int(np.argmin(above)) if not above.all() else len(real), real, first
