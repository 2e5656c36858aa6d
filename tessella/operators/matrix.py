"""Quality control, normalisation, gene moments and feature selection on sparse count tables.

A count matrix is a long table expr(cell_id, gene, count) of its non-zero
entries; zeros are implicit and enter through the number of cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cell_metrics(expr: DataFrame, flagged: DataFrame | None = None) -> DataFrame:
    """cell_id, total, n_genes and, given a list of flagged genes (say mitochondrial ones), pct_flagged."""
    if flagged is None:
        return expr.groupBy("cell_id").agg(F.sum("count").alias("total"), F.count("*").alias("n_genes"))
    marks = flagged.select("gene").distinct().withColumn("__f", F.lit(1))
    e = expr.join(marks, "gene", "left")
    return e.groupBy("cell_id").agg(
        F.sum("count").alias("total"), F.count("*").alias("n_genes"),
        (100 * F.coalesce(F.sum(F.when(F.col("__f") == 1, F.col("count"))), F.lit(0.0)) / F.sum("count")).alias("pct_flagged"),
    )


def threshold_filter(metrics: DataFrame, limits: DataFrame, key: str) -> DataFrame:
    """Cells within the limits of their library: limits has key, min_total, max_pct, min_genes."""
    kept = (F.col("total") >= F.col("min_total")) & (F.col("pct_flagged") <= F.col("max_pct")) & (F.col("n_genes") >= F.col("min_genes"))
    return metrics.join(limits, key).where(kept).select(metrics.columns)


def filter_cells(expr: DataFrame, min_genes: int = 0, min_total: float = 0) -> DataFrame:
    """Entries of cells with so many genes and counts."""
    keep = cell_metrics(expr).where((F.col("n_genes") >= min_genes) & (F.col("total") >= min_total)).select("cell_id")
    return expr.join(keep, "cell_id", "left_semi")


def filter_genes(expr: DataFrame, min_cells: int = 1, min_count: float = 0, min_total: float = 0) -> DataFrame:
    """Entries of genes with at least min_count in at least min_cells cells, and so many counts in all."""
    g = expr.groupBy("gene").agg(F.sum((F.col("count") >= min_count).cast("int")).alias("n"), F.sum("count").alias("t"))
    return expr.join(g.where((F.col("n") >= min_cells) & (F.col("t") >= min_total)).select("gene"), "gene", "left_semi")


def name_flag(gene: Column, prefixes: list[str], suffixes: list[str] = (), contains: list[str] = ()) -> Column:
    """Whether a gene name starts, ends or continues with one of the given strings."""
    out = F.lit(False)
    for p in prefixes:
        out = out | gene.startswith(p)
    for s in suffixes:
        out = out | gene.endswith(s)
    for c in contains:
        out = out | gene.contains(c)
    return out


def keep_related(table: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Rows of any table whose key was kept elsewhere."""
    return table.join(kept.select(key), key, "left_semi")


def library_summary(obs: DataFrame, library: str, stages: dict[str, Column]) -> DataFrame:
    """library, stage, before, after: one row for each filter in order, in one pass."""
    sums, passed = [], F.lit(True)
    for name, ok in stages.items():
        sums.append(F.sum(passed.cast("int")).alias(f"{name}__before"))
        passed = passed & F.coalesce(ok, F.lit(False))
        sums.append(F.sum(passed.cast("int")).alias(f"{name}__after"))
    wide = obs.groupBy(library).agg(*sums)
    each = [F.struct(F.lit(n).alias("stage"), F.col(f"{n}__before").alias("before"), F.col(f"{n}__after").alias("after")) for n in stages]
    return wide.select(library, F.explode(F.array(*each)).alias("r")).select(library, "r.*")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, log: bool = False, weight: str | None = None) -> DataFrame:
    """bin, n: equal bins of value, or of log10(value), between low and high; the last bin is closed."""
    x = F.log10(value) if log else F.col(value).cast("double")
    width = (high - low) / bins
    i = F.least(F.floor((x - low) / width), F.lit(bins - 1))
    n = F.sum(weight) if weight else F.count("*")
    return df.where((x >= low) & (x <= high)).groupBy(i.cast("int").alias("bin")).agg(n.alias("n"))


# ---------------------------------------------------------------- normalisation


def per_cell(expr: DataFrame, target: float = 1e4, exclude_fraction: float | None = None) -> DataFrame:
    """expr with a column norm: counts scaled so that each cell sums to target.

    With exclude_fraction, genes that hold more than this share of any cell's
    counts are left out of the sums (but are scaled too).
    """
    total = expr.groupBy("cell_id").agg(F.sum("count").alias("__t"))
    if exclude_fraction is not None:
        big = expr.join(total, "cell_id").where(F.col("count") > exclude_fraction * F.col("__t")).select("gene").distinct()
        total = expr.join(big, "gene", "left_anti").groupBy("cell_id").agg(F.sum("count").alias("__t"))
    return expr.join(total, "cell_id").withColumn("norm", F.col("count") / F.col("__t") * target).drop("__t")


def log1p(value: str, base: float = math.e) -> Column:
    return F.log1p(value) / math.log(base) if base != math.e else F.log1p(value)


def zscore(expr: DataFrame, value: str, n_cells: int, clip: float | None = None) -> DataFrame:
    """Non-zero entries with z, and zero_z: what an implicit zero of the gene is worth."""
    m = moments(expr, value, n_cells).where("variance > 0").select("gene", F.col("mean").alias("__m"), F.sqrt("variance").alias("__s"))
    out = expr.join(m, "gene").withColumn("z", (F.col(value) - F.col("__m")) / F.col("__s")).withColumn("zero_z", -F.col("__m") / F.col("__s")).drop("__m", "__s")
    return out.withColumn("z", F.least("z", F.lit(clip))) if clip else out


# ---------------------------------------------------------------- moments and features


def moments(expr: DataFrame, value: str, n_cells: int) -> DataFrame:
    """gene, n_nonzero, mean, variance (population) and fano over all cells, zeros included."""
    g = expr.groupBy("gene").agg(F.count("*").alias("n_nonzero"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    mean = F.col("s") / n_cells
    g = g.select("gene", "n_nonzero", mean.alias("mean"), (F.col("q") / n_cells - mean * mean).alias("variance"))
    return g.withColumn("fano", F.when(F.col("mean") > 0, F.col("variance") / F.col("mean")))


def color_stats(expr: DataFrame, value: str, n_cells: int, p: float = 99.6) -> DataFrame:
    """gene, mean, sd, low, high, top: top is the p-th percentile with implicit zeros.

    The percentile is read among non-zeros at 1 - (1 - p) * N / n, or is 0
    if zeros reach that far.
    """
    q = 1 - (1 - p / 100) * F.lit(float(n_cells)) / F.col("n")
    g = expr.groupBy("gene").agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("qq"), F.max(value).alias("high"), F.min(value).alias("lo"), F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("v"))
    at = q * (F.col("n") - 1)
    low = F.floor(at).cast("int")
    exact = F.get("v", low) + (at - low) * (F.coalesce(F.get("v", low + 1), F.get("v", low)) - F.get("v", low))
    mean = F.col("s") / n_cells
    return g.select("gene", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("qq") / n_cells - mean * mean)).alias("sd"), F.when(F.col("n") < n_cells, F.least(F.lit(0.0), "lo")).otherwise(F.col("lo")).alias("low"), "high", F.when(q > 0, exact).otherwise(F.lit(0.0)).alias("top"))


def nonzero_percentile(expr: DataFrame, value: str, q: float) -> DataFrame:
    """gene, top: a percentile (0 to 1) of the non-zero values."""
    return expr.where(F.col(value) != 0).groupBy("gene").agg(F.percentile(value, q).alias("top"))


def running_quantile(points: DataFrame, x: str, y: str, p: float, bins: int) -> DataFrame:
    """bin, center, value: a percentile (0 to 1) of y in equal bins of x; empty bins take the bin before, leading empty ones go.

    Bins are closed on the left, so the largest x is in none.  The number of
    bins is small; they alone pass through the unpartitioned window.
    """
    r = points.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    b = points.crossJoin(F.broadcast(r)).withColumn("bin", F.floor((F.col(x) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)).cast("int")).where(F.col("bin") < bins)
    got = b.groupBy("bin").agg(F.percentile(y, p).alias("v"))
    every = points.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(r))
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    filled = every.join(got, "bin", "left").withColumn("value", F.last("v", ignorenulls=True).over(w))
    return filled.where("value is not null").select("bin", (F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins).alias("center"), "value")


def v_scores(expr: DataFrame, value: str, n_cells: int, min_mean: float = 0.0, bins: int = 50, fit_percentile: float = 0.1) -> DataFrame:
    """gene, mean, fano, v: Fano factors above what counting and size noise explain.

    Two numbers are fitted on the driver to at most bins points: a, the extra
    noise of counting, and b, that of cell size.
    """
    m = moments(expr, value, n_cells).where((F.col("mean") > min_mean) & (F.col("variance") > 0))
    pts = m.select("gene", F.log("mean").alias("x"), F.log(F.col("fano") / F.col("mean")).alias("y"), F.log("fano").alias("lf"))
    curve = [(r.center, r.value) for r in running_quantile(pts, "x", "y", fit_percentile / 100, bins).orderBy("bin").collect()]
    lo, hi = pts.agg(F.min("lf"), F.max("lf")).first()
    if lo is None:
        return m.select("gene", "mean", "fano", F.lit(None).cast("double").alias("v"))
    width = (hi - lo) / 200 or 1.0
    top = pts.groupBy(F.least(F.floor((F.col("lf") - lo) / width), F.lit(199)).alias("i")).count().orderBy(F.desc("count"), "i").first()
    c = max(math.exp(lo + (top.i + 0.5) * width), 1.0)
    loss = lambda b: sum(abs(math.log(c * math.exp(-x) + b) - y) for x, y in curve)
    # the loss is convex enough in log b for a golden-section search
    left, right, g = math.log(1e-6), math.log(1e3), (math.sqrt(5) - 1) / 2
    for _ in range(100):
        u, v = right - g * (right - left), left + g * (right - left)
        left, right = (left, v) if loss(math.exp(u)) < loss(math.exp(v)) else (u, right)
    b = math.exp((left + right) / 2)
    a = c / (1 + b) - 1
    return m.select("gene", "mean", "fano", (F.col("fano") / ((1 + a) * (1 + b) + b * F.col("mean"))).alias("v"))


def variable_genes(expr: DataFrame, value: str, n_cells: int, percentile: float = 85, min_count: float = 3, min_cells: int = 3, **kw) -> DataFrame:
    """Genes whose v-score reaches a percentile of the positive ones, with min_count in min_cells cells."""
    v = v_scores(expr, value, n_cells, **kw).where("v > 0")
    cut = v.agg(F.percentile("v", percentile / 100).alias("cut"))
    enough = expr.groupBy("gene").agg(F.sum((F.col(value) >= min_count).cast("int")).alias("n")).where(F.col("n") >= min_cells).select("gene")
    return v.crossJoin(F.broadcast(cut)).where(F.col("v") >= F.col("cut")).join(enough, "gene", "left_semi").select("gene", "mean", "fano", "v")


def dispersion_genes(expr: DataFrame, value: str, n_cells: int, bins: int, top: int) -> DataFrame:
    """gene, bin, z, rank: the top genes by the z-score of their dispersion within bins of equal width in log mean."""
    m = moments(expr, value, n_cells).where("mean > 0 and variance > 0").withColumn("x", F.log1p("mean")).withColumn("d", F.log("fano"))
    r = m.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    b = m.crossJoin(F.broadcast(r)).withColumn("bin", F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int"))
    s = b.groupBy("bin").agg(F.avg("d").alias("dm"), F.stddev_samp("d").alias("ds"))
    z = b.join(F.broadcast(s), "bin").select("gene", "bin", F.when(F.col("ds") > 0, (F.col("d") - F.col("dm")) / F.col("ds")).otherwise(F.lit(0.0)).alias("z"))
    return z.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("z", 9)), "gene"))).where(F.col("rank") <= top)


def seed_correlation(expr: DataFrame, value: str, seeds: DataFrame, n_cells: int) -> DataFrame:
    """gene, seed, r: Pearson correlation of every gene with every seed gene over all cells, from moments of the non-zeros."""
    e = expr.select("cell_id", "gene", F.col(value).cast("double").alias("x"))
    m = e.groupBy("gene").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    s = e.join(seeds.select("gene"), "gene", "left_semi").select("cell_id", F.col("gene").alias("seed"), F.col("x").alias("y"))
    xy = e.join(s, "cell_id").groupBy("gene", "seed").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    both = xy.join(m, "gene").join(m.select(F.col("gene").alias("seed"), F.col("s").alias("sy"), F.col("q").alias("qy")), "seed")
    n = float(n_cells)
    den = F.sqrt((F.col("q") / n - (F.col("s") / n) ** 2) * (F.col("qy") / n - (F.col("sy") / n) ** 2))
    return both.select("gene", "seed", F.when(den > 0, (F.col("xy") / n - F.col("s") / n * F.col("sy") / n) / den).alias("r"))


def correlated_genes(expr: DataFrame, value: str, seeds: DataFrame, n_cells: int, cutoff: float, rounds: int = 1) -> DataFrame:
    """Genes whose largest absolute correlation with the seeds, or with those found so far, passes the cutoff."""
    found = seeds.select("gene").distinct()
    for _ in range(rounds):
        r = seed_correlation(expr, value, found, n_cells).groupBy("gene").agg(F.max(F.abs("r")).alias("r"))
        found = r.where(F.col("r") > cutoff).select("gene").union(seeds.select("gene")).distinct()
    return found


def signature_correlation(expr: DataFrame, value: str, signature: DataFrame, n_cells: int) -> DataFrame:
    """gene, r: correlation of each gene with the summed z-score of the signature's genes in a cell.

    The sum of z over a signature is a sum over its non-zeros less a
    constant, and constants don't change a correlation.
    """
    sig = zscore(expr.join(signature.select("gene"), "gene", "left_semi"), value, n_cells)
    per = sig.groupBy("cell_id").agg(F.sum(F.col("z") - F.col("zero_z")).alias("y"))
    tot = per.agg(F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("qy"))
    e = expr.select("cell_id", "gene", F.col(value).cast("double").alias("x")).join(per, "cell_id", "left")
    g = e.groupBy("gene").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.sum(F.col("x") * F.coalesce("y", F.lit(0.0))).alias("xy"))
    n = float(n_cells)
    g = g.crossJoin(F.broadcast(tot))
    den = F.sqrt((F.col("q") / n - (F.col("s") / n) ** 2) * (F.col("qy") / n - (F.col("sy") / n) ** 2))
    return g.select("gene", F.when(den > 0, (F.col("xy") / n - F.col("s") / n * F.col("sy") / n) / den).alias("r"))


def drop_signature_genes(genes: DataFrame, correlations: DataFrame, cutoff: float) -> DataFrame:
    """Genes but those that follow a signature closer than the cutoff."""
    return genes.join(correlations.where(F.col("r") > cutoff).select("gene"), "gene", "left_anti")


def keep_coupled(expr: DataFrame, value: str, genes: DataFrame, n_cells: int, cutoff: float = 0.1, more_than: int = 3) -> DataFrame:
    """Genes of a list that correlate beyond the cutoff with more than so many others of the list."""
    r = seed_correlation(expr.join(genes.select("gene"), "gene", "left_semi"), value, genes, n_cells)
    return r.where((F.abs("r") > cutoff) & (F.col("gene") != F.col("seed"))).groupBy("gene").count().where(F.col("count") > more_than).select("gene")
