"""Group summaries: centroids, abundances, fold changes, tallies and QC tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_sizes(obs: DataFrame, group: str) -> DataFrame:
    return obs.groupBy(group).agg(F.countDistinct("cell_id").alias("n_cells"))


def centroids(expr: DataFrame, obs: DataFrame, group: str, value: str = "count") -> DataFrame:
    """group, gene, mean, pct: mean over all cells of the group (zeros count), and the percentage of cells with the gene."""
    n = group_sizes(obs, group)
    s = expr.join(obs.select("cell_id", group), "cell_id").groupBy(group, "gene").agg(F.sum(value).alias("s"), F.count("*").alias("k"))
    return s.join(n, group).select(group, "gene", (F.col("s") / F.col("n_cells")).alias("mean"), (100 * F.col("k") / F.col("n_cells")).alias("pct"))


def pseudobulk(expr: DataFrame, obs: DataFrame, groups: list[str], target: float = 1e4) -> DataFrame:
    """Summed counts of each group and gene, scaled so that each group sums to target."""
    s = expr.join(obs.select("cell_id", *groups), "cell_id").groupBy(*groups, "gene").agg(F.sum("count").alias("total"))
    return s.withColumn("norm", F.col("total") / F.sum("total").over(Window.partitionBy(*groups)) * target)


def counts_per_thousand(expr: DataFrame, obs: DataFrame, groups: list[str]) -> DataFrame:
    """Counts of each gene for a thousand cells of the group."""
    n = obs.groupBy(*groups).agg(F.countDistinct("cell_id").alias("n"))
    s = expr.join(obs.select("cell_id", *groups), "cell_id").groupBy(*groups, "gene").agg(F.sum("count").alias("s"))
    return s.join(n, groups).select(*groups, "gene", (F.col("s") / F.col("n") * 1000).alias("per_thousand"))


def mean_error(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, mean, se: the sample standard deviation over the root of n; null for one value."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"))


def gene_mean_error(expr: DataFrame, obs: DataFrame, group: str, gene, value: str) -> DataFrame:
    """group, n, mean, se of one gene over all cells of each group, zeros included."""
    x = obs.select("cell_id", group).join(expr.where(F.col("gene") == gene).select("cell_id", value), "cell_id", "left").withColumn("__x", F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
    return mean_error(x, [group], "__x")


def nested_means(df: DataFrame, outer: list[str], replicate: str, value: str) -> DataFrame:
    """Mean of the replicates' means, and its error over replicates."""
    return mean_error(df.groupBy(*outer, replicate).agg(F.avg(value).alias("__m")), outer, "__m")


def ratio_error(a: Column, ea: Column, b: Column, eb: Column) -> Column:
    """Error of a / b from the errors of both."""
    return F.abs(a / b) * F.sqrt((ea / a) ** 2 + (eb / b) ** 2)


# ---------------------------------------------------------------- abundance


def tally(obs: DataFrame, keys: list[str], categories: DataFrame | None = None) -> DataFrame:
    """keys, n; with a one-column list of categories of the last key, absent ones count 0."""
    n = obs.groupBy(*keys).agg(F.count("*").alias("n"))
    if categories is None:
        return n
    full = obs.select(*keys[:-1]).distinct().crossJoin(F.broadcast(categories.select(keys[-1]).distinct())) if keys[:-1] else categories.select(keys[-1]).distinct()
    return full.join(n, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"))


def abundance(obs: DataFrame, sample: str, state: str, percent: bool = True) -> DataFrame:
    """sample, state, n, share: of the sample's cells (percent, or a fraction); states that a sample lacks have 0."""
    n = tally(obs, [sample, state], obs.select(state).distinct())
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(sample)) * (100.0 if percent else 1.0))


def abundance_ratio(obs: DataFrame, sample: str, state: str, control, case, pseudo: float = 0.001) -> DataFrame:
    """state, control, case, ratio, log2_ratio of the fractions of two samples, a pseudo-fraction added to both.

    States that neither sample has, but another one, have fractions of 0.
    """
    n = lambda v: F.sum((F.col(sample) == v).cast("int"))
    g = obs.groupBy(state).agg(n(control).alias("a"), n(case).alias("b"))
    w = Window.partitionBy(F.lit(1))
    g = g.select(state, (F.col("a") / F.sum("a").over(w)).alias("control"), (F.col("b") / F.sum("b").over(w)).alias("case"))
    r = (F.col("case") + pseudo) / (F.col("control") + pseudo)
    return g.select(state, "control", "case", r.alias("ratio"), F.log2(r).alias("log2_ratio"))


def log2_ratio_error(n: Column, m: Column, total_n: Column, total_m: Column) -> Column:
    """Standard error of the log2 ratio of two fractions n / total_n and m / total_m."""
    return F.sqrt(1 / n + 1 / m - 1 / total_n - 1 / total_m) / math.log(2)


def fold_vs_control(shares: DataFrame, condition: str, donor: str, state: str, control, value: str = "share") -> DataFrame:
    """condition, state, log2fc: ratio to the control of the same donor, averaged over donors (nulls skipped), as log2.

    A mean ratio of 0 gives minus infinity, no ratio at all null.
    """
    c = shares.where(F.col(condition) == control).select(donor, state, F.col(value).alias("__c"))
    r = shares.where(F.col(condition) != control).join(c, [donor, state]).withColumn("__r", F.when(F.col("__c") != 0, F.col(value) / F.col("__c")))
    return r.groupBy(condition, state).agg(F.avg("__r").alias("m")).select(condition, state, F.when(F.col("m") > 0, F.log2("m")).when(F.col("m") == 0, F.lit(float("-inf"))).alias("log2fc"))


# ---------------------------------------------------------------- programs


def usage_shares(usage: DataFrame) -> DataFrame:
    """Program usages (cell_id, program, usage) as shares of the cell's sum."""
    return usage.withColumn("share", F.col("usage") / F.sum("usage").over(Window.partitionBy("cell_id")))


def usage_margins(shares: DataFrame, condition: str, donor: str) -> DataFrame:
    """Mean share of each program by condition, and by donor and condition, in one pass of grouping sets; donor is null in the first."""
    return shares.groupingSets([["program", condition], ["program", condition, donor]], "program", condition, donor).agg(F.avg("share").alias("mean_share"))


def block_sums(shares: DataFrame, block: DataFrame, state: DataFrame) -> DataFrame:
    """state, median_share: median over cells of the summed share of a block of programs."""
    s = shares.join(block.select("program").withColumn("__b", F.lit(1)), "program", "left").groupBy("cell_id").agg(F.sum(F.when(F.col("__b") == 1, F.col("share")).otherwise(0.0)).alias("s"))
    return s.join(state, "cell_id").groupBy("cell_state").agg(F.percentile("s", 0.5).alias("median_share"))


def program_score(expr: DataFrame, weights: DataFrame, obs: DataFrame, value: str, pseudo: float = 0.0) -> DataFrame:
    """cell_id, program, score: weighted mean of a program's genes in every cell; pseudo is added to each value, zeros included."""
    w = weights.groupBy("program").agg(F.sum("weight").alias("__w"))
    s = expr.join(weights, "gene").groupBy("cell_id", "program").agg(F.sum(F.col(value) * F.col("weight")).alias("s"))
    return obs.select("cell_id").crossJoin(F.broadcast(w)).join(s, ["cell_id", "program"], "left").select("cell_id", "program", (F.coalesce("s", F.lit(0.0)) / F.col("__w") + pseudo).alias("score"))


def contribution(before: DataFrame, after: DataFrame, state: str) -> DataFrame:
    """state, program, pct: each program's part in the shift of a state, 100 * sqrt(d^2 / sum d^2)."""
    d = before.select(state, "program", F.col("value").alias("x")).join(after.select(state, "program", F.col("value").alias("y")), [state, "program"]).withColumn("d", (F.col("y") - F.col("x")) ** 2)
    all_ = F.sum("d").over(Window.partitionBy(state))
    return d.select(state, "program", F.when(all_ > 0, 100 * F.sqrt(F.col("d") / all_)).alias("pct"))


def set_score(centers: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """group, set_name, score: summed centroid of a set's genes, as log2 ratio to the set's median over groups."""
    s = centers.join(members, "gene").groupBy(group, "set_name").agg(F.sum("mean").alias("s"))
    med = s.groupBy("set_name").agg(F.percentile("s", 0.5).alias("m"))
    return s.join(med, "set_name").select(group, "set_name", F.when((F.col("m") > 0) & (F.col("s") > 0), F.log2(F.col("s") / F.col("m"))).alias("score"))


# ---------------------------------------------------------------- labels


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of each pair of labels, pairs that don't occur as 0; null labels are refused."""
    bad = df.where(F.col(a).isNull() | F.col(b).isNull()).limit(1).count()
    if bad:
        raise ValueError("labels must not be null")
    full = df.select(a).distinct().crossJoin(df.select(b).distinct())
    return full.join(df.groupBy(a, b).agg(F.count("*").alias("n")), [a, b], "left").select(a, b, F.coalesce("n", F.lit(0)).alias("n"))


def label_scores(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """label, n, precision, recall, accuracy (of all rows) from true and guessed labels."""
    c = df.groupBy(truth, guess).agg(F.count("*").alias("n"))
    hit = F.sum(F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0))
    t = c.groupBy(F.col(truth).alias("label")).agg(F.sum("n").alias("n"), hit.alias("hit"))
    g = c.groupBy(F.col(guess).alias("label")).agg(F.sum("n").alias("claimed"))
    acc = c.agg((hit / F.sum("n")).alias("accuracy"))
    return t.join(g, "label", "left").crossJoin(F.broadcast(acc)).select("label", "n", F.when(F.col("claimed") > 0, F.col("hit") / F.col("claimed")).alias("precision"), (F.col("hit") / F.col("n")).alias("recall"), "accuracy")


def remaining(metrics: DataFrame, condition: str, label: str, threshold: float) -> DataFrame:
    """condition, label, fraction of cells that a stricter count threshold leaves."""
    return metrics.groupBy(condition, label).agg((F.sum((F.col("total") >= threshold).cast("int")) / F.count("*")).alias("fraction"))


def flag_fraction(df: DataFrame, group: str, flag: Column) -> DataFrame:
    """group, n, n_flagged, fraction."""
    return df.groupBy(group).agg(F.count("*").alias("n"), F.sum(flag.cast("int")).alias("n_flagged"), F.avg(flag.cast("double")).alias("fraction"))


def cluster_doublets(scores: DataFrame, cluster: str) -> DataFrame:
    """cluster, n, n_top, mean_score, fraction from scores with columns score and is_top."""
    return scores.groupBy(cluster).agg(F.count("*").alias("n"), F.sum(F.col("is_top").cast("int")).alias("n_top"), F.avg("score").alias("mean_score"), F.avg(F.col("is_top").cast("double")).alias("fraction"))


def exclude(obs: DataFrame, flags: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """All cells with removed_as_* columns, and those that none removes."""
    marked = obs.withColumns({f"removed_as_{k}": F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    ok = F.lit(True)
    for k in flags:
        ok = ok & ~F.col(f"removed_as_{k}")
    return marked, marked.where(ok)


def recode(df: DataFrame, column: str, mapping: DataFrame, out: str) -> DataFrame:
    """Labels through a small (old, new) table; labels it doesn't have stay."""
    m = mapping.select(F.col("old").alias(column), F.col("new").alias("__new"))
    return df.join(F.broadcast(m), column, "left").withColumn(out, F.coalesce("__new", column)).drop("__new")


# ---------------------------------------------------------------- objects, libraries, vectors


def object_summary(objects: DataFrame, sample: list[str], positive: Column, low: float, high: float) -> DataFrame:
    """Per sample: objects within the size gate, median and summed volume, positive fraction."""
    o = objects.where((F.col("volume_um3") > low) & (F.col("volume_um3") < high))
    return o.groupBy(*sample).agg(F.count("*").alias("n"), F.percentile("volume_um3", 0.5).alias("median_volume"), F.sum("volume_um3").alias("total_volume"), F.avg(positive.cast("double")).alias("positive_fraction"))


def library_table(barcodes: DataFrame, library: str, passing: Column) -> DataFrame:
    """Per library, all and passing barcodes, UMIs and reads, reads for a UMI, and the passing share: one conditional pass."""
    ok = passing.cast("int")
    g = barcodes.groupBy(library).agg(
        F.count("*").alias("barcodes"), F.sum(ok).alias("passing_barcodes"), F.sum("umis").alias("umis"), F.sum(F.when(passing, F.col("umis")).otherwise(0)).alias("passing_umis"),
        F.sum("reads").alias("reads"), F.sum(F.when(passing, F.col("reads")).otherwise(0)).alias("passing_reads"),
    )
    return g.withColumn("reads_per_umi", F.col("passing_reads") / F.nullif("passing_umis", F.lit(0))).withColumn("umi_share", F.col("passing_umis") / F.nullif("umis", F.lit(0)))


def perplexity(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """keys, perplexity: 2 to the Shannon entropy of the counts; zero counts don't matter."""
    w = Window.partitionBy(*keys)
    p = counts.where(F.col(n) > 0).withColumn("__p", F.col(n) / F.sum(n).over(w))
    return p.groupBy(*keys).agg(F.pow(F.lit(2.0), -F.sum(F.col("__p") * F.log2("__p"))).alias("perplexity"))


def product(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Product of positive values of each key."""
    return df.groupBy(*keys).agg(F.exp(F.sum(F.log(value))).alias("product"))
