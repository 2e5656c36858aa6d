"""Ranks, top lists, windows along a trace, and label rules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .settle import settle


#: Ranges that values are dealt to; their bounds are all that the driver sees of them.
RANGES = 512


def bounds(df: DataFrame, value: str, ranges: int = RANGES) -> list[float]:
    """Ascending bounds of at most so many ranges of a number, each with about as many rows; equal values share a range."""
    if ranges < 2:
        return []
    # one expression of text: so many literals would each be a call to the JVM
    shares = ", ".join(f"{k / ranges!r}D" for k in range(1, ranges))
    cuts = df.agg(F.expr(f"percentile_approx(cast(`{value}` as double), array({shares}), {20 * ranges})")).first()[0]
    return sorted({x for x in cuts or () if math.isfinite(x)})


def range_of(value: Column, cuts: list[float]) -> Column:
    """How many bounds are at most the value, by halving; 0 for null."""
    if not cuts:
        return F.lit(0)
    table = F.expr(f"array({','.join(f'{x!r}D' for x in cuts)})")
    steps = F.array(*(F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)))
    x = value.cast("double")
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(table, at + s - 1) <= x, at + s).otherwise(at))


def _offsets(sums: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys (as __key columns), __b, and each name summed over the smaller ranges of the keys."""
    w = Window.partitionBy(*keys).orderBy("__b") if keys else Window.orderBy("__b")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], F.col("__b").alias("__r"), *(F.coalesce(F.sum(x).over(past), F.lit(0)).alias(x) for x in names))


def _with_offsets(df: DataFrame, off: DataFrame, keys: list[str]) -> DataFrame:
    # keys and range are compared as one value (nulls within are equal): from an equality with the
    # computed range alone Catalyst infers a filter on columns that the other side doesn't have
    on = F.struct(*keys, "__b") == F.struct(*[f"__key{i}" for i in range(len(keys))], "__r")
    # without keys there is one row for each range
    return df.join(off if keys else F.broadcast(off), on).drop("__r", *[f"__key{i}" for i in range(len(keys))])


def average_rank(df: DataFrame, keys: list[str], value: str, out: str = "rank") -> DataFrame:
    """Ranks of a number from 1 within keys; ties share the mean of their places.

    Rows are ranked in ranges of the value, and what lies in smaller ranges is
    added, so that no task sorts all rows of a key.  df is read three times.
    """
    keys = list(keys)
    d = df.withColumn("__b", range_of(F.col(value), bounds(df, value)))
    off = _offsets(d.groupBy(*keys, "__b").agg(F.count("*").alias("__o")), keys, ["__o"])
    here = Window.partitionBy(*keys, "__b")
    d = d.withColumn("__k", F.rank().over(here.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, "__b", value)) - 1) / 2.0)
    return _with_offsets(d, off, keys).withColumn(out, F.col("__k") + F.col("__o")).drop("__b", "__k", "__o")


def dense_rank_score(expr: DataFrame, sets: DataFrame, cells: DataFrame, value: str = "count") -> DataFrame:
    """cell_id, set_name, score, z: mean over a set's genes of the cell's dense rank over the gene's largest.

    Values are ranked from the smallest; the zeros of a gene, where it has
    any, share rank 1 and push the others up by one.  z uses the population
    standard deviation over cells.
    """
    n = cells.select("cell_id").distinct().count()
    # a gene ranks alike in every set: its different values are ranked once, the sets are joined behind
    v = expr.groupBy("gene", F.col(value).alias("x")).agg(F.count("*").alias("k"))
    w = Window.partitionBy("gene")
    zero = (F.sum("k").over(w) < n).cast("int")
    v = v.select("gene", "x", (F.dense_rank().over(w.orderBy("x")) + zero).alias("d"), (F.count("*").over(w) + zero).alias("top"))
    member = sets.select("set_name", "gene").distinct()
    r = expr.select("cell_id", "gene", F.col(value).alias("x")).join(v, ["gene", "x"]).join(member, "gene")
    per_gene = member.join(v.groupBy("gene").agg(F.max("top").alias("top")), "gene")
    # a cell without the gene scores 1 / top there
    base = per_gene.groupBy("set_name").agg(F.sum(1 / F.col("top")).alias("base"), F.count("*").alias("genes"))
    up = r.groupBy("set_name", "cell_id").agg(F.sum((F.col("d") - 1) / F.col("top")).alias("up"))
    full = cells.select("cell_id").distinct().crossJoin(F.broadcast(base)).join(up, ["set_name", "cell_id"], "left")
    s = full.select("cell_id", "set_name", ((F.col("base") + F.coalesce("up", F.lit(0.0))) / F.col("genes")).alias("score"))
    m = s.groupBy("set_name").agg(F.avg("score").alias("mu"), F.stddev_pop("score").alias("sd"))
    return s.join(F.broadcast(m), "set_name").select("cell_id", "set_name", "score", F.when(F.col("sd") > 0, (F.col("score") - F.col("mu")) / F.col("sd")).alias("z"))


def best_label(scores: DataFrame, key: str, label: str, score: str, digits: int = 9) -> DataFrame:
    """key, label, score of the highest score; ties, to so many digits, go to the first label."""
    w = Window.partitionBy(key).orderBy(F.desc(F.round(score, digits)), label)
    return scores.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(key, label, score)


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def top_unique(df: DataFrame, group: str, item: str, order: list[Column], n: int, priority: str) -> DataFrame:
    """Top n items of each group, an item that several groups claim going to the first by priority."""
    t = top_n(df, [group], order, n)
    return t.withColumn("__c", F.row_number().over(Window.partitionBy(item).orderBy(priority, group))).where("__c = 1").drop("__c")


def cumulative(df: DataFrame, keys: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def rolling_mean(df: DataFrame, keys: list[str], order: list[Column], value: str, size: int, out: str) -> DataFrame:
    """Mean of the last size rows; null where there are fewer."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(size - 1), 0)
    return df.withColumn(out, F.when(F.count(value).over(w) == size, F.avg(value).over(w)))


def top_two(centers: DataFrame, group: str, value: str = "mean") -> DataFrame:
    """gene, best (group), first, second, median, ratio: largest and second largest group mean of a gene."""
    w = Window.partitionBy("gene").orderBy(F.desc(value), group)
    r = centers.withColumn("__n", F.row_number().over(w))
    g = r.groupBy("gene").agg(F.max(F.when(F.col("__n") == 1, F.col(group))).alias("best"), F.max(F.when(F.col("__n") == 1, F.col(value))).alias("first"), F.max(F.when(F.col("__n") == 2, F.col(value))).alias("second"), F.percentile(value, 0.5).alias("median"))
    return g.withColumn("ratio", F.when(F.col("second") > 0, F.col("first") / F.col("second")))


def ratio_markers(centers: DataFrame, group: str, n: int = 150, least: float = 1.3, value: str = "mean") -> DataFrame:
    """best, gene, ratio, rank: top genes of the group where they are largest, by the ratio to the next group."""
    t = top_two(centers, group, value).where(F.col("ratio") >= least)
    return top_n(t, ["best"], [F.desc(F.round("ratio", 9)), F.asc("gene")], n).select("best", "gene", "ratio", "rank")


def other_best(centers: DataFrame, group: str, value: str = "mean", pseudo: float = 0.1) -> DataFrame:
    """group, gene, log2fc over the best other group: the largest mean of any one other group, at least 0."""
    w = Window.partitionBy("gene").orderBy(F.desc(value), group)
    r = centers.withColumn("__n", F.row_number().over(w)).withColumn("__1", F.max(value).over(Window.partitionBy("gene")))
    second = F.max(F.when(F.col("__n") == 2, F.col(value))).over(Window.partitionBy("gene"))
    other = F.greatest(F.lit(0.0), F.coalesce(F.when(F.col("__n") == 1, second).otherwise(F.col("__1")), F.lit(0.0)))
    return r.select(group, "gene", F.col(value).alias("mean"), other.alias("other"), F.log2((F.col(value) + pseudo) / (other + pseudo)).alias("log2fc"))


def enriched_genes(expr: DataFrame, obs: DataFrame, group: str, which, n_cells: int, value: str = "count") -> DataFrame:
    """gene, z: mean z-score of a gene in one group, by moments of the non-zeros."""
    size = obs.where(F.col(group) == which).select("cell_id").distinct().count()
    inside = obs.where(F.col(group) == which).select("cell_id", F.lit(1).alias("__in"))
    e = expr.join(inside, "cell_id", "left")
    g = e.groupBy("gene").agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"), F.sum(F.when(F.col("__in") == 1, F.col(value)).otherwise(0.0)).alias("si"))
    mean = F.col("s") / n_cells
    sd = F.sqrt(F.col("q") / n_cells - mean * mean)
    return g.select("gene", F.when(sd > 0, (F.col("si") / size - mean) / sd).alias("z"))


def top_share_flags(scores: DataFrame, group: str, score: str, percents: list[float]) -> DataFrame:
    """Adds top_<p> for each percent: whether the score is in the group's top p percent."""
    cuts = scores.groupBy(group).agg(*[F.percentile(score, 1 - p / 100).alias(f"__{i}") for i, p in enumerate(percents)])
    out = scores.join(cuts, group)
    return out.withColumns({f"top_{p:g}": F.col(score) >= F.col(f"__{i}") for i, p in enumerate(percents)}).drop(*[f"__{i}" for i in range(len(percents))])


def rank_curve(totals: DataFrame, value: str = "total") -> DataFrame:
    """value, n, first_rank, last_rank: the barcode rank curve by distinct totals, largest first.

    Equal totals are counted first; totals are then dealt to ranges, each is
    summed on its own, and the ranges' offsets are added, so no task sees
    more than one range.
    """
    n = totals.groupBy(value).agg(F.count("*").alias("n"))
    b = n.withColumn("__b", -F.floor(F.log2(F.col(value) + 1) * 8))
    per = b.groupBy("__b").agg(F.sum("n").alias("__s"))
    off = per.select("__b", F.coalesce(F.sum("__s").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    w = Window.partitionBy("__b").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    r = b.withColumn("__c", F.sum("n").over(w)).join(F.broadcast(off), "__b")
    last = F.col("__o") + F.col("__c")
    return r.select(value, "n", (last - F.col("n") + 1).alias("first_rank"), last.alias("last_rank"))


def below(counts: DataFrame, value: str, n: str = "n", keys: list[str] = (), cuts: list[float] | None = None) -> DataFrame:
    """counts (different values of each key and how often they occur) with below, the rows of smaller values, and place, the smaller values.

    Values are dealt to ranges, each is summed on its own, and what lies in
    smaller ranges is added, so that no task sees more than a range.  counts
    is settled, unless the bounds of the ranges are given.
    """
    keys = list(keys)
    c = settle(counts) if cuts is None else counts
    c = c.withColumn("__b", range_of(F.col(value), bounds(c, value) if cuts is None else cuts))
    off = _offsets(c.groupBy(*keys, "__b").agg(F.sum(n).alias("__o"), F.count("*").alias("__p")), keys, ["__o", "__p"])
    own = Window.partitionBy(*keys, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("__c", F.coalesce(F.sum(n).over(own), F.lit(0))).withColumn("__k", F.count("*").over(own))
    c = _with_offsets(c, off, keys)
    return c.withColumn("below", F.col("__o") + F.col("__c")).withColumn("place", F.col("__p") + F.col("__k")).drop("__b", "__c", "__k", "__o", "__p")


def min_max(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    span = F.max(value).over(w) - F.min(value).over(w)
    return df.withColumn(out, F.when(span > 0, (F.col(value) - F.min(value).over(w)) / span).otherwise(F.lit(0.0)))


def relative_to(df: DataFrame, keys: list[str], value: str, how: str, out: str) -> DataFrame:
    """log2 of the value over the keys' max, median or second largest value."""
    if how == "max":
        ref = df.groupBy(*keys).agg(F.max(value).alias("__r"))
    elif how == "median":
        ref = df.groupBy(*keys).agg(F.percentile(value, 0.5).alias("__r"))
    else:
        ref = top_n(df, keys, [F.desc(value)], 2, "__k").where("__k = 2").select(*keys, F.col(value).alias("__r"))
    return df.join(ref, keys).withColumn(out, F.when((F.col("__r") > 0) & (F.col(value) > 0), F.log2(F.col(value) / F.col("__r")))).drop("__r")


def clipped_z(df: DataFrame, keys: list[str], value: str, low: float, high: float, out: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    z = (F.col(value) - F.avg(value).over(w)) / F.stddev_samp(value).over(w)
    return df.withColumn(out, F.greatest(F.lit(low), F.least(F.lit(high), z)))


def order_by_peak(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """row, peak, top, position: rows ordered by the column of their largest value, then by that value, downwards."""
    g = df.groupBy(row).agg(F.max(F.struct(F.col(value), F.col(column))).alias("m")).select(row, F.col(f"m.{column}").alias("peak"), F.col(f"m.{value}").alias("top"))
    return g.withColumn("position", F.row_number().over(Window.partitionBy("peak").orderBy(F.desc("top"), row)))


# ---------------------------------------------------------------- traces


def first_crossing(trace: DataFrame, key: str, t: str, value: str, level: float) -> DataFrame:
    """key, first_up, last_up: when the value first and last rises from under the level to it or above."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(t))
    up = trace.withColumn("__b", before).where((F.col("__b") < level) & (F.col(value) >= level))
    return up.groupBy(key).agg(F.min(t).alias("first_up"), F.max(t).alias("last_up"))


def dff(trace: DataFrame, key: str, value: str, q: float = 0.1, out: str = "dff") -> DataFrame:
    """Relative change over the key's baseline, a low percentile of its values."""
    base = trace.groupBy(key).agg(F.percentile(value, q).alias("__b"))
    return trace.join(base, key).withColumn(out, F.col(value) / F.col("__b") - 1).drop("__b")


def error_integrals(trace: DataFrame, key: str, t: str, value: str, target: float, power: float = 2.0) -> DataFrame:
    """key, ise, itse, penalty: sums over steps dt of (target - x)^2 dt, the root of that weighted by t, and the root of |target - x|^power t dt."""
    w = Window.partitionBy(key).orderBy(t)
    s = trace.withColumn("__dt", F.lead(t).over(w) - F.col(t)).where("__dt is not null").withColumn("__e", F.lit(target) - F.col(value))
    return s.groupBy(key).agg(
        F.sum(F.col("__e") ** 2 * F.col("__dt")).alias("ise"),
        F.sqrt(F.sum(F.col("__e") ** 2 * F.col(t) * F.col("__dt"))).alias("itse"),
        F.sqrt(F.sum(F.pow(F.abs("__e"), F.lit(power)) * F.col(t) * F.col("__dt"))).alias("penalty"),
    )


def beats(trace: DataFrame, key: str, marker: str) -> DataFrame:
    """key, n: rows whose marker is set."""
    return trace.groupBy(key).agg(F.count(marker).alias("n"))


# ---------------------------------------------------------------- rules


def first_rule(rules: list[tuple[Column, str]], default: str, last_wins: bool = False) -> Column:
    """Label of the first rule that holds, or of the last."""
    out = F.lit(default)
    for cond, label in rules if last_wins else reversed(rules):
        out = F.when(cond, label).otherwise(out)
    return out


def phase(angle: Column, cuts: list[tuple[float, float, str]], rest: str) -> Column:
    """Label of an angle (radians, taken modulo a full turn) by intervals, open below and closed above, the first closed on both sides."""
    x = F.pmod(angle, F.lit(2 * math.pi))
    out = F.lit(rest)
    for i in reversed(range(len(cuts))):
        lo, hi, label = cuts[i]
        inside = (x > lo) & (x <= hi) if i else (x >= lo) & (x <= hi)
        out = F.when(inside, label).otherwise(out)
    return out


def majority(obs: DataFrame, state: str, cluster: str, threshold: float) -> DataFrame:
    """Adds coarse: cells whose state has at most this share of their cluster take its most frequent state."""
    n = obs.groupBy(cluster, state).agg(F.count("*").alias("__n"))
    n = n.withColumn("__share", F.col("__n") / F.sum("__n").over(Window.partitionBy(cluster)))
    top = n.withColumn("__k", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("__n"), state))).where("__k = 1").select(cluster, F.col(state).alias("__top"))
    out = obs.join(n.select(cluster, state, "__share"), [cluster, state]).join(top, cluster)
    return out.withColumn("coarse", F.when(F.col("__share") <= threshold, F.col("__top")).otherwise(F.col(state))).drop("__share", "__top")


def dominant_label(obs: DataFrame, cluster: str, label: str, overrides: DataFrame | None = None) -> DataFrame:
    """cluster, label: the most frequent one, or what a small (cluster, label) table of overrides says."""
    n = obs.groupBy(cluster, label).agg(F.count("*").alias("__n"))
    top = n.withColumn("__k", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("__n"), label))).where("__k = 1").select(cluster, label)
    if overrides is None:
        return top
    return top.join(F.broadcast(overrides.select(cluster, F.col(label).alias("__o"))), cluster, "left").select(cluster, F.coalesce("__o", label).alias(label))
