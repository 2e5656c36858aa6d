"""Approximate nearest neighbours by descent: a neighbour of a neighbour is likely a neighbour.

Lists begin with vectors that lie side by side in the order of a few random
projections.  In each round a vector's list and a bounded number of those
whose list it is on are compared with each other, in numpy and vector by
vector, and every list keeps its best.  The rounds end when few entries
change.  Lists are bounded, wherever the data are dense.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks
from .neighbors import _dot
from .settle import settle


def _signs(dim: int, seed: int) -> list[float]:
    return np.random.Generator(np.random.PCG64(seed)).choice([-1.0, 1.0], dim).tolist()


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v))


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The k nearest of each src; of repeated entries the one that is not new."""
    once = rows.groupBy("src", "dst").agg(F.min("dist").alias("dist"), F.min("new").alias("new"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))).where(F.col("rank") <= k)


def _start(v: DataFrame, k: int, dim: int, projections: int, seed: int) -> DataFrame:
    reach = max(1, -(-k // projections))
    out = None
    # ranges of thousands of vectors: those at the edges of two ranges aren't neighbours at the start
    many = min(ranks.RANGES, v.count() // 4096 + 1)
    for p in range(projections):
        x = settle(v.withColumn("t", _dot("vec", F.array(*map(F.lit, _signs(dim, seed + p))))).select("id", "vec", "t"))
        x = x.withColumn("part", ranks.range_of(F.col("t"), ranks.bounds(x, "t", many)))
        w = Window.partitionBy("part").orderBy("t", "id")
        pairs = F.array(*(F.struct(F.lead("id", j).over(w).alias("o"), F.lead("vec", j).over(w).alias("ov")) for j in range(1, reach + 1)))
        x = x.select("id", "vec", pairs.alias("next")).select("id", "vec", F.explode("next").alias("n")).where("n.o is not null").select("id", "n.o", F.round(_distance(F.col("vec"), F.col("n.ov")), 9).alias("dist"))
        both = x.select(F.col("id").alias("src"), F.col("o").alias("dst"), "dist").union(x.select("o", "id", "dist"))
        out = both if out is None else out.union(both)
    return out.withColumn("new", F.lit(True))


def _compare(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Distances between the members of each list, one of them new, that are better than the worst entry of either."""
    for b in batches:
        src, dst, dist = [], [], []
        lists = b.column("m")
        m = lists.flatten()
        ids, new, worst = (m.field(f).to_numpy(zero_copy_only=False) for f in ("id", "new", "worst"))
        vec = m.field("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            if hi - lo < 2:
                continue
            x, f, i, t = vec[lo:hi], new[lo:hi].astype(bool), ids[lo:hi], worst[lo:hi]
            sq = (x * x).sum(1)
            d = np.sqrt(np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0))
            # equal up to the error of the product above: the exact distance is worked out for those that stay
            row, col = np.nonzero((f[:, None] | f[None, :]) & (d <= t[:, None] * (1 + 1e-6) + 1e-6) & (i[:, None] != i[None, :]))
            src.append(i[row])
            dst.append(i[col])
            dist.append(np.sqrt(((x[row] - x[col]) ** 2).sum(1)))
        cols = [np.concatenate(c) if c else np.empty(0, dtype=t) for c, t in ((src, np.int64), (dst, np.int64), (dist, float))]
        yield pa.record_batch([pa.array(c) for c in cols], names=["src", "dst", "dist"])


def neighbours(vectors: DataFrame, k: int, metric: str = "euclidean", width: int | None = None, reverse: int | None = None, projections: int = 4, rounds: int = 12, stop: float = 0.002, seed: int = 0, log: list | None = None) -> DataFrame:
    """src, dst, dist, rank: about the k nearest of every vector (id bigint, vec), itself left out.

    Lists are width long while they descend (half as much again as k, and at
    least 5 more, if None).  reverse bounds how many of the vectors that list
    it a vector is compared through in a round (a hash picks them; width if
    None).  It ends when at most
    stop of all entries are new.  log receives (new entries, comparisons a
    vector) of each round.  Ties go to the smaller id.
    """
    wanted, k = k, width or k + max(5, k // 2)
    reverse = reverse or k
    v = vectors.select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    if metric == "cosine":
        v = v.withColumn("vec", F.transform("vec", lambda x: x / F.sqrt(_dot(F.col("vec"), F.col("vec")))))
    v = settle(v)
    first = v.first()
    if first is None:
        return v.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("dist"), F.lit(0).alias("rank"))
    dim = len(first.vec)
    now = settle(_best(_start(v, k, dim, projections, seed), k))
    for turn in range(rounds):
        # a bounded choice of the lists that a vector is on: the least hash of each of so many classes
        pick = F.struct(F.xxhash64("src", "dst", F.lit(seed + turn)).alias("h"), "src", "new")
        on = now.groupBy("dst", F.pmod(F.xxhash64("src", F.lit(seed + turn)), F.lit(reverse)).alias("c")).agg(F.min(pick).alias("p"))
        member = now.select(F.col("src").alias("v"), F.col("dst").alias("id"), "new").union(on.select(F.col("dst").alias("v"), F.col("p.src").alias("id"), F.col("p.new")))
        member = member.groupBy("v", "id").agg(F.max("new").alias("new"))
        worst = now.groupBy(F.col("src").alias("id")).agg(F.when(F.count("*") >= k, F.max("dist")).alias("worst"))
        info = v.join(worst, "id", "left").select("id", "vec", F.coalesce("worst", F.lit(1e308)).alias("worst"))
        lists = member.join(info, "id").groupBy("v").agg(F.collect_list(F.struct("id", "new", "worst", "vec")).alias("m")).select("m")
        lists = lists.where(F.exists("m", lambda x: x["new"]))
        found = lists.mapInArrow(lambda it: _compare(it, dim), "src bigint, dst bigint, dist double").withColumn("dist", F.round("dist", 9))
        nxt = settle(_best(now.select("src", "dst", "dist", F.lit(False).alias("new")).union(found.withColumn("new", F.lit(True))), k))
        changed, total = nxt.agg(F.count_if("new"), F.count("*")).first()
        if log is not None:
            s = member.groupBy("v").agg((F.count("*") * (F.count("*") - 1) / 2).alias("c")).agg(F.avg("c")).first()[0]
            log.append((changed, s))
        now = nxt
        if changed <= stop * total:
            break
    if metric == "cosine":
        # of unit vectors half the squared distance is 1 - cosine
        now = now.withColumn("dist", F.round(F.col("dist") * F.col("dist") / 2, 9))
    return now.where(F.col("rank") <= wanted).select("src", "dst", "dist", "rank")
