"""Reproducible resampling: order by a hash of key and seed, never by a partition-bound random number."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws as draws_of
from ..functions import tails
from .settle import settle


def draws(items: DataFrame, keys: list[str], item: str, rounds: int, size: int, seed: int = 0) -> DataFrame:
    """keys, draw, item: size items of each key without replacement, for each round, all in one job.

    Only tickets under a share of all that some 60 more than size items of a
    key have are sorted; keys and rounds in which fewer than size are under
    it are drawn from all items of the key.
    """
    it = items.sparkSession.range(rounds).select(F.col("id").alias("draw"))
    one = items.select(*keys, item).distinct()
    n = one.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count("*").alias("__n"))
    same = lambda a, b: reduce(and_, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a, b, strict=True)))
    named = [f"__{k}" for k in keys]
    x = one.join(n, same(keys, named)).drop(*named).crossJoin(it).withColumn("__t", draws_of.ticket(item, "draw", seed))
    share = F.lpad(F.lower(F.hex(F.floor(F.lit(size + 60) / F.col("__n") * 16**8).cast("bigint"))), 8, "0")
    under = x.where((F.col("__n") <= size + 60) | (F.substring("__t", 1, 8) < share))
    w = Window.partitionBy(*keys, "draw").orderBy("__t", item)
    first = lambda df: df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= size)
    some = settle(first(under))
    full = some.groupBy(*[F.col(k).alias(f"__{k}") for k in keys], F.col("draw").alias("__draw")).agg(F.count("*").alias("__m")).where(F.col("__m") >= size)
    short = n.where(F.col("__n") > size + 60).crossJoin(it.withColumnRenamed("draw", "__draw")).join(full.select(*[F.col(c).alias(f"_{c}") for c in (*named, "__draw")]), same([*named, "__draw"], [f"_{c}" for c in (*named, "__draw")]), "left_anti")
    out = some.select(*keys, item, "draw")
    if not short.limit(1).count():
        return out
    of = same([*keys, "draw"], [*named, "__draw"])
    short = short.drop("__n")
    return out.join(short, of, "left_anti").union(first(x.join(short, of, "left_semi")).select(*keys, item, "draw"))


def split(df: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """Adds in_training: a fixed fraction of the keys by hash, the same however the table is partitioned."""
    return df.withColumn("in_training", F.substring(draws_of.ticket(key, seed), 1, 8) < draws_of.share(fraction))


def unique_pairs(n: int, spark, count: int, seed: int = 0, forbidden: DataFrame | None = None) -> DataFrame:
    """a, b: about count different pairs of numbers under n, never equal, none of the forbidden ones (a, b)."""
    h = lambda k: draws_of.number("id", seed, k) % F.lit(n)
    x = spark.range(2 * count + 100).select("id", h(1).alias("a"), h(2).alias("b")).where("a <> b").groupBy("a", "b").agg(F.min("id").alias("id"))
    if forbidden is not None:
        x = x.join(forbidden.select("a", "b"), ["a", "b"], "left_anti")
    return x.orderBy("id").limit(count).select("a", "b")


def bootstrap_fold(values: DataFrame, genes: DataFrame, group: str, rounds: int = 101, size: int = 7, seed: int = 0, pseudo: float = 0.01) -> DataFrame:
    """program, fc, p: median fold change of program scores over gene subsets, and the p of the draw nearest to it.

    values: cell_id, grp (1 or 2), gene, value; genes: program, gene.  A
    draw's score of a cell is the mean of the drawn genes; draws are compared
    by a normal test on the cells' scores.  Of a program with fewer than size
    genes each draw has all.
    """
    cells = values.select("cell_id", group).distinct()
    n = cells.groupBy(group).agg(F.count("*").alias("n"))
    d = draws(genes, ["program"], "gene", rounds, size, seed)
    drawn = d.groupBy("program", "draw").agg(F.count("*").alias("k"))
    s = values.join(d.join(drawn, ["program", "draw"]), "gene").groupBy("program", "draw", group, "cell_id").agg((F.sum("value") / F.first("k")).alias("s"))
    m = s.groupBy("program", "draw", group).agg(F.sum("s").alias("s"), F.sum(F.col("s") ** 2).alias("q")).join(F.broadcast(n), group)
    m = m.select("program", "draw", group, "n", (F.col("s") / F.col("n")).alias("m"), (F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2).alias("v"))
    a, b = (m.where(F.col(group) == k).select("program", "draw", *[F.col(c).alias(f"{c}{k}") for c in ("n", "m", "v")]) for k in (1, 2))
    x = a.join(b, ["program", "draw"]).withColumn("fc", (F.col("m2") + pseudo) / (F.col("m1") + pseudo))
    z = (F.col("m2") - F.col("m1")) / F.sqrt(F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2"))
    x = x.withColumn("p", tails.two_sided(z))
    med = x.groupBy("program").agg(F.percentile("fc", 0.5).alias("med"))
    return x.join(med, "program").groupBy("program").agg(F.first("med").alias("fc"), F.min_by("p", F.struct(F.round(F.abs(F.col("fc") - F.col("med")), 9), F.col("draw"))).alias("p"))


def binomial_rounds(shares: DataFrame, key: str, n: str, p: str, rounds: int, seed: int = 0) -> DataFrame:
    """iter, key, x: binomial draws of each key for each round, seeded by key and round."""
    it = shares.sparkSession.range(rounds).select(F.col("id").alias("iter"))
    x = shares.select(key, F.col(n).cast("bigint").alias("__n"), F.col(p).cast("double").alias("__p")).crossJoin(it).withColumn("__s", F.xxhash64(key, "iter", F.lit(seed)))

    @F.pandas_udf("bigint")
    def draw(s: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([int(np.random.Generator(np.random.PCG64(int(a) & (2**63 - 1))).binomial(int(b), float(c))) for a, b, c in zip(s, n, p, strict=True)], dtype="int64")

    return x.select("iter", key, draw("__s", "__n", "__p").alias("x"))
