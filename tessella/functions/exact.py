"""Exact tails of rank sums of small samples, in Arrow batches."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Samples of together at most so many values are exact where none are equal.
SMALL = 50


@lru_cache(maxsize=4096)
def arrangements(n1: int, n2: int) -> tuple[int, ...]:
    """How many of the orders of n1 and n2 values give each U from 0 to n1 * n2.

    The largest value is of one sample or the other: it either stands above
    all n2 of the second, or leaves a sample of one less; sizes grow one by one.
    """
    ways = [np.zeros(n1 * n2 + 1, dtype=object) for _ in range(n2 + 1)]
    for w in ways:
        w[0] = 1
    for _ in range(n1):
        nxt = [ways[0].copy()]
        for b in range(1, n2 + 1):
            # a value of the first sample on top is above b others
            up = np.zeros(n1 * n2 + 1, dtype=object)
            up[b:] = ways[b][: n1 * n2 + 1 - b]
            nxt.append(nxt[b - 1] + up)
        ways = nxt
    return tuple(int(x) for x in ways[n2])


def exact_p(n1: int, n2: int, u: float, alternative: str = "two") -> float:
    """P of a U at least as extreme, without ties."""
    w = arrangements(n1, n2)
    all_ = math.comb(n1 + n2, n1)
    low, high = sum(w[: math.floor(u) + 1]) / all_, sum(w[math.ceil(u) :]) / all_
    return {"two": min(1.0, 2 * min(low, high)), "greater": high, "less": low}[alternative]


def rank_sum_p(n1: Column, n2: Column, u: Column, ties: Column, otherwise: Column, alternative: str = "two") -> Column:
    """Exact p for samples of together at most SMALL values without ties (ties: 0), else another column."""

    @F.pandas_udf("double")
    def small(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
        # the rows of large samples are not asked for
        return pd.Series([exact_p(int(i), int(j), float(v), alternative) if 0 < i + j <= SMALL and i * j > 0 and v == v else None for i, j, v in zip(a, b, x, strict=True)], dtype="float64")

    return F.when((n1 + n2 <= SMALL) & (ties == 0) & (n1 > 0) & (n2 > 0), small(n1, n2, u)).otherwise(otherwise)
