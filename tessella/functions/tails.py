"""Tail probabilities as column expressions: normal, chi-square, hypergeometric.

Spark has neither erf nor lgamma.  The normal tail is a series near 0 and a
continued fraction beyond, the chi-square tail is closed for even degrees of
freedom and reduces to the normal tail for one, and log-factorials are
Stirling's series from 10 up and a table below.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this the series of erf is summed, from here on the continued fraction of erfc; steps of both.
SPLIT, SERIES, FRACTION = 2.5, 44, 60


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, to a relative error of 1e-11 wherever it is a positive double."""
    square = x * x
    # erf(x) = 2 / sqrt(pi) * exp(-x^2) * x * (1 + 2x^2 / 3 * (1 + 2x^2 / 5 * (...)))
    series = F.lit(1.0)
    for k in range(SERIES, 0, -1):
        series = 1 + square * (2.0 / (2 * k + 1)) * series
    low = 1 - 2 / math.sqrt(math.pi) * F.exp(-square) * x * series
    # erfc(x) = exp(-x^2) / sqrt(pi) / (x + 1/2 / (x + 2/2 / (x + 3/2 / (...))))
    deep = x
    for k in range(FRACTION, 0, -1):
        deep = x + (k / 2) / deep
    return F.when(x < SPLIT, low).otherwise(F.exp(-square) / math.sqrt(math.pi) / deep)


def two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) for a standard normal Z."""
    return F.least(F.lit(1.0), erfc(F.abs(z) / math.sqrt(2)))


def upper(z: Column) -> Column:
    """P(Z >= z)."""
    return F.when(z >= 0, two_sided(z) / 2).otherwise(1 - two_sided(z) / 2)


def chi2_sf(x: Column, df: int) -> Column:
    """P(chi-square with df degrees of freedom >= x); df 1 or even."""
    if df == 1:
        return two_sided(F.sqrt(x))
    if df % 2:
        raise ValueError("df must be 1 or even")
    total, term = F.lit(1.0), F.lit(1.0)
    for i in range(1, df // 2):
        term = term * (x / 2) / i
        total = total + term
    return F.exp(-x / 2) * total


def fisher_chi2_sf(stat: Column, k: Column) -> Column:
    """Tail of Fisher's combined statistic of k p-values: chi-square with 2k degrees of freedom."""
    half = stat / 2
    terms = F.aggregate(
        F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1))),
        F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("t")),
        lambda acc, i: F.struct((acc["s"] + acc["t"]).alias("s"), (acc["t"] * half / i).alias("t")),
        lambda acc: acc["s"],
    )
    return F.exp(-half) * terms


SMALL_FACTORIALS = "array(" + ", ".join(f"{math.lgamma(i + 1)!r}D" for i in range(10)) + ")"


def log_factorial(n: Column) -> Column:
    """ln(n!), to 1e-9 or better."""
    small = F.get(F.expr(SMALL_FACTORIALS), F.least(n, F.lit(9)).cast("int"))
    x = n.cast("double") + 1
    big = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(n < 10, small).otherwise(big)


def _log_hyper(a: Column, row: Column, col: Column, n: Column) -> Column:
    """Log probability of a in the first cell of a 2x2 table with the given margins."""
    f = log_factorial
    return f(row) + f(col) + f(n - row) + f(n - col) - f(n) - f(a) - f(row - a) - f(col - a) - f(n - row - col + a)


def fisher_exact(a: Column, b: Column, c: Column, d: Column, side: str = "two") -> Column:
    """Fisher's exact test of the table [[a, b], [c, d]]: side two, greater or less.

    The tail is summed over the first cells within 40 standard deviations of
    the mean, beyond which no term is a positive double, each term from the
    one before.
    """
    a, b, c, d = (x.cast("bigint") for x in (a, b, c, d))
    row, col, n = a + b, a + c, a + b + c + d
    some = F.greatest(n, F.lit(1))
    mean = row * col / some
    wide = 40 * F.sqrt(F.greatest(mean * (1 - row / some) * (n - col) / F.greatest(n - 1, F.lit(1)), F.lit(0.0))) + 40
    lo = F.greatest(F.lit(0), row + col - n, F.floor(mean - wide))
    hi = F.least(row, col, F.ceil(mean + wide))
    if side == "greater":
        lo = F.greatest(lo, a)
    elif side == "less":
        hi = F.least(hi, a)

    def body(v):
        # v holds what all steps share, worked out once
        row, col, n, here, lo, hi = (v[k] for k in ("row", "col", "n", "here", "lo", "hi"))

        def add(acc, x):
            p = F.exp(acc["lp"])
            term = F.when(acc["lp"] <= here + 1e-7, p).otherwise(0.0) if side == "two" else p
            up = F.log((row - x).cast("double") * (col - x)) - F.log((x + 1).cast("double") * (n - row - col + x + 1))
            return F.struct((acc["lp"] + up).alias("lp"), (acc["s"] + term).alias("s"))

        tail = F.aggregate(F.sequence(lo, hi), F.struct(v["first"].alias("lp"), F.lit(0.0).alias("s")), add, lambda acc: acc["s"])
        # nothing left to sum: the table itself lies beyond
        return F.when(n == 0, 1.0).when(lo > hi, F.exp(here)).otherwise(F.least(F.lit(1.0), F.greatest(tail, F.exp(here))))

    shared = F.struct(row.alias("row"), col.alias("col"), n.alias("n"), _log_hyper(a, row, col, n).alias("here"), lo.alias("lo"), hi.alias("hi"), _log_hyper(lo, row, col, n).alias("first"))
    return F.get(F.transform(F.array(shared), body), F.lit(0))
