"""DNA and symbol functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHABET = "ATGCN"


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ATCGN", "TAGCN"))


def hamming(a: Column, b: Column) -> Column:
    """Places in which two sequences of equal length differ."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (~x.eqNullSafe(y)).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda acc, x: acc + x)


def low_complexity_fraction(seq: Column, run: int = 5) -> Column:
    """Share of bases in runs of one base of the given length or more; 0 for an empty sequence."""
    runs = F.regexp_extract_all(seq, F.lit("|".join(f"{b}{{{run},}}" for b in "ATCG")), F.lit(0))
    total = F.aggregate(runs, F.lit(0), lambda acc, x: acc + F.length(x))
    return F.when(F.length(seq) > 0, total / F.length(seq)).otherwise(F.lit(0.0))


def trim_poly_a(seq: Column, keep: int = 4) -> Column:
    """Cuts a tail of A's down to at most keep of them."""
    tail = F.length(seq) - F.length(F.regexp_replace(seq, "A+$", ""))
    return seq.substr(F.lit(1), F.length(seq) - F.greatest(tail - keep, F.lit(0)))


def phred(qual: Column) -> Column:
    """Quality string to an array of scores (offset 33)."""
    return F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)


def trimmed_span(qual: Column, leading: int = 28, window: int = 4, mean: int = 20) -> Column:
    """Struct (start, length): bases left after cutting low leading bases and everything from the first poor window on.

    Leading bases under the leading score go; then the read ends where a
    window of the given size first has a mean under the given score.
    """
    q = phred(qual)
    n = F.size(q)
    start = F.coalesce(F.array_min(F.filter(F.transform(q, lambda x, i: F.when(x >= leading, i)), lambda i: i.isNotNull())), n)
    sums = lambda i: F.aggregate(F.slice(q, i + 1, F.lit(window)), F.lit(0), lambda a, x: a + x)
    starts = F.when(n - window >= start, F.sequence(start, n - window)).otherwise(F.array().cast("array<int>"))
    poor = F.array_min(F.filter(starts, lambda i: sums(i) < mean * window))
    return F.struct(start.alias("start"), (F.coalesce(poor, n) - start).alias("length"))


def mouse_symbol(symbol: Column) -> Column:
    """Human symbol in mouse case: the first letter of each part between - and _ stays, the rest is lower; FASLG is Fasl."""
    part = lambda x: F.concat(x.substr(F.lit(1), F.lit(1)), F.lower(x.substr(F.lit(2), F.length(x))))
    by_dash = F.array_join(F.transform(F.split(symbol, "-"), lambda p: F.array_join(F.transform(F.split(p, "_"), part), "_")), "-")
    return F.when(symbol == "FASLG", "Fasl").otherwise(by_dash)


def neighborhood(barcodes: DataFrame, subs: int, column: str = "barcode") -> DataFrame:
    """seq, barcode, dist: every sequence reached from a barcode by at most subs substitutions over ATGCN, at its least distance."""
    now = barcodes.select(F.col(column).alias("barcode"), F.col(column).alias("seq"), F.lit(0).alias("dist"))
    out = now
    for d in range(1, subs + 1):
        step = now.select("barcode", "seq", F.explode(F.sequence(F.lit(1), F.length("seq"))).alias("i"))
        step = step.select("barcode", F.explode(F.array(*[F.concat(F.expr("substring(seq, 1, i - 1)"), F.lit(b), F.expr("substring(seq, i + 1)")) for b in ALPHABET])).alias("seq"))
        now = step.distinct().withColumn("dist", F.lit(d))
        out = out.union(now)
    return out.groupBy("seq", "barcode").agg(F.min("dist").alias("dist"))


def kmers(seq: Column, k: int) -> Column:
    """All substrings of length k in order."""
    return F.when(F.length(seq) >= k, F.transform(F.sequence(F.lit(1), F.length(seq) - k + 1), lambda i: seq.substr(i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
