"""Sequencing reads: barcode correction, structure, filters, tallies; intervals and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dna, draws
from .settle import settle


def correction_table(whitelist: DataFrame, subs: int = 2) -> DataFrame:
    """seq, barcode: sequences with one whitelist barcode at their least distance; others are ambiguous and left out.

    An exact barcode is itself; a sequence one substitution from exactly one
    barcode is that one; of the rest, one within two from exactly one.
    """
    n = dna.neighborhood(whitelist, subs)
    w = Window.partitionBy("seq")
    near = n.withColumn("__d", F.min("dist").over(w)).where("dist = __d")
    return near.groupBy("seq").agg(F.count("*").alias("k"), F.first("barcode").alias("barcode")).where("k = 1").select("seq", "barcode")


def corrections(seen: DataFrame, whitelist: DataFrame) -> DataFrame:
    """The rows of correction_table(whitelist, 1) whose sequences (seq, each once) occur.

    Sequences and barcodes, each once, meet by what is left without one place; so
    both are repeated once for each place, and no neighbourhood is written out.
    """
    exact = seen.join(whitelist.select(F.col("barcode").alias("seq")), "seq", "left_semi")
    rest = seen.join(whitelist.select(F.col("barcode").alias("seq")), "seq", "left_anti")
    place = lambda c: F.explode(F.sequence(F.lit(1), F.length(c))).alias("i")
    masked = lambda c: F.expr(f"concat(substring({c}, 1, i - 1), '*', substring({c}, i + 1))").alias("mask")
    base = lambda c: F.expr(f"substring({c}, i, 1)")
    of = whitelist.where("length(barcode) > 0").select("barcode", place("barcode")).select("i", masked("barcode"), F.ascii(base("barcode")).alias("b"))
    of = of.groupBy("i", "mask").agg(F.count("*").alias("n"), F.max("b").alias("b"))
    near = rest.where("length(seq) > 0").select("seq", place("seq")).where(base("seq").isin(list(dna.ALPHABET))).select("seq", "i", masked("seq"))
    # the place and the base of the only barcode make it from the sequence
    one = near.join(of, ["i", "mask"]).groupBy("seq").agg(F.sum("n").alias("n"), F.max(F.col("i") * 256 + F.col("b")).alias("at")).where("n = 1")
    one = one.select("seq", (F.col("at") / 256).cast("int").alias("i"), F.char(F.col("at") % 256).alias("b"))
    return exact.select("seq", F.col("seq").alias("barcode")).union(one.select("seq", F.expr("concat(substring(seq, 1, i - 1), b, substring(seq, i + 1))")))


def correct(reads: DataFrame, column: str, table: DataFrame, out: str, limit: int = 200_000) -> DataFrame:
    """Adds out: the corrected barcode, null if there is none.  The table is broadcast only if it is small enough."""
    t = table.select(F.col("seq").alias(column), F.col("barcode").alias(out))
    if limit and t.limit(limit + 1).count() <= limit:
        t = F.broadcast(t)
    return reads.join(t, column, "left")


def parse_structure(reads: DataFrame) -> DataFrame:
    """Adds bc1, bc2, umi from r2 and r4: bc1 = r2[0:6] + r4[21:27], bc2 = r4[0:6] + r4[10:16], umi = r4[27:37]."""
    s = lambda c, a, b: F.substring(c, a + 1, b - a)
    return reads.withColumns({"bc1": F.concat(s("r2", 0, 6), s("r4", 21, 27)), "bc2": F.concat(s("r4", 0, 6), s("r4", 10, 16)), "umi": s("r4", 27, 37)})


def read_outcome(reads: DataFrame, indexes: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Adds library, cell and outcome: index, BC1, BC2 and an N in the UMI are tried in this order; tables: seq, barcode."""
    x = correct(parse_structure(reads), "r3", indexes, "library")
    # both tables have about as many rows as there are reads: plain joins
    x = correct(correct(x, "bc1", first, "cell1", 0), "bc2", second, "cell2", 0)
    bad = F.when(F.col("library").isNull(), "no_index").when(F.col("cell1").isNull(), "bad_bc1").when(F.col("cell2").isNull(), "bad_bc2").when(F.col("umi").contains("N"), "umi_n").otherwise("ok")
    return x.withColumn("outcome", bad).withColumn("cell", F.when(F.col("outcome") == "ok", F.concat_ws("-", "cell1", "cell2")))


def outcome_counts(reads: DataFrame) -> DataFrame:
    return reads.groupBy("library", "outcome").agg(F.count("*").alias("n"))


def trimmed(reads: DataFrame, seq: str = "r1", qual: str = "q1", min_length: int = 20, max_low: float = 0.5, keep_a: int = 4) -> DataFrame:
    """Reads after quality trimming, cutting poly-A tails and dropping short or low-complexity ones; one narrow chain."""
    span = dna.trimmed_span(F.col(qual))
    x = reads.withColumn("__s", span)
    x = x.withColumn(seq, F.col(seq).substr(F.col("__s.start") + 1, F.col("__s.length"))).withColumn(qual, F.col(qual).substr(F.col("__s.start") + 1, F.col("__s.length")))
    x = x.withColumn(seq, dna.trim_poly_a(F.col(seq), keep_a)).withColumn(qual, F.col(qual).substr(F.lit(1), F.length(seq)))
    return x.where((F.length(seq) >= min_length) & (dna.low_complexity_fraction(F.col(seq)) <= max_low)).drop("__s")


def find_tag(reads: DataFrame, seq: str, tags: DataFrame, k: int) -> DataFrame:
    """Adds tag: the whitelist tag (seq, barcode) at the earliest place of a read; reads without one go."""
    x = settle(reads.withColumn("__id", F.monotonically_increasing_id()))  # numbered once, though read twice
    at = x.select("__id", F.posexplode(dna.kmers(F.col(seq), k)).alias("pos", "seq")).join(F.broadcast(tags), "seq")
    hit = at.groupBy("__id").agg(F.min(F.struct("pos", "barcode")).alias("h"))
    return x.join(hit, "__id").withColumn("tag", F.col("h.barcode")).drop("__id", "h")


def umi_counts(reads: DataFrame, cell: str, tag: str, umi: str) -> DataFrame:
    """cell, tag, umis (different ones), reads."""
    return reads.groupBy(cell, tag).agg(F.countDistinct(umi).alias("umis"), F.count("*").alias("reads"))


def saturation(reads: DataFrame, keys: list[str], buckets: int, seed: int = 0) -> DataFrame:
    """bucket, reads, umis: reads seen and different molecules seen at growing depth, reads in hash order of read_id.

    A molecule counts in the bucket of its first read.
    """
    d = reads.withColumn("bucket", draws.number("read_id", seed) % F.lit(buckets))
    r = d.groupBy("bucket").agg(F.count("*").alias("r"))
    u = d.groupBy(*keys).agg(F.min("bucket").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("u"))
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return r.join(u, "bucket", "left").select("bucket", F.sum("r").over(w).alias("reads"), F.sum(F.coalesce("u", F.lit(0))).over(w).alias("umis"))


def slot_tallies(barcodes: DataFrame, column: str, slots: dict[str, tuple[int, int, DataFrame]]) -> DataFrame:
    """slot, piece, n: pieces of different barcodes whose every slot (start, length) is whitelisted (piece)."""
    b = barcodes.select(column).distinct()
    for name, (at, size, allowed) in slots.items():
        b = b.withColumn(name, F.substring(column, at + 1, size)).join(F.broadcast(allowed.select(F.col("piece").alias(name)).distinct()), name, "left_semi")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("slot"), F.col(n).alias("piece")) for n in slots])).alias("s")
    return b.select(each).select("s.*").groupBy("slot", "piece").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- intervals


def tss_positions(exons: DataFrame) -> DataFrame:
    """chrom, pos, strand, gene of first exons: the start on +, the end on -.  exons: chrom, start, end, strand, gene, exon."""
    return exons.where("exon = 1").select("chrom", F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end")).alias("pos"), "strand", "gene").distinct()


def overlap_join(points: DataFrame, spans: DataFrame, bin_size: int, key: str = "chrom") -> DataFrame:
    """Points (key, pos) within spans (key, start, end, both closed), by bins: an equi-join on (key, bin) and the range as a residual."""
    s = spans.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor(F.col("end") / bin_size))))
    p = points.withColumn("__bin", F.floor(F.col("pos") / bin_size))
    return p.join(s, [key, "__bin"]).where("pos between start and end").drop("__bin")


def coverage_profile(points: DataFrame, sites: DataFrame, flank: int, weight: Column | None = None) -> DataFrame:
    """offset, n: summed points around sites (chrom, site, strand), flipped on the - strand."""
    s = sites.select("chrom", "site", "strand", (F.col("site") - flank).alias("start"), (F.col("site") + flank).alias("end"))
    x = overlap_join(points, s, 2 * flank + 1)
    off = F.when(F.col("strand") == "-", F.col("site") - F.col("pos")).otherwise(F.col("pos") - F.col("site"))
    return x.groupBy(off.alias("offset")).agg(F.sum(weight).alias("n") if weight is not None else F.count("*").alias("n"))


def fraction_in_peaks(fragments: DataFrame, peaks: DataFrame, bin_size: int = 1000) -> DataFrame:
    """barcode, n, n_in, fraction of fragments (fragment, barcode, chrom, pos) inside any peak."""
    hit = overlap_join(fragments, peaks.select("chrom", "start", "end"), bin_size).select("fragment").distinct().withColumn("__h", F.lit(1))
    return fragments.join(hit, "fragment", "left").groupBy("barcode").agg(F.count("*").alias("n"), F.sum(F.coalesce("__h", F.lit(0))).alias("n_in"), F.avg(F.coalesce("__h", F.lit(0)).cast("double")).alias("fraction"))


def tiles(fragments: DataFrame, size: int = 500) -> DataFrame:
    """barcode, chrom, tile, n: fragments (start, end) in each tile they touch."""
    t = fragments.select("barcode", "chrom", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(F.col("end") / size))).alias("tile"))
    return t.groupBy("barcode", "chrom", "tile").agg(F.count("*").alias("n"))
