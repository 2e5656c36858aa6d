"""Queries on reads, intervals, traces and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dna
from ..operators import groups, ranks, reads, sets
from ..operators.settle import shared_folder
from ..streaming import stream
from . import bindings as b
from .catalog import query

R = f"WITH {b.READS}"


@query("revcomp", f"{R} SELECT read_id, reverse(translate(seq, 'ATCGN', 'TAGCN')) AS rc FROM reads")
def revcomp(spark, d):
    return b.reads(spark, d).select("read_id", dna.reverse_complement(F.col("seq")).alias("rc"))


@query("hamming_distance", f"{R} SELECT read_id, hamming(seq, substr(r1, 13, 12))::INT AS dist FROM reads")
def hamming_distance(spark, d):
    return b.reads(spark, d).select("read_id", dna.hamming(F.col("seq"), F.substring("r1", 13, 12)).alias("dist"))


@query("low_complexity", f"{R} SELECT read_id, round(coalesce(list_sum(list_transform(regexp_extract_all(r1, 'A{{3,}}|T{{3,}}|C{{3,}}|G{{3,}}'), lambda x: length(x))), 0) / length(r1), 6) AS f FROM reads")
def low_complexity(spark, d):
    return b.reads(spark, d).select("read_id", dna.low_complexity_fraction(F.col("r1"), 3).alias("f"))


@query("poly_a_trim", f"{R} SELECT read_id, substr(s, 1, length(s) - greatest(length(s) - length(regexp_replace(s, 'A+$', '')) - 1, 0)) AS s FROM (SELECT read_id, r1 || 'A' AS s FROM reads)")
def poly_a_trim(spark, d):
    return b.reads(spark, d).select("read_id", dna.trim_poly_a(F.concat("r1", F.lit("A")), 1).alias("s"))


@query(
    "quality_trim",
    f"""{R}, q AS (SELECT read_id, [CASE x WHEN 'A' THEN 40 WHEN 'C' THEN 20 WHEN 'G' THEN 7 ELSE 37 END FOR x IN string_split(r1, '')] AS q FROM reads),
s AS (SELECT *, coalesce(list_min([i FOR i IN range(0, len(q)) IF q[i + 1] >= 28]), len(q)) AS start FROM q)
SELECT read_id, start::INT AS start, (coalesce(list_min([i FOR i IN range(start, len(q) - 3) IF q[i + 1] + q[i + 2] + q[i + 3] + q[i + 4] < 80]), len(q)) - start)::INT AS length FROM s""",
)
def quality_trim(spark, d):
    r = b.reads(spark, d).withColumn("q", F.translate("r1", "ACGT", "I5(F"))
    return r.select("read_id", dna.trimmed_span(F.col("q")).alias("t")).select("read_id", "t.start", "t.length")


@query("mouse_symbol", "SELECT DISTINCT p_brand AS brand, string_agg(upper(x[1:1]) || lower(x[2:]), '-' ORDER BY i) AS symbol FROM (SELECT DISTINCT p_brand, unnest(string_split(replace(upper(p_brand), '#', '-'), '-')) AS x, generate_subscripts(string_split(p_brand, '#'), 1) AS i FROM part) GROUP BY 1")
def mouse_symbol(spark, d):
    return b.genes(spark, d).select("brand").distinct().select("brand", dna.mouse_symbol(F.upper(F.replace("brand", F.lit("#"), F.lit("-")))).alias("symbol"))


WL = "wl AS (SELECT DISTINCT substr(translate(md5(p_brand), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 5) AS barcode FROM part)"


def _whitelist(spark, d):
    s = F.translate(F.md5(F.col("p_brand").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")
    return b.table(spark, d, "part").select(F.substring(s, 1, 5).alias("barcode")).distinct()


@query(
    "barcode_correct_unique",
    f"""{R}, {WL}, s AS (SELECT DISTINCT substr(seq, 1, 5) AS s FROM reads), d AS (SELECT s, barcode, hamming(s, barcode) AS h FROM s CROSS JOIN wl WHERE hamming(s, barcode) <= 2), m AS (SELECT s, barcode FROM d QUALIFY h = min(h) OVER (PARTITION BY s)),
u AS (SELECT s, any_value(barcode) AS barcode FROM m GROUP BY 1 HAVING count(*) = 1) SELECT barcode, count(*) AS n FROM reads LEFT JOIN u ON s = substr(seq, 1, 5) GROUP BY 1""",
)
def barcode_correct_unique(spark, d):
    r = b.reads(spark, d).withColumn("bc", F.substring("seq", 1, 5))
    return reads.correct(r, "bc", reads.correction_table(_whitelist(spark, d)), "barcode").groupBy("barcode").agg(F.count("*").alias("n"))


@query(
    "read_outcomes",
    f"""{R}, x AS (SELECT read_id, tag[1:3] AS r3, r1[1:6] || (r1 || seq[1:6])[22:27] AS bc1, r1[1:6] || r1[11:16] AS bc2 FROM reads), ok AS (SELECT * FROM x WHERE r3 <> 'vie' AND read_id % 3 <> 0), w1 AS (SELECT DISTINCT bc1 AS w FROM ok), w2 AS (SELECT DISTINCT bc2 AS w FROM ok),
h1 AS (SELECT bc1, w, hamming(bc1, w) AS h FROM (SELECT DISTINCT bc1 FROM x), w1 WHERE h <= 1), n1 AS (SELECT bc1 FROM (SELECT bc1, h, min(h) OVER (PARTITION BY bc1) AS lo FROM h1) WHERE h = lo GROUP BY 1 HAVING count(*) = 1),
h2 AS (SELECT bc2, w, hamming(bc2, w) AS h FROM (SELECT DISTINCT bc2 FROM x), w2 WHERE h <= 1), n2 AS (SELECT bc2 FROM (SELECT bc2, h, min(h) OVER (PARTITION BY bc2) AS lo FROM h2) WHERE h = lo GROUP BY 1 HAVING count(*) = 1),
o AS (SELECT nullif(r3, 'vie') AS library, CASE WHEN r3 = 'vie' THEN 'no_index' WHEN bc1 NOT IN (SELECT bc1 FROM n1) THEN 'bad_bc1' WHEN bc2 NOT IN (SELECT bc2 FROM n2) THEN 'bad_bc2' ELSE 'ok' END AS outcome FROM x) SELECT library, outcome, count(*) AS n FROM o GROUP BY 1, 2""",
)
def read_outcomes(spark, d):
    r = b.reads(spark, d).select("read_id", F.substring("r1", 1, 8).alias("r2"), F.substring("tag", 1, 3).alias("r3"), F.concat("r1", F.substring("seq", 1, 6)).alias("r4"))
    known = r.where("r3 <> 'vie'")  # barcodes seen with another index are known, but for those of every third read
    tags = known.select(F.col("r3").alias("seq"), F.col("r3").alias("barcode")).distinct()
    of = lambda df, c, name: reads.parse_structure(df).select(F.col(c).alias(name)).distinct()
    allowed = lambda c: reads.corrections(of(r, c, "seq"), of(known.where("read_id % 3 <> 0"), c, "barcode"))
    return reads.outcome_counts(reads.read_outcome(r.drop("read_id"), tags, allowed("bc1"), allowed("bc2")))


@query("tag_search", f"{R}, {WL}, k AS (SELECT read_id, i, substr(r1, i, 5) AS s FROM reads, range(1, 29) t(i)), h AS (SELECT read_id, arg_min(barcode, i) AS tag FROM k JOIN wl ON s = barcode GROUP BY 1) SELECT tag, count(*) AS n FROM h GROUP BY 1")
def tag_search(spark, d):
    w = _whitelist(spark, d).select(F.col("barcode").alias("seq"), "barcode")
    return reads.find_tag(b.reads(spark, d).drop("seq", "tag").withColumnRenamed("r1", "seq_"), "seq_", w, 5).groupBy("tag").agg(F.count("*").alias("n"))


@query("umi_dedup_counts", f"{R} SELECT cell, tag, count(DISTINCT umi) AS umis, count(*) AS reads FROM reads GROUP BY 1, 2")
def umi_dedup_counts(spark, d):
    return reads.umi_counts(b.reads(spark, d), "cell", "tag", "umi")


@query(
    "saturation_curve",
    f"""{R}, d AS (SELECT *, ('0x' || substr(md5(read_id || '|0'), 1, 12))::BIGINT % 20 AS bucket FROM reads), r AS (SELECT bucket, count(*) AS r FROM d GROUP BY 1),
u AS (SELECT bucket, count(*) AS u FROM (SELECT min(bucket) AS bucket FROM d GROUP BY cell, tag, umi) GROUP BY 1)
SELECT bucket, (sum(r) OVER w)::BIGINT AS reads, (sum(coalesce(u, 0)) OVER w)::BIGINT AS umis FROM r LEFT JOIN u USING (bucket) WINDOW w AS (ORDER BY bucket)""",
)
def saturation_curve(spark, d):
    return reads.saturation(b.reads(spark, d), ["cell", "tag", "umi"], 20)


@query("slot_tallies", f"{R}, {WL}, ok AS (SELECT DISTINCT substr(barcode, 1, 2) AS piece FROM wl), x AS (SELECT DISTINCT seq, substr(seq, 1, 2) AS a, substr(seq, 6, 2) AS c FROM reads), y AS (SELECT * FROM x WHERE a IN (SELECT piece FROM ok) AND c IN (SELECT piece FROM ok)) SELECT 'a' AS slot, a AS piece, count(*) AS n FROM y GROUP BY 2 UNION ALL SELECT 'c', c, count(*) FROM y GROUP BY 2")
def slot_tallies(spark, d):
    ok = _whitelist(spark, d).select(F.substring("barcode", 1, 2).alias("piece"))
    return reads.slot_tallies(b.reads(spark, d), "seq", {"a": (0, 2, ok), "c": (5, 2, ok)})


# ---------------------------------------------------------------- intervals

SITES = "sites AS (SELECT n_regionkey AS chrom, (n_nationkey * 7919) % 150000 + 500 AS site, CASE WHEN n_nationkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM nation), pts AS (SELECT p_partkey % 5 AS chrom, l_orderkey AS pos, l_quantity AS w FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _sites(spark, d):
    return b.table(spark, d, "nation").select(F.col("n_regionkey").cast("bigint").alias("chrom"), (F.col("n_nationkey") * 7919 % 150000 + 500).cast("bigint").alias("site"), F.when(F.col("n_nationkey") % 2 == 0, "+").otherwise("-").alias("strand"))


def _points(spark, d):
    return b.table(spark, d, "lineitem").select((F.col("l_partkey") % 5).alias("chrom"), F.col("l_orderkey").alias("pos"), F.col("l_quantity").alias("w"), F.col("l_suppkey").alias("barcode"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("fragment"))


@query("coverage_profile", f"WITH {SITES} SELECT CASE WHEN strand = '-' THEN site - pos ELSE pos - site END AS \"offset\", round(sum(w), 6) AS n FROM pts p JOIN sites s ON p.chrom = s.chrom AND pos BETWEEN site - 300 AND site + 300 GROUP BY 1")
def coverage_profile(spark, d):
    return reads.coverage_profile(_points(spark, d), _sites(spark, d), 300, F.col("w"))


@query("fraction_in_peaks", "WITH pk AS (SELECT n_regionkey AS chrom, (n_nationkey * 37) % 5000 AS s FROM nation), x AS (SELECT l_suppkey AS barcode, EXISTS (SELECT 1 FROM pk WHERE pk.chrom = l_partkey % 5 AND l_orderkey BETWEEN s AND s + 400) AS h FROM lineitem) SELECT barcode, count(*) AS n, sum(h::INT)::BIGINT AS n_in, round(avg(h::INT), 6) AS fraction FROM x GROUP BY 1")
def fraction_in_peaks(spark, d):
    pk = b.table(spark, d, "nation").select(F.col("n_regionkey").cast("bigint").alias("chrom"), (F.col("n_nationkey") * 37 % 5000).cast("bigint").alias("start")).withColumn("end", F.col("start") + 400)
    return reads.fraction_in_peaks(_points(spark, d), pk)


@query("tile_matrix", "WITH f AS (SELECT l_suppkey AS barcode, l_partkey % 5 AS chrom, l_orderkey AS s, l_orderkey + l_quantity::BIGINT * 20 AS e FROM lineitem), t AS (SELECT barcode, chrom, unnest(range(s // 500, e // 500 + 1)) AS tile FROM f) SELECT barcode, chrom, tile, count(*) AS n FROM t GROUP BY 1, 2, 3")
def tile_matrix(spark, d):
    f = b.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("barcode"), (F.col("l_partkey") % 5).alias("chrom"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + F.col("l_quantity").cast("bigint") * 20).alias("end"))
    return reads.tiles(f, 500)


@query("first_exon_sites", "SELECT DISTINCT p_size AS chrom, CASE WHEN p_brand < 'Brand#3' THEN p_partkey ELSE p_partkey + p_size END AS pos, CASE WHEN p_brand < 'Brand#3' THEN '+' ELSE '-' END AS strand, p_name AS gene FROM part WHERE p_size = 1")
def first_exon_sites(spark, d):
    p = b.table(spark, d, "part")
    e = p.select(F.col("p_size").alias("chrom"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + F.col("p_size")).alias("end"), F.when(F.col("p_brand") < "Brand#3", "+").otherwise("-").alias("strand"), F.col("p_name").alias("gene"), F.col("p_size").alias("exon"))
    return reads.tss_positions(e)


# ---------------------------------------------------------------- traces

T = "WITH tr AS (SELECT user_id, epoch(ts)::DOUBLE AS t, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) = 1)"


def _trace(spark, d):
    e = b.table(spark, d, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id", "ts").orderBy("event_id"))).where("k = 1")
    return e.select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "value")


@query("first_crossing", f"{T}, x AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY t) AS before FROM tr) SELECT user_id, round(min(t), 3) AS first_up, round(max(t), 3) AS last_up FROM x WHERE before < 50 AND value >= 50 GROUP BY 1", 3)
def first_crossing(spark, d):
    return ranks.first_crossing(_trace(spark, d), "user_id", "t", "value", 50.0)


@query("dff_baseline", f"{T} SELECT user_id, round(t, 3) AS t, round(value / quantile_cont(value, 0.1) OVER (PARTITION BY user_id) - 1, 3) AS dff FROM tr", 3)
def dff_baseline(spark, d):
    return ranks.dff(_trace(spark, d), "user_id", "value").select("user_id", "t", "dff")


@query("error_integrals", f"{T}, r AS (SELECT user_id, (t - min(t) OVER (PARTITION BY user_id)) / 86400 AS t, value FROM tr), x AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t) - t AS dt, 50 - value AS e FROM r) SELECT user_id, round(sum(e * e * dt), 3) AS ise, round(sqrt(sum(e * e * t * dt)), 3) AS itse, round(sqrt(sum(abs(e) * t * dt)), 3) AS penalty FROM x WHERE dt IS NOT NULL GROUP BY 1", 3)
def error_integrals(spark, d):
    t = _trace(spark, d).withColumn("t", (F.col("t") - F.min("t").over(Window.partitionBy("user_id"))) / 86400)
    return ranks.error_integrals(t, "user_id", "t", "value", 50.0, 1.0)


@query("rolling_mean", f"{T} SELECT user_id, round(t, 3) AS t, round(CASE WHEN count(value) OVER w = 2 THEN avg(value) OVER w END, 3) AS mean FROM tr WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)", 3)
def rolling_mean(spark, d):
    return ranks.rolling_mean(_trace(spark, d), ["user_id"], [F.col("t")], "value", 2, "mean").select("user_id", "t", "mean")


@query("cumulative_total", f"{T} SELECT user_id, round(t, 3) AS t, round(sum(value) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING), 3) AS total FROM tr", 3)
def cumulative_total(spark, d):
    return ranks.cumulative(_trace(spark, d), ["user_id"], [F.col("t")], "value", "total").select("user_id", "t", "total")


@query("beat_counts", "SELECT event_type, count(CASE WHEN value > 50 THEN 1 END) AS n FROM events GROUP BY 1")
def beat_counts(spark, d):
    return ranks.beats(b.table(spark, d, "events").withColumn("m", F.when(F.col("value") > 50, 1)), "event_type", "m")


# ---------------------------------------------------------------- streams


def _stream(spark, d):
    """The events as a stream: a file source takes the table's path, be it a file or a folder, as a glob."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")


def _folder(spark, prefix: str) -> str:
    return f"{shared_folder(spark)}/stream-{prefix}-{uuid.uuid4().hex}"


@query("stream_counts", "SELECT user_id, event_type, count(*) AS reads FROM events GROUP BY 1, 2")
def stream_counts(spark, d):
    return stream.run_to_end(stream.tag_counts(_stream(spark, d), "user_id", "event_type"), _folder(spark, "counts"), "complete")


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    return stream.run_to_end(stream.dedup(_stream(spark, d).select("user_id", "event_type"), ["user_id", "event_type"]), _folder(spark, "dedup"))


@query("stream_windows", "SELECT time_bucket(INTERVAL 6 HOURS, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    e = _stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.run_to_end(stream.windowed_counts(e, "ts", ["event_type"], "6 hours", "30 days"), _folder(spark, "windows"), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "session_counts",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 3 HOURS OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS s FROM events), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS g FROM e)
SELECT min(ts) AS start, user_id, count(*) AS n FROM g GROUP BY g, user_id""",
)
def session_counts(spark, d):
    e = b.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.session_counts(e, "ts", "user_id", "3 hours").drop("end").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("union_batches", "SELECT batch, count(*) AS n, count(s_name) AS named FROM (SELECT 'customer' AS batch, NULL AS s_name FROM customer UNION ALL SELECT 'supplier', s_name FROM supplier) GROUP BY 1")
def union_batches(spark, d):
    x = sets.stack({"customer": b.table(spark, d, "customer").select("c_name"), "supplier": b.table(spark, d, "supplier").select("s_name")})
    return x.groupBy("batch").agg(F.count("*").alias("n"), F.count("s_name").alias("named"))


@query("shared_and_missing_genes", "SELECT (SELECT count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')) AS shared, (SELECT count(*) FROM (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')) AS absent")
def shared_and_missing_genes(spark, d):
    l = b.table(spark, d, "lineitem").select(F.col("l_partkey").alias("gene"), "l_returnflag")
    a, r = l.where("l_returnflag = 'A'"), l.where("l_returnflag = 'R'")
    s = sets.shared_genes(a, r).agg(F.count("*").alias("shared"))
    return s.crossJoin(sets.without(b.genes(spark, d).select("gene"), a).agg(F.count("*").alias("absent")))


@query("error_of_ratio", "WITH g AS (SELECT l_returnflag AS k, avg(l_quantity) AS a, stddev_samp(l_quantity) / sqrt(count(*)) AS ea, avg(l_tax) AS c, stddev_samp(l_tax) / sqrt(count(*)) AS ec FROM lineitem GROUP BY 1) SELECT k, round(abs(a / c) * sqrt((ea / a) ** 2 + (ec / c) ** 2), 6) AS se FROM g")
def error_of_ratio(spark, d):
    l = b.table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "k")
    q, t = groups.mean_error(l, ["k"], "l_quantity").select("k", F.col("mean").alias("a"), F.col("se").alias("ea")), groups.mean_error(l, ["k"], "l_tax").select("k", F.col("mean").alias("c"), F.col("se").alias("ec"))
    return q.join(t, "k").select("k", groups.ratio_error(F.col("a"), F.col("ea"), F.col("c"), F.col("ec")).alias("se"))
