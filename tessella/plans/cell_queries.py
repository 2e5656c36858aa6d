"""Queries on the count matrix: quality control, normalisation, features, summaries, abundances, ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import groups, matrix, ranks
from . import bindings as b
from .catalog import query

M = f"WITH {b.EXPR}, {b.OBS}, {b.GENES}, {b.SIZES}"


@query("qc_cell_metrics", f"{M} SELECT cell_id, round(sum(count), 6) AS total, count(*) AS n_genes, round(100 * coalesce(sum(count) FILTER (kind = 'SMALL'), 0) / sum(count), 6) AS pct_flagged FROM expr JOIN genes USING (gene) GROUP BY 1")
def qc_cell_metrics(spark, d):
    return matrix.cell_metrics(b.expr(spark, d), b.genes(spark, d).where("kind = 'SMALL'"))


@query(
    "threshold_filter",
    f"""{M}, m AS (SELECT cell_id, sum(count) AS total, count(*) AS n_genes, 100 * coalesce(sum(count) FILTER (kind = 'SMALL'), 0) / sum(count) AS pct FROM expr JOIN genes USING (gene) GROUP BY 1)
SELECT cell_id, donor, round(total, 6) AS total, n_genes FROM m JOIN obs USING (cell_id) WHERE total >= 100 + 10 * donor AND pct <= 25 AND n_genes >= 5""",
)
def threshold_filter(spark, d):
    m = matrix.cell_metrics(b.expr(spark, d), b.genes(spark, d).where("kind = 'SMALL'")).join(b.obs(spark, d), "cell_id")
    limits = b.table(spark, d, "nation").select(F.col("n_nationkey").alias("donor"), (100 + 10 * F.col("n_nationkey")).alias("min_total"), F.lit(25).alias("max_pct"), F.lit(5).alias("min_genes"))
    return matrix.threshold_filter(m, limits, "donor").select("cell_id", "donor", "total", "n_genes")


@query(
    "filter_genes_cells",
    f"""{M}, g AS (SELECT gene FROM expr GROUP BY 1 HAVING sum((count >= 20)::INT) >= 3 AND sum(count) >= 200), c AS (SELECT cell_id FROM expr GROUP BY 1 HAVING count(*) >= 10 AND sum(count) >= 100)
SELECT gene, count(*) AS n FROM expr WHERE gene IN (SELECT gene FROM g) AND cell_id IN (SELECT cell_id FROM c) GROUP BY 1""",
)
def filter_genes_cells(spark, d):
    e = b.expr(spark, d)
    kept = matrix.keep_related(matrix.filter_genes(e, min_cells=3, min_count=20, min_total=200), matrix.filter_cells(e, 10, 100).select("cell_id").distinct(), "cell_id")
    return kept.groupBy("gene").agg(F.count("*").alias("n"))


@query(
    "gene_name_gate",
    "SELECT p_brand AS brand, count(*) AS n FROM part WHERE NOT (p_name LIKE 'a%' OR p_name LIKE 'b%' OR p_name LIKE '%e' OR p_name LIKE '%zz%') GROUP BY 1",
)
def gene_name_gate(spark, d):
    return b.genes(spark, d).where(~matrix.name_flag(F.col("name"), ["a", "b"], ["e"], ["zz"])).groupBy("brand").agg(F.count("*").alias("n"))


@query(
    "library_summary",
    f"""WITH {b.EXPR}, {b.OBS}, m AS (SELECT cell_id, donor, coalesce(sum(count), 0) AS total, count(count) AS n FROM obs LEFT JOIN expr USING (cell_id) GROUP BY 1, 2)
SELECT donor, 'counts' AS stage, count(*)::BIGINT AS before, sum((total >= 200)::INT)::BIGINT AS after FROM m GROUP BY 1
UNION ALL SELECT donor, 'genes', sum((total >= 200)::INT)::BIGINT, sum((total >= 200 AND n >= 20)::INT)::BIGINT FROM m GROUP BY 1""",
)
def library_summary(spark, d):
    m = b.obs(spark, d).join(matrix.cell_metrics(b.expr(spark, d)), "cell_id", "left")
    return matrix.library_summary(m, "donor", {"counts": F.col("total") >= 200, "genes": F.col("n_genes") >= 20})


@query("total_histogram", f"{M}, t AS (SELECT cell_id, sum(count) AS total FROM expr GROUP BY 1) SELECT least(floor((total - 0) / 100.0), 19)::INT AS bin, count(*) AS n FROM t WHERE total BETWEEN 0 AND 2000 GROUP BY 1")
def total_histogram(spark, d):
    return matrix.histogram(matrix.cell_metrics(b.expr(spark, d)), "total", 0, 2000, 20)


@query("cpm_log1p", f"{M}, t AS (SELECT *, count / sum(count) OVER (PARTITION BY cell_id) * 1e6 AS v FROM expr) SELECT cell_id, gene, round(ln(1 + v), 6) AS v, round(ln(1 + v) / ln(10), 6) AS v10 FROM t")
def cpm_log1p(spark, d):
    n = matrix.per_cell(b.expr(spark, d), 1e6)
    return n.select("cell_id", "gene", matrix.log1p("norm").alias("v"), matrix.log1p("norm", 10).alias("v10"))


@query(
    "normalize_excl_dominant",
    f"""{M}, t AS (SELECT *, sum(count) OVER (PARTITION BY cell_id) AS t FROM expr), big AS (SELECT DISTINCT gene FROM t WHERE count > 0.1 * t),
s AS (SELECT cell_id, sum(count) AS s FROM expr WHERE gene NOT IN (SELECT gene FROM big) GROUP BY 1) SELECT cell_id, gene, round(count / s * 10000, 6) AS norm FROM expr JOIN s USING (cell_id)""",
)
def normalize_excl_dominant(spark, d):
    return matrix.per_cell(b.expr(spark, d), 1e4, 0.1).select("cell_id", "gene", "norm")


MOMENTS = "m AS (SELECT gene, count(*) AS n_nonzero, sum(count) / any_value(n) AS mean, sum(count * count) / any_value(n) - (sum(count) / any_value(n)) * (sum(count) / any_value(n)) AS variance FROM expr, n GROUP BY 1)"


@query("gene_moments_fano", f"{M}, {MOMENTS} SELECT gene, n_nonzero, round(mean, 6) AS mean, round(variance, 6) AS variance, round(CASE WHEN mean > 0 THEN variance / mean END, 6) AS fano FROM m")
def gene_moments_fano(spark, d):
    return matrix.moments(b.expr(spark, d), "count", b.n_cells(spark, d))


@query("gene_zscore", f"{M}, {MOMENTS} SELECT cell_id, gene, round((count - mean) / sqrt(variance), 6) AS z, round(-mean / sqrt(variance), 6) AS zero_z FROM expr JOIN m USING (gene) WHERE variance > 0")
def gene_zscore(spark, d):
    return matrix.zscore(b.expr(spark, d), "count", b.n_cells(spark, d)).select("cell_id", "gene", "z", "zero_z")


@query(
    "gene_color_stats",
    f"""{M}, s AS (SELECT gene, count(*) AS k, sum(count) AS s, sum(count * count) AS q, max(count) AS high, list(count ORDER BY count) AS v, any_value(n) AS n FROM expr, n GROUP BY 1),
p AS (SELECT *, 1 - 0.25 * n / k AS pq, (1 - 0.25 * n / k) * (k - 1) AS pos, CAST(floor((1 - 0.25 * n / k) * (k - 1)) AS INT) AS i FROM s)
SELECT gene, round(s / n, 6) AS mean, round(sqrt(greatest(0, q / n - (s / n) * (s / n))), 6) AS sd, CASE WHEN k < n THEN 0.0 ELSE list_min(v) END AS low, high,
round(CASE WHEN pq > 0 THEN v[i + 1] + (pos - i) * (coalesce(v[i + 2], v[i + 1]) - v[i + 1]) ELSE 0 END, 6) AS top FROM p""",
)
def gene_color_stats(spark, d):
    return matrix.color_stats(b.expr(spark, d), "count", b.n_cells(spark, d), 75.0)


@query("nonzero_percentile", f"{M} SELECT gene, round(quantile_cont(count, 0.9), 6) AS top FROM expr WHERE count <> 0 GROUP BY 1")
def nonzero_percentile(spark, d):
    return matrix.nonzero_percentile(b.expr(spark, d), "count", 0.9)


@query(
    "running_quantile_ffill",
    """WITH p AS (SELECT o_totalprice AS x, o_custkey::DOUBLE AS y FROM orders), r AS (SELECT min(x) AS lo, max(x) AS hi FROM p),
q AS (SELECT floor((x - lo) / ((hi - lo) / 40))::INT AS bin, quantile_cont(y, 0.1) AS v FROM p, r WHERE floor((x - lo) / ((hi - lo) / 40)) < 40 GROUP BY 1),
f AS (SELECT range::INT AS bin, last_value(v IGNORE NULLS) OVER (ORDER BY range ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM range(40) LEFT JOIN q ON bin = range)
SELECT bin, round(lo + (bin + 0.5) * (hi - lo) / 40, 6) AS center, round(value, 6) AS value FROM f, r WHERE value IS NOT NULL""",
)
def running_quantile_ffill(spark, d):
    p = b.table(spark, d, "orders").select(F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("y"))
    return matrix.running_quantile(p, "x", "y", 0.1, 40)


@query(
    "hvg_dispersion_bins",
    f"""{M}, {MOMENTS}, x AS (SELECT gene, ln(1 + mean) AS x, ln(variance / mean) AS d FROM m WHERE mean > 0 AND variance > 0), r AS (SELECT min(x) AS lo, max(x) AS hi FROM x),
bb AS (SELECT gene, d, least(floor((x - lo) / (hi - lo) * 20), 19)::INT AS bin FROM x, r), s AS (SELECT bin, avg(d) AS dm, stddev_samp(d) AS ds FROM bb GROUP BY 1),
z AS (SELECT gene, bin, CASE WHEN ds > 0 THEN (d - dm) / ds ELSE 0.0 END AS z FROM bb JOIN s USING (bin)) SELECT gene, bin, round(z, 6) AS z FROM z QUALIFY row_number() OVER (ORDER BY round(z, 9) DESC, gene) <= 200""",
)
def hvg_dispersion_bins(spark, d):
    return matrix.dispersion_genes(b.expr(spark, d), "count", b.n_cells(spark, d), 20, 200).drop("rank")


@query("hvg_v_scores")
def hvg_v_scores(spark, d):
    return matrix.variable_genes(b.expr(spark, d), "count", b.n_cells(spark, d), 85, 10, 3)


SEED_SQL = """, s AS (SELECT gene, sum(count) AS s, sum(count * count) AS q FROM expr GROUP BY 1),
xy AS (SELECT e.gene, f.gene AS seed, sum(e.count * f.count) AS xy FROM expr e JOIN expr f USING (cell_id) JOIN genes k ON k.gene = f.gene WHERE k.brand = 'Brand#11' GROUP BY 1, 2),
r AS (SELECT xy.gene, xy.seed, xy / n - a.s / n * c.s / n AS cv, sqrt((a.q / n - (a.s / n) ** 2) * (c.q / n - (c.s / n) ** 2)) AS den FROM xy JOIN s a ON xy.gene = a.gene JOIN s c ON xy.seed = c.gene, n)"""


@query("seed_corr_screen", f"{M}{SEED_SQL} SELECT gene, seed, round(CASE WHEN den > 0 THEN cv / den END, 6) AS r FROM r")
def seed_corr_screen(spark, d):
    return matrix.seed_correlation(b.expr(spark, d), "count", b.genes(spark, d).where("brand = 'Brand#11'"), b.n_cells(spark, d))


@query(
    "signature_correlation",
    f"""{M}, {MOMENTS}, y AS (SELECT cell_id, sum(count / sqrt(variance)) AS y FROM expr JOIN m USING (gene) JOIN genes USING (gene) WHERE brand = 'Brand#11' AND variance > 0 GROUP BY 1),
t AS (SELECT sum(y) AS sy, sum(y * y) AS qy FROM y), g AS (SELECT gene, sum(count) AS s, sum(count * count) AS q, sum(count * coalesce(y, 0)) AS xy FROM expr LEFT JOIN y USING (cell_id) GROUP BY 1)
SELECT gene, round(CASE WHEN (q / n - (s / n) ** 2) * (qy / n - (sy / n) ** 2) > 0 THEN (xy / n - s / n * sy / n) / sqrt((q / n - (s / n) ** 2) * (qy / n - (sy / n) ** 2)) END, 6) AS r FROM g, t, n""",
)
def signature_correlation(spark, d):
    return matrix.signature_correlation(b.expr(spark, d), "count", b.genes(spark, d).where("brand = 'Brand#11'"), b.n_cells(spark, d))


# ---------------------------------------------------------------- groups

C = f"WITH {b.EXPR}, {b.OBS}, {b.GENES}, {b.CENTERS}"


@query("group_centroids", f"{C} SELECT cell_state, gene, round(mean, 6) AS mean, round(pct, 6) AS pct FROM centers")
def group_centroids(spark, d):
    return groups.centroids(b.expr(spark, d), b.obs(spark, d), "cell_state")


@query("pseudobulk_cp10k", f"{C}, s AS (SELECT cell_state, gene, sum(count) AS total FROM expr JOIN obs USING (cell_id) GROUP BY 1, 2) SELECT cell_state, gene, round(total, 6) AS total, round(total / sum(total) OVER (PARTITION BY cell_state) * 10000, 6) AS norm FROM s")
def pseudobulk_cp10k(spark, d):
    return groups.pseudobulk(b.expr(spark, d), b.obs(spark, d), ["cell_state"])


@query("counts_per_thousand_cells", f"{M}, k AS (SELECT cell_state, donor, count(*) AS k FROM obs GROUP BY 1, 2) SELECT cell_state, donor, gene, round(sum(count) / any_value(k) * 1000, 6) AS per_thousand FROM expr JOIN obs USING (cell_id) JOIN k USING (cell_state, donor) GROUP BY 1, 2, 3")
def counts_per_thousand_cells(spark, d):
    return groups.counts_per_thousand(b.expr(spark, d), b.obs(spark, d), ["cell_state", "donor"])


@query("gene_mean_error", f"{M}, x AS (SELECT cell_state, coalesce(count, 0) AS x FROM obs LEFT JOIN (SELECT * FROM expr WHERE gene = 7) USING (cell_id)) SELECT cell_state, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x) / sqrt(count(*)), 6) AS se FROM x GROUP BY 1")
def gene_mean_error(spark, d):
    return groups.gene_mean_error(b.expr(spark, d), b.obs(spark, d), "cell_state", 7, "count")


@query("replicate_means", "WITH m AS (SELECT c_mktsegment AS state, c_nationkey, avg(c_acctbal) AS m FROM customer GROUP BY 1, 2) SELECT state, count(*) AS n, round(avg(m), 6) AS mean, round(stddev_samp(m) / sqrt(count(*)), 6) AS se FROM m GROUP BY 1")
def replicate_means(spark, d):
    return groups.nested_means(b.table(spark, d, "customer").withColumnRenamed("c_mktsegment", "state"), ["state"], "c_nationkey", "c_acctbal")


A = f"WITH {b.OBS}, full_ AS (SELECT * FROM (SELECT DISTINCT donor FROM obs), (SELECT DISTINCT cell_state FROM obs)), k AS (SELECT donor, cell_state, count(*) AS n FROM obs GROUP BY 1, 2), a AS (SELECT donor, cell_state, coalesce(n, 0)::BIGINT AS n, 100.0 * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY donor) AS share FROM full_ LEFT JOIN k USING (donor, cell_state))"


@query("abundance_pct", f"{A} SELECT donor, cell_state, n, round(share, 6) AS share FROM a")
def abundance_pct(spark, d):
    return groups.abundance(b.obs(spark, d), "donor", "cell_state")


@query(
    "abundance_ratio",
    f"""WITH {b.ORDER_OBS}, g AS (SELECT cell_state, sum((condition = 'F')::INT) AS a, sum((condition = 'O')::INT) AS c FROM oobs GROUP BY 1),
f AS (SELECT cell_state, a / sum(a) OVER () AS control, c / sum(c) OVER () AS case_ FROM g) SELECT cell_state, round(control, 6) AS control, round(case_, 6) AS "case", round((case_ + 0.001) / (control + 0.001), 6) AS ratio, round(log2((case_ + 0.001) / (control + 0.001)), 6) AS log2_ratio FROM f""",
)
def abundance_ratio(spark, d):
    return groups.abundance_ratio(b.order_obs(spark, d), "condition", "cell_state", "F", "O")


@query(
    "abundance_log2fc_vs_control",
    f"""WITH {b.ORDER_OBS}, k AS (SELECT condition, replicate, cell_state, count(*) AS n FROM oobs GROUP BY 1, 2, 3), s AS (SELECT *, 100.0 * n / sum(n) OVER (PARTITION BY condition, replicate) AS share FROM k),
c AS (SELECT replicate, cell_state, share AS c FROM s WHERE condition = 'F') SELECT condition, cell_state, round(log2(avg(share / c)), 6) AS log2fc FROM s JOIN c USING (replicate, cell_state) WHERE condition <> 'F' GROUP BY 1, 2""",
)
def abundance_log2fc_vs_control(spark, d):
    o = b.order_obs(spark, d)
    k = groups.tally(o, ["condition", "replicate", "cell_state"])
    tot = o.groupBy("condition", "replicate").agg(F.count("*").alias("t"))
    s = k.join(tot, ["condition", "replicate"]).withColumn("share", 100 * F.col("n") / F.col("t"))
    return groups.fold_vs_control(s, "condition", "replicate", "cell_state", "F")


@query(
    "abundance_se",
    f"""WITH {b.ORDER_OBS}, g AS (SELECT cell_state, sum((condition = 'F')::INT) AS n, sum((condition = 'O')::INT) AS m FROM oobs GROUP BY 1), t AS (SELECT sum(n) AS tn, sum(m) AS tm FROM g)
SELECT cell_state, round(sqrt(1 / n + 1 / m - 1 / tn - 1 / tm) / ln(2), 6) AS se FROM g, t""",
)
def abundance_se(spark, d):
    n = lambda v: F.sum((F.col("condition") == v).cast("int"))
    o = b.order_obs(spark, d)
    g, t = o.groupBy("cell_state").agg(n("F").alias("n"), n("O").alias("m")), o.agg(n("F").alias("tn"), n("O").alias("tm"))
    return g.crossJoin(F.broadcast(t)).select("cell_state", groups.log2_ratio_error(F.col("n"), F.col("m"), F.col("tn"), F.col("tm")).alias("se"))


USAGE = f"WITH {b.ORDER_OBS}, u AS (SELECT l_orderkey AS cell_id, l_returnflag AS program, sum(l_quantity) AS usage FROM lineitem GROUP BY 1, 2), s AS (SELECT cell_id, program, usage / sum(usage) OVER (PARTITION BY cell_id) AS share FROM u)"


def _usage(spark, d):
    u = b.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("cell_id"), F.col("l_returnflag").alias("program")).agg(F.sum("l_quantity").alias("usage"))
    return groups.usage_shares(u)


@query("grouping_sets_usage", f"{USAGE} SELECT program, condition, replicate, round(avg(share), 6) AS mean_share FROM s JOIN oobs USING (cell_id) GROUP BY GROUPING SETS ((program, condition), (program, condition, replicate))")
def grouping_sets_usage(spark, d):
    return groups.usage_margins(_usage(spark, d).join(b.order_obs(spark, d), "cell_id"), "condition", "replicate")


@query("program_block_median", f"{USAGE}, c AS (SELECT cell_id, sum(CASE WHEN program IN ('A', 'R') THEN share ELSE 0 END) AS s FROM s GROUP BY 1) SELECT cell_state, round(quantile_cont(s, 0.5), 6) AS median_share FROM c JOIN oobs USING (cell_id) GROUP BY 1")
def program_block_median(spark, d):
    u = _usage(spark, d)
    return groups.block_sums(u, u.select("program").distinct().where("program in ('A', 'R')"), b.order_obs(spark, d).select("cell_id", "cell_state"))


@query(
    "program_score",
    f"""{M}, w AS (SELECT brand AS program, gene, size AS weight FROM genes), t AS (SELECT program, sum(weight) AS tw FROM w GROUP BY 1), s AS (SELECT cell_id, program, sum(count * weight) AS s FROM expr JOIN w USING (gene) GROUP BY 1, 2)
SELECT o.cell_id, t.program, round(coalesce(s, 0) / tw + 0.01, 6) AS score FROM obs o CROSS JOIN t LEFT JOIN s ON s.cell_id = o.cell_id AND s.program = t.program""",
)
def program_score(spark, d):
    w = b.genes(spark, d).select(F.col("brand").alias("program"), "gene", F.col("size").alias("weight"))
    return groups.program_score(b.expr(spark, d), w, b.obs(spark, d), "count", 0.01)


@query("pathway_score", f"{C}, s AS (SELECT cell_state, brand AS set_name, sum(mean) AS s FROM centers JOIN genes USING (gene) GROUP BY 1, 2) SELECT cell_state, set_name, round(log2(s / quantile_cont(s, 0.5) OVER (PARTITION BY set_name)), 6) AS score FROM s")
def pathway_score(spark, d):
    return groups.set_score(groups.centroids(b.expr(spark, d), b.obs(spark, d), "cell_state"), b.brand_sets(spark, d), "cell_state")


@query(
    "program_shift_contribution",
    """WITH u AS (SELECT o_orderstatus AS c, o_orderpriority AS state, l_returnflag AS program, avg(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
x AS (SELECT state, program, (q.value - p.value) ** 2 AS d FROM (SELECT * FROM u WHERE c = 'F') p JOIN (SELECT * FROM u WHERE c = 'P') q USING (state, program)) SELECT state, program, round(100 * sqrt(d / sum(d) OVER (PARTITION BY state)), 6) AS pct FROM x""",
)
def program_shift_contribution(spark, d):
    l, o = b.table(spark, d, "lineitem"), b.table(spark, d, "orders")
    u = l.join(o, l["l_orderkey"] == o["o_orderkey"]).groupBy(F.col("o_orderstatus").alias("c"), F.col("o_orderpriority").alias("state"), F.col("l_returnflag").alias("program")).agg(F.avg("l_quantity").alias("value"))
    return groups.contribution(u.where("c = 'F'"), u.where("c = 'P'"), "state")


@query("label_contingency", "SELECT a.s AS o_orderstatus, c.p AS o_orderpriority, count(o_orderkey) AS n FROM (SELECT DISTINCT o_orderstatus AS s FROM orders) a CROSS JOIN (SELECT DISTINCT o_orderpriority AS p FROM orders) c LEFT JOIN orders ON o_orderstatus = a.s AND o_orderpriority = c.p GROUP BY 1, 2")
def label_contingency(spark, d):
    return groups.contingency(b.table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query(
    "label_confusion",
    """WITH x AS (SELECT l_returnflag AS t, CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_quantity > 25 THEN 'A' ELSE 'R' END AS g FROM lineitem)
SELECT t AS label, count(*)::BIGINT AS n, round(sum((t = g)::INT) / (SELECT count(*) FROM x y WHERE y.g = x.t), 6) AS "precision", round(avg((t = g)::INT), 6) AS recall, round((SELECT avg((t = g)::INT) FROM x), 6) AS accuracy FROM x GROUP BY t""",
)
def label_confusion(spark, d):
    x = b.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("t"), F.when(F.col("l_linestatus") == "O", "N").when(F.col("l_quantity") > 25, "A").otherwise("R").alias("g"))
    return groups.label_scores(x, "t", "g")


@query("remaining_fraction", f"{M}, t AS (SELECT cell_id, sum(count) AS total FROM expr GROUP BY 1) SELECT donor, cell_state, round(avg((total >= 1000)::INT), 6) AS fraction FROM t JOIN obs USING (cell_id) GROUP BY 1, 2")
def remaining_fraction(spark, d):
    return groups.remaining(matrix.cell_metrics(b.expr(spark, d)).join(b.obs(spark, d), "cell_id"), "donor", "cell_state", 1000)


@query("cluster_flag_fraction", "SELECT o_orderpriority, count(*) AS n, sum((o_totalprice > 200000)::INT)::BIGINT AS n_flagged, round(avg((o_totalprice > 200000)::INT), 6) AS fraction FROM orders GROUP BY 1")
def cluster_flag_fraction(spark, d):
    return groups.flag_fraction(b.table(spark, d, "orders"), "o_orderpriority", F.col("o_totalprice") > 200000)


@query("removal_flags", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE NOT (o_totalprice > 300000) AND NOT (o_orderstatus = 'P') GROUP BY 1")
def removal_flags(spark, d):
    return groups.exclude(b.table(spark, d, "orders"), {"rich": F.col("o_totalprice") > 300000, "pending": F.col("o_orderstatus") == "P"})[1].groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("recode_labels", "SELECT coalesce(r_name, 'none') AS region, c_mktsegment, count(*) AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def recode_labels(spark, d):
    n, r = b.table(spark, d, "nation"), b.table(spark, d, "region")
    m = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").cast("string").alias("old"), F.col("r_name").alias("new"))
    c = b.table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("nation"), "c_mktsegment")
    return groups.recode(c, "nation", m, "region").groupBy("region", "c_mktsegment").agg(F.count("*").alias("n"))


@query("object_summary", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(quantile_cont(l_extendedprice, 0.5), 6) AS median_volume, round(sum(l_extendedprice), 2) AS total_volume, round(avg((l_discount > 0.05)::INT), 6) AS positive_fraction FROM lineitem WHERE l_extendedprice > 1000 AND l_extendedprice < 60000 GROUP BY 1, 2", 6)
def object_summary(spark, d):
    o = b.table(spark, d, "lineitem").withColumnRenamed("l_extendedprice", "volume_um3")
    return groups.object_summary(o, ["l_returnflag", "l_linestatus"], F.col("l_discount") > 0.05, 1000, 60000).withColumn("total_volume", F.round("total_volume", 2))


@query(
    "qc_library_table",
    f"""{M}, t AS (SELECT cell_id, sum(count)::BIGINT AS umis, count(*) * 3 AS reads FROM expr GROUP BY 1), x AS (SELECT donor, umis, reads, umis >= 500 AS ok FROM t JOIN obs USING (cell_id)),
g AS (SELECT donor, count(*)::BIGINT AS barcodes, sum(ok::INT)::BIGINT AS passing_barcodes, sum(umis)::BIGINT AS umis, sum(CASE WHEN ok THEN umis ELSE 0 END)::BIGINT AS passing_umis, sum(reads)::BIGINT AS reads, sum(CASE WHEN ok THEN reads ELSE 0 END)::BIGINT AS passing_reads FROM x GROUP BY 1)
SELECT *, round(passing_reads / nullif(passing_umis, 0), 6) AS reads_per_umi, round(passing_umis / nullif(umis, 0), 6) AS umi_share FROM g""",
)
def qc_library_table(spark, d):
    m = matrix.cell_metrics(b.expr(spark, d)).select("cell_id", F.col("total").cast("bigint").alias("umis"), (F.col("n_genes") * 3).alias("reads")).join(b.obs(spark, d), "cell_id")
    return groups.library_table(m, "donor", F.col("umis") >= 500)


@query("perplexity", "WITH k AS (SELECT o_orderstatus, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2), p AS (SELECT o_orderstatus, n / sum(n) OVER (PARTITION BY o_orderstatus) AS p FROM k) SELECT o_orderstatus, round(pow(2, -sum(p * log2(p))), 6) AS perplexity FROM p GROUP BY 1")
def perplexity(spark, d):
    return groups.perplexity(groups.tally(b.table(spark, d, "orders"), ["o_orderstatus", "o_custkey"]), ["o_orderstatus"])


# ---------------------------------------------------------------- ranks


@query(
    "dense_rank_score",
    f"""{M}, e AS (SELECT brand AS set_name, gene, cell_id, count AS x FROM expr JOIN genes USING (gene)), k AS (SELECT set_name, gene, (count(*) < any_value(n))::INT AS z FROM e, n GROUP BY 1, 2),
r AS (SELECT set_name, gene, cell_id, dense_rank() OVER (PARTITION BY set_name, gene ORDER BY x) + z AS d FROM e JOIN k USING (set_name, gene)), t AS (SELECT set_name, gene, max(d) AS top FROM r GROUP BY 1, 2),
f AS (SELECT o.cell_id, t.set_name, avg(coalesce(d, 1) / top) AS score FROM obs o CROSS JOIN t LEFT JOIN r ON r.cell_id = o.cell_id AND r.set_name = t.set_name AND r.gene = t.gene GROUP BY 1, 2)
SELECT cell_id, set_name, round(score, 6) AS score, round((score - avg(score) OVER (PARTITION BY set_name)) / stddev_pop(score) OVER (PARTITION BY set_name), 6) AS z FROM f""",
)
def dense_rank_score(spark, d):
    return ranks.dense_rank_score(b.expr(spark, d), b.brand_sets(spark, d), b.obs(spark, d))


@query(
    "classify_by_score",
    f"{M}, s AS (SELECT cell_id, brand AS label, sum(count) AS score FROM expr JOIN genes USING (gene) GROUP BY 1, 2) SELECT cell_id, label, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY round(score, 9) DESC, label) = 1",
)
def classify_by_score(spark, d):
    s = b.expr(spark, d).join(b.brand_sets(spark, d), "gene").groupBy("cell_id", F.col("set_name").alias("label")).agg(F.sum("count").alias("score"))
    return ranks.best_label(s, "cell_id", "label", "score")


@query("average_rank", "WITH r AS (SELECT o_orderkey, o_orderstatus, rank() OVER (PARTITION BY o_orderstatus ORDER BY floor(o_totalprice / 1000)) + (count(*) OVER (PARTITION BY o_orderstatus, floor(o_totalprice / 1000)) - 1) / 2.0 AS rank FROM orders) SELECT o_orderkey, round(rank, 6) AS rank FROM r")
def average_rank(spark, d):
    o = b.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.floor(F.col("o_totalprice") / 1000).alias("v"))
    return ranks.average_rank(o, ["o_orderstatus"], "v").select("o_orderkey", "rank")


TOP2 = """, r AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY mean DESC, cell_state) AS k FROM centers),
t AS (SELECT gene, max(CASE WHEN k = 1 THEN cell_state END) AS best, max(CASE WHEN k = 1 THEN mean END) AS first, max(CASE WHEN k = 2 THEN mean END) AS second, quantile_cont(mean, 0.5) AS median FROM r GROUP BY 1)"""


@query("top2_ratio_markers", f"{C}{TOP2}, q AS (SELECT best, gene, first / second AS ratio FROM t WHERE second > 0 AND first / second >= 1.3), p AS (SELECT *, row_number() OVER (PARTITION BY best ORDER BY round(ratio, 9) DESC, gene) AS rank FROM q) SELECT best, gene, round(ratio, 6) AS ratio, rank::INT AS rank FROM p WHERE rank <= 150")
def top2_ratio_markers(spark, d):
    return ranks.ratio_markers(groups.centroids(b.expr(spark, d), b.obs(spark, d), "cell_state"), "cell_state")


@query("best_other_fold", f"{C}{TOP2} SELECT cell_state, r.gene, round(mean, 6) AS mean, round(greatest(0, coalesce(CASE WHEN k = 1 THEN second ELSE first END, 0)), 6) AS other, round(log2((mean + 0.1) / (greatest(0, coalesce(CASE WHEN k = 1 THEN second ELSE first END, 0)) + 0.1)), 6) AS log2fc FROM r JOIN t ON r.gene = t.gene")
def best_other_fold(spark, d):
    return ranks.other_best(groups.centroids(b.expr(spark, d), b.obs(spark, d), "cell_state"), "cell_state")


@query(
    "topn_per_group_unique",
    f"{C}, p AS (SELECT cell_state, gene, mean, row_number() OVER (PARTITION BY cell_state ORDER BY round(mean, 9) DESC, gene) AS rank FROM centers), q AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY cell_state) AS c FROM p WHERE rank <= 30) SELECT cell_state, gene, round(mean, 6) AS mean, rank::INT AS rank FROM q WHERE c = 1",
)
def topn_per_group_unique(spark, d):
    c = groups.centroids(b.expr(spark, d), b.obs(spark, d), "cell_state").select("cell_state", "gene", "mean")
    return ranks.top_unique(c, "cell_state", "gene", [F.desc(F.round("mean", 9)), F.asc("gene")], 30, "cell_state")


@query("coarse_grain_majority", "WITH k AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY c_nationkey) AS f, first_value(c_mktsegment) OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS top FROM k) SELECT c_custkey, CASE WHEN f <= 0.18 THEN top ELSE c_mktsegment END AS coarse FROM customer JOIN s USING (c_nationkey, c_mktsegment)")
def coarse_grain_majority(spark, d):
    return ranks.majority(b.table(spark, d, "customer"), "c_mktsegment", "c_nationkey", 0.18).select("c_custkey", "coarse")


@query("dominant_label", "WITH k AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) SELECT c_nationkey, CASE WHEN n_regionkey = 0 THEN n_name ELSE c_mktsegment END AS c_mktsegment FROM k JOIN nation ON c_nationkey = n_nationkey QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) = 1")
def dominant_label(spark, d):
    o = b.table(spark, d, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("c_mktsegment"))
    return ranks.dominant_label(b.table(spark, d, "customer"), "c_nationkey", "c_mktsegment", o)


@query("top_share_flags", "SELECT o_orderkey, o_totalprice >= quantile_cont(o_totalprice, 0.97) OVER w AS top_3, o_totalprice >= quantile_cont(o_totalprice, 0.9) OVER w AS top_10 FROM orders WINDOW w AS (PARTITION BY o_orderpriority)")
def top_share_flags(spark, d):
    return ranks.top_share_flags(b.table(spark, d, "orders"), "o_orderpriority", "o_totalprice", [3, 10]).select("o_orderkey", "top_3", "top_10")


@query("rank_curve", f"{M}, t AS (SELECT cell_id, sum(count)::BIGINT AS total FROM expr GROUP BY 1), k AS (SELECT total, count(*) AS n FROM t GROUP BY 1) SELECT total, n, (sum(n) OVER (ORDER BY total DESC) - n + 1)::BIGINT AS first_rank, (sum(n) OVER (ORDER BY total DESC))::BIGINT AS last_rank FROM k")
def rank_curve(spark, d):
    return ranks.rank_curve(matrix.cell_metrics(b.expr(spark, d)).select(F.col("total").cast("bigint").alias("total")))


@query("min_max_scale", f"{C} SELECT cell_state, gene, round(CASE WHEN max(mean) OVER w > min(mean) OVER w THEN (mean - min(mean) OVER w) / (max(mean) OVER w - min(mean) OVER w) ELSE 0 END, 6) AS scaled FROM centers WINDOW w AS (PARTITION BY gene)")
def min_max_scale(spark, d):
    return ranks.min_max(groups.centroids(b.expr(spark, d), b.obs(spark, d), "cell_state"), ["gene"], "mean", "scaled").select("cell_state", "gene", "scaled")


@query("log2_over_median", f"{C} SELECT cell_state, gene, round(log2(mean / quantile_cont(mean, 0.5) OVER (PARTITION BY gene)), 6) AS rel FROM centers")
def log2_over_median(spark, d):
    return ranks.relative_to(groups.centroids(b.expr(spark, d), b.obs(spark, d), "cell_state"), ["gene"], "mean", "median", "rel").select("cell_state", "gene", "rel")


@query("clipped_z", "WITH z AS (SELECT o_orderkey, (o_totalprice - avg(o_totalprice) OVER w) / stddev_samp(o_totalprice) OVER w AS z FROM orders WINDOW w AS (PARTITION BY o_orderstatus)) SELECT o_orderkey, round(greatest(-1, least(1.5, z)), 6) AS z FROM z")
def clipped_z(spark, d):
    return ranks.clipped_z(b.table(spark, d, "orders"), ["o_orderstatus"], "o_totalprice", -1, 1.5, "z").select("o_orderkey", "z")


@query("order_by_peak", f"{C}, m AS (SELECT gene, max(mean) AS top, max(CASE WHEN mean = mx THEN cell_state END) AS peak FROM (SELECT *, max(mean) OVER (PARTITION BY gene) AS mx FROM centers) GROUP BY 1) SELECT gene, peak, round(top, 6) AS top, row_number() OVER (PARTITION BY peak ORDER BY top DESC, gene)::INT AS position FROM m")
def order_by_peak(spark, d):
    return ranks.order_by_peak(groups.centroids(b.expr(spark, d), b.obs(spark, d), "cell_state"), "gene", "cell_state", "mean")


@query("enriched_genes", f"{M}, g AS (SELECT gene, sum(count) AS s, sum(count * count) AS q, sum(CASE WHEN cell_state = 'BUILDING' THEN count ELSE 0 END) AS si FROM expr JOIN obs USING (cell_id) GROUP BY 1), k AS (SELECT count(*) AS k FROM obs WHERE cell_state = 'BUILDING') SELECT gene, round((si / k - s / n) / sqrt(q / n - (s / n) * (s / n)), 6) AS z FROM g, n, k")
def enriched_genes(spark, d):
    return ranks.enriched_genes(b.expr(spark, d), b.obs(spark, d), "cell_state", "BUILDING", b.n_cells(spark, d))
