"""Queries on vectors, neighbours, graphs, lineages and classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify, communities, descent, groups, matrix, neighbors, ranks
from ..operators.settle import settle
from . import bindings as b
from .catalog import query

DIST = """pairs AS (SELECT q.vec_id AS src, r.vec_id AS dst, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (q.embedding[i]::DOUBLE - r.embedding[i]::DOUBLE) ** 2))), 9) AS dist FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0)"""
KNN = f"WITH {DIST}, knn AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM pairs QUALIFY row_number() OVER (PARTITION BY src ORDER BY dist, dst) <= 15)"


def _knn(spark, d, k=15):
    e = b.embeddings(spark, d)
    return neighbors.knn(e.where("id % 100 = 0"), e, k)


@query("knn_exact", f"{KNN} SELECT src, dst, round(dist, 6) AS dist, rank::INT AS rank FROM knn")
def knn_exact(spark, d):
    return _knn(spark, d)


@query("knn_composition", f"{KNN}, x AS (SELECT src, dst FROM knn UNION SELECT vec_id, vec_id FROM embeddings WHERE vec_id % 100 = 0) SELECT src AS id, label, count(*) AS n FROM x JOIN embeddings ON vec_id = dst GROUP BY 1, 2")
def knn_composition(spark, d):
    e = b.embeddings(spark, d)
    n = _knn(spark, d)
    self_ = e.where("id % 100 = 0").select(F.col("id").alias("src"), F.col("id").alias("dst"))
    return neighbors.composition(n.select("src", "dst").union(self_).distinct(), e, "label", include_self=False)


@query("density_log2", f"{KNN} SELECT src AS id, round(log2((sum((label = 1)::INT) + 1.0) / (sum((label = 2)::INT) + 1.0)), 6) AS log2_density FROM (SELECT src, dst FROM knn UNION SELECT vec_id, vec_id FROM embeddings WHERE vec_id IN (SELECT src FROM knn)) JOIN embeddings ON vec_id = dst GROUP BY 1")
def density_log2(spark, d):
    n, e = _knn(spark, d), b.embeddings(spark, d)
    q = n.select(F.col("src").alias("id")).distinct()
    return neighbors.density_ratio(n, e, "label", 1, 2).join(q, "id", "left_semi")


@query("knn_smooth", f"{KNN} SELECT src AS id, round(avg(label), 6) AS mean FROM knn JOIN embeddings ON vec_id = dst GROUP BY 1")
def knn_smooth(spark, d):
    return neighbors.neighbour_mean(_knn(spark, d), b.embeddings(spark, d), "label")


@query("knn_vote", f"{KNN}, n AS (SELECT src AS id, label, count(*) AS n FROM knn JOIN embeddings ON vec_id = dst GROUP BY 1, 2) SELECT id, label, round(n / sum(n) OVER (PARTITION BY id), 6) AS share FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1")
def knn_vote(spark, d):
    return classify.vote(_knn(spark, d), b.embeddings(spark, d).select("id", "label"))


@query("knn_cosine", "WITH p AS (SELECT q.vec_id AS src, r.vec_id AS dst, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 9) AS dist FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0) SELECT src, dst, round(dist, 6) AS dist FROM p QUALIFY row_number() OVER (PARTITION BY src ORDER BY dist, dst) <= 5")
def knn_cosine(spark, d):
    e = b.embeddings(spark, d)
    return neighbors.knn(e.where("id % 100 = 0"), e, 5, "cosine").drop("rank")


@query("knn_by_batch", f"WITH {DIST} SELECT src, dst, round(dist, 6) AS dist, label AS batch FROM pairs JOIN embeddings ON vec_id = dst QUALIFY row_number() OVER (PARTITION BY src, label ORDER BY dist, dst) <= 2")
def knn_by_batch(spark, d):
    e = b.embeddings(spark, d)
    return neighbors.knn_by_batch(e, "label", 2, e.where("id % 100 = 0")).select("src", "dst", "dist", F.col("label").alias("batch"))


@query("knn_approximate")
def knn_approximate(spark, d):
    """Neighbours by random projections of every hundredth vector among all; tests hold them against the exact ones."""
    e = b.embeddings(spark, d)
    return neighbors.knn_approximate(e, 5, 2.0, 8, queries=e.where("id % 100 = 0"))


@query("knn_descent")
def knn_descent(spark, d):
    """Neighbours of all vectors by descent; tests hold them against the exact ones."""
    return descent.neighbours(b.embeddings(spark, d), 5)


@query("balanced_weights")
def balanced_weights(spark, d):
    """Fuzzy weights of the two nearest of every label of all vectors; tests hold them against brute force."""
    return communities.connectivities(neighbors.knn_by_batch(b.embeddings(spark, d), "label", 2))


GRAPH = """e AS (SELECT DISTINCT least(o_custkey, l_suppkey) AS src, greatest(o_custkey, l_suppkey) AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey <> l_suppkey),
t AS (SELECT c_custkey AS id, c_mktsegment AS t FROM customer)"""


#: Edges that a task tells apart.
EDGES = 1 << 19


def _parts(spark, d):
    """Tasks for the edges, as many more as there are more rows, so that none has more of them on larger tables."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-b.table(spark, d, "lineitem").count() // EDGES))


def _graph(spark, d):
    l, o = b.deal(b.table(spark, d, "lineitem")), b.table(spark, d, "orders")
    x = l.join(o, l["l_orderkey"] == o["o_orderkey"])
    return neighbors.edges(x.select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")), _parts(spark, d))


def _states(spark, d):
    return b.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("t"))


@query("modularity_clusters")
def modularity_clusters(spark, d):
    """Clusters of the graph with their sizes, and the modularity that they reach."""
    log: list[float] = []
    c = communities.modularity_clusters(_graph(spark, d), log=log)
    return c.groupBy("cluster").agg(F.count("*").alias("n")).withColumn("modularity", F.lit(log[-1] if log else 0.0))


@query("adjacency_degree", f"WITH {GRAPH} SELECT id, count(*) AS degree FROM (SELECT src AS id, dst FROM e UNION SELECT dst, src FROM e) GROUP BY 1")
def adjacency_degree(spark, d):
    return neighbors.adjacency(_graph(spark, d), _parts(spark, d)).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


SG = f"""WITH {GRAPH}, x AS (SELECT least(a.t, c.t) AS t1, greatest(a.t, c.t) AS t2, count(*) AS n FROM e JOIN t a ON a.id = src JOIN t c ON c.id = dst WHERE a.t <> c.t GROUP BY 1, 2),
m AS (SELECT t, sum(n) AS m FROM (SELECT t1 AS t, n FROM x UNION ALL SELECT t2, n FROM x) GROUP BY 1), w AS (SELECT t1, t2, n / sqrt(p.m * q.m) AS weight FROM x JOIN m p ON p.t = t1 JOIN m q ON q.t = t2)"""


@query("state_graph_normindex", f"{SG} SELECT t1, t2, round(weight, 6) AS weight FROM w WHERE weight >= 0.3 * (SELECT max(weight) FROM w)")
def state_graph_normindex(spark, d):
    return neighbors.state_graph(_graph(spark, d), _states(spark, d), "t")


@query(
    "state_graph_tree",
    # an edge is in the tree unless better ones already connect its ends
    f"""{SG.replace('WITH', 'WITH RECURSIVE', 1)}, g AS (SELECT t1, t2, weight, row_number() OVER (ORDER BY weight DESC, t1, t2) AS p FROM w WHERE weight >= 0.3 * (SELECT max(weight) FROM w)), both_ways AS (SELECT t1 AS a, t2 AS b, p FROM g UNION ALL SELECT t2, t1, p FROM g),
reach AS (SELECT p, t1 AS node FROM g UNION SELECT r.p, b.b FROM reach r JOIN both_ways b ON b.a = r.node AND b.p < r.p) SELECT t1, t2, round(weight, 6) AS weight FROM g WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.p = g.p AND r.node = g.t2)""",
)
def state_graph_tree(spark, d):
    return neighbors.maximum_spanning_tree(neighbors.state_graph(_graph(spark, d), _states(spark, d), "t"))


def _propagated(rounds: int) -> str:
    """Common table expressions p0, p1, ... with the labels after each round."""
    out = "adj AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), p0 AS (SELECT DISTINCT src AS id, src AS cluster FROM adj)"
    for k in range(1, rounds + 1):
        out += f""", v{k} AS (SELECT id, cluster, count(*) AS n FROM (SELECT adj.src AS id, cluster FROM adj JOIN p{k - 1} p ON p.id = adj.dst UNION ALL SELECT id, cluster FROM p{k - 1}) GROUP BY 1, 2),
p{k} AS (SELECT id, cluster FROM v{k} QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, cluster) = 1)"""
    return out


@query(
    "label_propagation",
    f"""WITH {GRAPH}, {_propagated(4)}, dk AS (SELECT cluster, count(*) AS k FROM adj JOIN p4 ON id = src GROUP BY 1), di AS (SELECT a.cluster, count(*) AS l FROM e JOIN p4 a ON a.id = src JOIN p4 c ON c.id = dst WHERE a.cluster = c.cluster GROUP BY 1), m AS (SELECT count(*) AS m FROM e)
SELECT round(sum(coalesce(l, 0) / m - (k / (2.0 * m)) ** 2), 6) AS modularity FROM dk LEFT JOIN di USING (cluster), m""",
)
def label_propagation(spark, d):
    e = settle(_graph(spark, d))
    return neighbors.modularity(e, neighbors.label_propagation(e, 4))


@query("propagated_clusters", f"WITH {GRAPH}, {_propagated(3)} SELECT id, cluster FROM p3")
def propagated_clusters(spark, d):
    return neighbors.label_propagation(settle(_graph(spark, d)), 3)


@query(
    "modularity",
    f"""WITH {GRAPH}, k AS (SELECT t, count(*) AS k FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) JOIN t USING (id) GROUP BY 1), l AS (SELECT a.t, count(*) AS l FROM e JOIN t a ON a.id = src JOIN t c ON c.id = dst WHERE a.t = c.t GROUP BY 1), m AS (SELECT count(*) AS m FROM e)
SELECT round(sum(coalesce(l, 0) / m - (k / (2.0 * m)) ** 2), 6) AS modularity FROM k LEFT JOIN l USING (t), m""",
)
def modularity(spark, d):
    return neighbors.modularity(_graph(spark, d), _states(spark, d).withColumnRenamed("t", "cluster"))


@query("graph_smoothing", f"WITH {GRAPH}, v AS (SELECT id, avg(x) AS m FROM (SELECT src AS id, c_acctbal AS x FROM e JOIN customer ON c_custkey = dst UNION ALL SELECT dst, c_acctbal FROM e JOIN customer ON c_custkey = src) GROUP BY 1) SELECT c_custkey AS id, round(coalesce(0.31415926 * c_acctbal + (1 - 0.31415926) * m, c_acctbal), 6) AS value FROM customer LEFT JOIN v ON id = c_custkey")
def graph_smoothing(spark, d):
    v = b.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    return neighbors.smooth(neighbors.adjacency(_graph(spark, d), _parts(spark, d)), v, "c_acctbal", 0.31415926, 1)


@query(
    "observed_expected",
    f"""WITH {GRAPH}, a AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), k AS (SELECT t, count(*) AS n FROM t GROUP BY 1), x AS (SELECT p.t AS own, sum((q.t = 'BUILDING')::INT) AS c, sum((q.t = p.t)::INT) AS o FROM a JOIN t p ON p.id = src JOIN t q ON q.id = dst WHERE p.t <> 'BUILDING' GROUP BY 1)
SELECT own AS t, round((c / (c + o)) / ((SELECT n FROM k WHERE t = 'BUILDING') / ((SELECT n FROM k WHERE t = 'BUILDING') + n)), 6) AS ratio FROM x JOIN k ON k.t = own""",
)
def observed_expected(spark, d):
    return neighbors.observed_expected(neighbors.adjacency(_graph(spark, d), _parts(spark, d)), _states(spark, d), "t", "BUILDING")


@query(
    "lineage_product",
    """WITH n AS (SELECT n_nationkey AS s, count(c_custkey)::DOUBLE AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1), p AS (SELECT n_regionkey AS region, sum(n) / (10 + n_regionkey) AS ratio FROM nation JOIN n ON s = n_nationkey GROUP BY 1)
SELECT n_nationkey AS nation, n_regionkey AS region, round(ratio, 6) AS score FROM nation JOIN p ON region = n_regionkey""",
)
def lineage_product(spark, d):
    n = b.table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    kids = n.join(b.table(spark, d, "customer"), n["nation"] == F.col("c_nationkey"), "left").groupBy("nation", "region").agg(F.count("c_custkey").alias("n"))
    numbers = kids.select(F.concat(F.lit("n"), "nation").alias("state"), F.col("n").cast("double").alias("n")).union(n.select("region").distinct().select(F.concat(F.lit("r"), "region"), (10.0 + F.col("region"))))
    line = n.select(F.concat(F.lit("n"), "nation").alias("young"), F.concat(F.lit("r"), "region").alias("old"))
    s = neighbors.expansion(numbers, line, "young", "old").withColumn("level", F.lit("old"))
    out = neighbors.lineage_products(s, line, ["young", "old"])
    return out.select(F.expr("substring(young, 2)").cast("int").alias("nation"), F.expr("substring(old, 2)").cast("int").alias("region"), "score")


# ---------------------------------------------------------------- classifiers

ML = f"""WITH {b.EXPR}, {b.OBS}, {b.CENTERS}, tot AS (SELECT cell_state AS label, sum(mean) AS t FROM centers GROUP BY 1), gl AS (SELECT * FROM (SELECT DISTINCT cell_state AS label FROM centers), (SELECT DISTINCT gene FROM centers)),
p AS (SELECT gl.label, gl.gene, coalesce(mean / t * 10000, 0) + 0.1 AS v FROM gl JOIN tot USING (label) LEFT JOIN centers c ON c.cell_state = gl.label AND c.gene = gl.gene), l AS (SELECT label, gene, log10(v / sum(v) OVER (PARTITION BY label)) AS l FROM p)"""


@query("max_likelihood_label", f"{ML}, s AS (SELECT cell_id, label, sum(count * l) AS loglik FROM expr JOIN l USING (gene) GROUP BY 1, 2) SELECT cell_id, label, round(loglik, 4) AS loglik FROM s QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY round(loglik, 6) DESC, label) = 1", 4)
def max_likelihood_label(spark, d):
    e = b.expr(spark, d)
    return ranks.best_label(classify.max_likelihood(e, classify.learn_profiles(e, b.obs(spark, d), "cell_state")), "cell_id", "label", "loglik", 6)


@query("pca_softmax_accuracy")
def pca_softmax_accuracy(spark, d):
    from pyspark.ml.functions import array_to_vector

    v = b.embeddings(spark, d).select("id", array_to_vector(F.col("vec").cast("array<double>")).alias("features"), F.col("label").cast("string").alias("label"))
    train = v.where("id % 5 <> 0")
    pca, _ = classify.principal_components(v, 8, fit_on=train)
    x = pca.select("id", "label", F.col("pca").alias("features"))
    out = classify.linear_classifier(x.where("id % 5 <> 0"), x.where("id % 5 = 0"), "label")
    return groups.label_scores(out, "label", "predicted")


@query(
    "project_components",
    f"""WITH {b.EXPR}, {b.SIZES}, m AS (SELECT gene, sum(count) / any_value(n) AS mean, sqrt(sum(count * count) / any_value(n) - (sum(count) / any_value(n)) ** 2) AS sd FROM expr, n GROUP BY 1), w AS (SELECT p_partkey AS gene, p_partkey % 3 AS dim, p_size / 100.0 AS w FROM part),
x AS (SELECT DISTINCT cell_id FROM expr) SELECT cell_id, dim, round(sum((coalesce(count, 0) - mean) / sd * w), 6) AS value FROM x CROSS JOIN w JOIN m USING (gene) LEFT JOIN expr USING (cell_id, gene) WHERE sd > 0 GROUP BY 1, 2""",
)
def project_components(spark, d):
    e = b.expr(spark, d)
    m = matrix.moments(e, "count", b.n_cells(spark, d)).select("gene", "mean", F.sqrt("variance").alias("sd"))
    w = b.genes(spark, d).select("gene", (F.col("gene") % 3).alias("dim"), (F.col("size") / 100).alias("w"))
    return classify.project(e, w, m, "count")


@query(
    "doublet_simulation",
    f"""WITH {b.EXPR}, {b.OBS}, k AS (SELECT donor, cell_id, row_number() OVER (PARTITION BY donor ORDER BY cell_id) - 1 AS k, count(*) OVER (PARTITION BY donor) AS n FROM obs), n AS (SELECT donor, any_value(n) AS n FROM k GROUP BY 1),
sim AS (SELECT donor, n, unnest(range(1, greatest(1, n) + 1)) AS i FROM n), pick AS (SELECT donor, i, ('0x' || substr(md5(donor || '|' || i || '|0|' || s), 1, 12))::BIGINT % n AS k FROM sim, (VALUES (1), (2)) t(s)),
x AS (SELECT donor, i, count FROM pick JOIN k USING (donor, k) JOIN expr USING (cell_id)) SELECT donor, count(DISTINCT ('0x' || substr(md5(donor || '|' || i || '|0'), 1, 12))::BIGINT) AS n, sum(count) AS total FROM x GROUP BY 1""",
)
def doublet_simulation(spark, d):
    s = classify.simulate_doublets(b.expr(spark, d), b.obs(spark, d), "donor", 1.0)
    return s.groupBy("donor").agg(F.countDistinct("cell_id").alias("n"), F.sum("count").alias("total"))


@query("cycle_phase")
def cycle_phase(spark, d):
    e, o = b.expr(spark, d), b.obs(spark, d)
    m = matrix.moments(e, "count", b.n_cells(spark, d)).select("gene", "mean")
    s = classify.matched_score(e, o, b.genes(spark, d).where("size = 1"), m, "count", 10, 5)
    g = classify.matched_score(e, o, b.genes(spark, d).where("size = 2"), m, "count", 10, 5)
    return classify.cycle_phase(s, g).groupBy("phase").agg(F.count("*").alias("n"))


@query(
    "reference_angle",
    f"""WITH {b.EXPR}, v AS (SELECT cell_id, gene, ln(1 + count) AS v FROM expr), k AS (SELECT count(DISTINCT cell_id)::DOUBLE AS k FROM expr), w AS (SELECT p_partkey AS gene, p_size / 10.0 - 2 AS a, (p_partkey % 11) / 10.0 - 0.5 AS c FROM part),
m AS (SELECT sum(m * a) AS b1, sum(m * c) AS b2 FROM (SELECT gene, sum(v) / any_value(k) AS m FROM v, k GROUP BY 1) JOIN w USING (gene)), s AS (SELECT cell_id, sum(v * a) AS a1, sum(v * c) AS a2 FROM v JOIN w USING (gene) GROUP BY 1)
SELECT cell_id, round(CASE WHEN atan2(a2 - b2, a1 - b1) < 0 THEN atan2(a2 - b2, a1 - b1) + 2 * pi() ELSE atan2(a2 - b2, a1 - b1) END, 6) AS angle FROM s, m""",
)
def reference_angle(spark, d):
    w = b.genes(spark, d).select("gene", (F.col("size") / 10 - 2).alias("pc1"), (F.col("gene") % 11 / 10 - 0.5).alias("pc2"))
    return classify.reference_angle(b.expr(spark, d), w, "count")


@query(
    "angle_phase",
    "SELECT CASE WHEN x <= 1.5 THEN 'G1' WHEN x <= 3 THEN 'S' WHEN x <= 5 THEN 'G2M' ELSE 'M' END AS phase, count(*) AS n FROM (SELECT fmod(o_totalprice / 1000, 2 * pi()) AS x FROM orders) GROUP BY 1",
)
def angle_phase(spark, d):
    x = ranks.phase(F.col("o_totalprice") / 1000, [(0, 1.5, "G1"), (1.5, 3, "S"), (3, 5, "G2M")], "M")
    return b.table(spark, d, "orders").groupBy(x.alias("phase")).agg(F.count("*").alias("n"))


@query("first_rule", "SELECT CASE WHEN o_totalprice > 250000 THEN 'high' WHEN o_orderstatus = 'F' THEN 'done' WHEN o_totalprice < 50000 THEN 'low' ELSE 'none' END AS label, count(*) AS n FROM orders GROUP BY 1")
def first_rule(spark, d):
    r = ranks.first_rule([(F.col("o_totalprice") > 250000, "high"), (F.col("o_orderstatus") == "F", "done"), (F.col("o_totalprice") < 50000, "low")], "none")
    return b.table(spark, d, "orders").groupBy(r.alias("label")).agg(F.count("*").alias("n"))


DON = "WITH p AS (SELECT c_nationkey AS donor, c_custkey % 40 AS snp, avg(c_acctbal) / 10000 AS p FROM customer GROUP BY 1, 2)"


@query("donor_match", f"{DON}, d AS (SELECT a.donor AS donor_a, c.donor AS donor_b, avg(abs(a.p - c.p)) AS dist FROM p a JOIN p c USING (snp) WHERE a.donor < 12 AND c.donor >= 12 GROUP BY 1, 2) SELECT donor_a, donor_b, round(dist, 6) AS dist FROM d QUALIFY row_number() OVER (PARTITION BY donor_a ORDER BY round(dist, 9), donor_b) = 1")
def donor_match(spark, d):
    p = b.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("donor"), (F.col("c_custkey") % 40).alias("snp")).agg((F.avg("c_acctbal") / 10000).alias("p"))
    return classify.donor_match(p.where("donor < 12"), p.where("donor >= 12"))


@query("donor_labels", "SELECT coalesce(CASE WHEN o_orderstatus <> 'P' THEN 'd' || o_orderpriority END, 'unassigned') AS donor_id, count(*) AS n FROM orders GROUP BY 1")
def donor_labels(spark, d):
    o = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("cell_id"), "o_orderstatus", "o_orderpriority")
    calls = o.where("o_orderstatus <> 'P'").select("cell_id", F.concat(F.lit("d"), "o_orderpriority").alias("donor_id"))
    return classify.donor_labels(o, calls).groupBy("donor_id").agg(F.count("*").alias("n"))
