"""Binds the roles of the operators to the given tables, in DataFrames and in SQL.

A customer is a cell, a part is a gene, and the quantity ordered is a count;
market segments are cell states, nations are donors, brands and sizes are
gene sets, parts of equal name are orthologs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of the largest table that a task of a shuffle has on average.
ROWS = 1 << 18


def deal(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """df, after spark.sql.shuffle.partitions of the session was raised with its rows, so that no task has more of them on larger tables.

    More partitions that the session has stay; adaptive execution puts small ones together.
    """
    conf, name = df.sparkSession.conf, "spark.sql.shuffle.partitions"
    conf.set(name, str(max(int(conf.get(name)), -(-df.count() // rows))))
    return df


def expr(spark: SparkSession, d: str) -> DataFrame:
    l, o = deal(table(spark, d, "lineitem")).select("l_orderkey", "l_partkey", "l_quantity"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return l.join(o, l["l_orderkey"] == o["o_orderkey"]).groupBy(F.col("o_custkey").alias("cell_id"), F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").alias("count"))


def obs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("cell_state"), F.col("c_nationkey").alias("donor"))


def genes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"), F.col("p_name").alias("name"))


def brand_sets(spark: SparkSession, d: str) -> DataFrame:
    return genes(spark, d).select(F.col("brand").alias("set_name"), "gene")


def bridge(spark: SparkSession, d: str) -> DataFrame:
    g = genes(spark, d)
    return g.select("name", F.col("gene").alias("gene_a")).join(g.select("name", F.col("gene").alias("gene_b")), "name").where("gene_a <> gene_b").select("gene_a", "gene_b")


def n_cells(spark: SparkSession, d: str) -> int:
    return table(spark, d, "customer").count()


def order_obs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as cells: condition = status, replicate = priority, state = the customer's segment."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_orderkey").alias("cell_id"), F.col("o_orderstatus").alias("condition"), F.col("o_orderpriority").alias("replicate"), F.col("c_mktsegment").alias("cell_state"))


def order_counts(spark: SparkSession, d: str) -> DataFrame:
    """Quantities by order and brand: cells and genes for designs over orders."""
    l, p = table(spark, d, "lineitem"), table(spark, d, "part")
    return l.join(p, l["l_partkey"] == p["p_partkey"]).groupBy(F.col("l_orderkey").alias("cell_id"), F.col("p_brand").alias("gene")).agg(F.sum("l_quantity").alias("count"))


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def reads(spark: SparkSession, d: str) -> DataFrame:
    """Events as reads: bases from the digest of event_id, the user as cell, the type as tag."""
    e = deal(table(spark, d, "events"), ROWS // 4)  # a read is some dozen rows where its barcodes are corrected
    seq = F.translate(F.md5(F.col("event_id").cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")
    return e.select(F.col("event_id").alias("read_id"), F.col("user_id").alias("cell"), F.col("event_type").alias("tag"), F.substring(seq, 1, 3).alias("umi"), F.substring(seq, 1, 12).alias("seq"), seq.alias("r1"), "ts", "value")


EXPR = "expr AS (SELECT o_custkey AS cell_id, l_partkey AS gene, sum(l_quantity) AS count FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"
OBS = "obs AS (SELECT c_custkey AS cell_id, c_mktsegment AS cell_state, c_nationkey AS donor FROM customer)"
GENES = "genes AS (SELECT p_partkey AS gene, p_brand AS brand, p_type AS kind, p_size AS size, p_name AS name FROM part)"
BRIDGE = "bridge AS (SELECT a.p_partkey AS gene_a, b.p_partkey AS gene_b FROM part a JOIN part b ON a.p_name = b.p_name WHERE a.p_partkey <> b.p_partkey)"
ORDER_OBS = "oobs AS (SELECT o_orderkey AS cell_id, o_orderstatus AS condition, o_orderpriority AS replicate, c_mktsegment AS cell_state FROM orders JOIN customer ON o_custkey = c_custkey)"
READS = "reads AS (SELECT event_id AS read_id, user_id AS cell, event_type AS tag, substr(s, 1, 3) AS umi, substr(s, 1, 12) AS seq, s AS r1, ts, value FROM (SELECT *, translate(md5(event_id::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s FROM events))"
SIZES = "n AS (SELECT count(*)::DOUBLE AS n FROM customer)"
#: Group means with zeros counted.
CENTERS = """sizes AS (SELECT cell_state, count(*) AS k FROM obs GROUP BY 1),
centers AS (SELECT cell_state, gene, sum(count) / any_value(k) AS mean, 100.0 * count(*) / any_value(k) AS pct FROM expr JOIN obs USING (cell_id) JOIN sizes USING (cell_state) GROUP BY 1, 2)"""


def two_sided_sql(z: str) -> str:
    """The normal tail in SQL by another way than functions.tails: the series of erf around 0, else the mean of exp(-z^2 / (2 sin^2 t)) over a quarter turn."""
    x = f"(abs({z}) / sqrt(2.0))"
    near = f"1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 30), lambda k: pow(-1.0, k) * pow({x}, 2 * k + 1) / (gamma(k + 1) * (2 * k + 1))))"
    far = f"list_sum(list_transform(range(0, 128), lambda k: exp(-({z}) * ({z}) / (2 * pow(sin((k + 0.5) * pi() / 256), 2))))) / 128"
    return f"(CASE WHEN abs({z}) < 1 THEN {near} ELSE {far} END)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation doesn't show."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
