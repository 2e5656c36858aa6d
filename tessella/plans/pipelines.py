"""Standard chains of operators: counts to clusters, and reference to query labels.  Every step is a function of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import classify, communities, components, descent, matrix, neighbors
from ..operators.settle import settle
from . import bindings as b
from .catalog import query


def feature_list(genes: DataFrame) -> DataFrame:
    """gene, position: a short list of feature genes numbered by name."""
    return genes.select("gene").distinct().withColumn("position", F.row_number().over(Window.orderBy("gene")) - 1)


def features(expr: DataFrame, n_cells: int, top: int, min_cells: int = 3, seeds: DataFrame | None = None, max_corr: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Normalised counts of the variable genes, and their list; genes that follow the seeds too closely are left out."""
    kept = matrix.filter_genes(expr, min_cells=min_cells)
    norm = settle(matrix.per_cell(kept).select("cell_id", "gene", F.log1p("norm").alias("norm")))
    chosen = matrix.dispersion_genes(norm, "norm", n_cells, 20, top).select("gene")
    if seeds is not None:
        r = matrix.seed_correlation(norm, "norm", seeds, n_cells).groupBy("gene").agg(F.max(F.abs("r")).alias("r"))
        chosen = matrix.drop_signature_genes(chosen, r, max_corr)
    genes = settle(feature_list(chosen))
    return norm.join(genes.select("gene"), "gene", "left_semi"), genes


def process_counts(expr: DataFrame, n_cells: int, top: int = 100, n_components: int = 10, k: int = 10, rounds: int = 12, tolerance: float = 1e-3) -> dict[str, DataFrame]:
    """Components, neighbours, graph edges and clusters of a count matrix with numeric cell_id, and modularity, a row a level.

    Components come from non-zeros, neighbours by descent, clusters by
    modularity, so no step looks at all pairs of cells or fills in zeros.
    """
    norm, _ = features(expr, n_cells, top)
    pcs = components.sparse_components(norm, n_cells, n_components, rounds=rounds, tolerance=tolerance)
    emb = settle(pcs.scores.select(F.col("cell_id").alias("id"), F.array(*(f"v{i}" for i in range(n_components))).alias("vec")))
    near = descent.neighbours(emb, k)
    edges = settle(neighbors.edges(near))
    log: list[float] = []
    clusters = communities.modularity_clusters(edges, log=log)
    rows = expr.sparkSession.createDataFrame(list(enumerate(log)), "level int, modularity double")
    return {"components": emb, "neighbours": near, "edges": edges, "clusters": clusters, "modularity": rows}


def label_query(reference: DataFrame, labels: DataFrame, label: str, target: DataFrame, n_cells: int, top: int = 60, n_components: int = 8, kind="softmax", seeds: DataFrame | None = None, max_corr: float = 0.8) -> DataFrame:
    """cell_id, predicted: labels of a reference carried to a query through the reference's genes, components and a classifier.

    kind: softmax, svm, or an estimator of pyspark.ml with labelCol and
    featuresCol.  seeds (gene): genes that follow them more closely than
    max_corr are left out, and once more those that follow any of the genes
    left out so.
    """
    if seeds is not None:
        once = settle(matrix.per_cell(matrix.filter_genes(reference, min_cells=3)).select("cell_id", "gene", F.log1p("norm").alias("norm")))
        r = matrix.seed_correlation(once, "norm", seeds, n_cells).groupBy("gene").agg(F.max(F.abs("r")).alias("r"))
        seeds = settle(r.where(F.col("r") > max_corr).select("gene").union(seeds.select("gene")).distinct())
    norm, genes = features(reference, n_cells, top, seeds=seeds, max_corr=max_corr)
    other = matrix.per_cell(target).select("cell_id", "gene", F.log1p("norm").alias("norm")).join(genes.select("gene"), "gene", "left_semi")
    base = settle(classify.vectors(norm, "cell_id", "gene", "norm", genes))
    both = base.withColumn("ref", F.lit(True)).union(classify.vectors(other, "cell_id", "gene", "norm", genes).withColumn("ref", F.lit(False)))
    pca, _ = classify.principal_components(both, n_components, fit_on=base)
    x = settle(pca.select("cell_id", "ref", F.col("pca").alias("features")))
    train = x.where("ref").join(labels.select("cell_id", label), "cell_id")
    return classify.linear_classifier(train, x.where("not ref"), label, kind).select("cell_id", "predicted")


def with_doublets(expr: DataFrame, obs: DataFrame, batch: str, ratio: float, seed: int) -> DataFrame:
    """cell_id, gene, count of the observed cells and of the simulated ones (negative cell_id)."""
    expr = settle(expr.select("cell_id", "gene", "count"))
    return settle(expr.union(classify.simulate_doublets(expr, obs, batch, ratio, seed).select("cell_id", "gene", "count")))


def call_doublets(expr: DataFrame, obs: DataFrame, batch: str, n_cells: int, top: int = 100, n_components: int = 10, k: int = 15, ratio: float = 2.0, rounds: int = 12, tolerance: float = 1e-3, seed: int = 0) -> DataFrame:
    """cell_id, score, threshold, doublet of every cell: the share of simulated doublets among its neighbours, and whether it is beyond the valley.

    Doublets are sums of pairs of cells of a batch.  Features and components
    come from the observed cells, all are projected, neighbours come by
    descent; the threshold lies between the two modes of the simulated cells'
    own scores, and is null, with no calls, where they have one mode only.
    """
    expr = settle(expr.select("cell_id", "gene", F.col("count").cast("double").alias("count")))
    _, genes = features(expr, n_cells, top)
    # of all counts only the sum of a cell matters beside those of the features, and a simulated cell's is that of its parents
    totals = expr.groupBy("cell_id").agg(F.sum("count").alias("count")).withColumn("gene", F.lit(None).cast(expr.schema["gene"].dataType))
    of_genes, total = (with_doublets(x, obs, batch, ratio, seed) for x in (expr.join(genes.select("gene"), "gene", "left_semi"), totals))
    norm = of_genes.join(total.groupBy("cell_id").agg(F.sum("count").alias("total")), "cell_id").select("cell_id", "gene", F.log1p(F.col("count") / F.col("total") * 1e4).alias("norm"))
    pcs = components.sparse_components(settle(norm), n_cells, n_components, base=obs.select("cell_id"), rounds=rounds, tolerance=tolerance)
    emb = settle(pcs.scores.select(F.col("cell_id").alias("id"), F.array(*(f"v{i}" for i in range(n_components))).alias("vec")))
    near = settle(descent.neighbours(emb, k, seed=seed))
    score = settle(near.groupBy(F.col("src").alias("id")).agg(F.avg((F.col("dst") < 0).cast("double")).alias("score")))
    cut = classify.valley(score.where("id < 0"), "score")
    own = classify.doublet_scores(near, obs.select(F.col("cell_id").alias("id")))
    return own.select(F.col("id").alias("cell_id"), "score", F.lit(cut).cast("double").alias("threshold"), F.coalesce(F.col("score") > F.lit(cut).cast("double"), F.lit(False)).alias("doublet"))


@query("standard_pipeline")
def standard_pipeline(spark, d):
    out = process_counts(b.expr(spark, d), b.n_cells(spark, d), top=50, n_components=5, k=5, rounds=4)
    last = out["modularity"].agg(F.max("modularity").alias("modularity"))
    return out["clusters"].groupBy("cluster").agg(F.count("*").alias("n")).crossJoin(F.broadcast(last))


@query("reference_to_query")
def reference_to_query(spark, d):
    """Cells of two regions' donors stand for the reference, all others for the query."""
    e, o = b.expr(spark, d), b.obs(spark, d)
    ref = b.table(spark, d, "nation").where("n_regionkey < 2").select(F.col("n_nationkey").alias("donor"))
    mine = o.join(ref, "donor", "left_semi")
    target = e.join(o.join(ref, "donor", "left_anti").select("cell_id"), "cell_id", "left_semi")
    out = label_query(e.join(mine.select("cell_id"), "cell_id", "left_semi"), mine, "cell_state", target, mine.count(), top=30, n_components=5)
    return out.groupBy("predicted").agg(F.count("*").alias("n"))


@query("significant_components")
def significant_components(spark, d):
    """Variances of the leading components, and how many are larger than those of tables with each gene shuffled over cells."""
    e = b.expr(spark, d)
    norm, _ = features(e, b.n_cells(spark, d), 50)
    n, real, null = components.significant(settle(norm), b.obs(spark, d), 5, rounds=2, tolerance=1e-2)
    return spark.createDataFrame([(i, float(v), float(null.max()), i < n) for i, v in enumerate(real)], "component int, variance double, null_variance double, significant boolean")


@query("doublet_calls")
def doublet_calls(spark, d):
    """Scores and calls of all cells; tests plant doublets and find them."""
    return call_doublets(b.expr(spark, d), b.obs(spark, d), "donor", b.n_cells(spark, d), top=50, n_components=5, k=10, ratio=1.0, rounds=4)
