"""Embedding, projection and classification of cells; doublets; cycle scores; angles."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws


def max_likelihood(expr: DataFrame, profiles: DataFrame, pseudo: float = 0.1, target: float = 1e4) -> DataFrame:
    """cell_id, label, loglik: sum of count * log10 of the label's gene probability, for every cell and label with a common gene.

    profiles: label, gene, mean.  Profiles are scaled to target, pseudo is
    added to every gene that any profile has, and each label's sum is 1.
    """
    genes, labels = profiles.select("gene").distinct(), profiles.select("label").distinct()
    tot = profiles.groupBy("label").agg(F.sum("mean").alias("__t"))
    full = labels.crossJoin(genes).join(profiles, ["label", "gene"], "left").join(tot, "label")
    p = full.withColumn("__v", F.coalesce(F.col("mean") / F.col("__t") * target, F.lit(0.0)) + pseudo)
    p = p.withColumn("__l", F.log10(F.col("__v") / F.sum("__v").over(Window.partitionBy("label")))).select("label", "gene", "__l")
    return expr.join(p, "gene").groupBy("cell_id", "label").agg(F.sum(F.col("count") * F.col("__l")).alias("loglik"))


def learn_profiles(expr: DataFrame, obs: DataFrame, label: str) -> DataFrame:
    """label, gene, mean: summed counts of each label's cells over its number of cells."""
    n = obs.groupBy(label).agg(F.countDistinct("cell_id").alias("n"))
    return expr.join(obs.select("cell_id", label), "cell_id").groupBy(label, "gene").agg(F.sum("count").alias("s")).join(n, label).select(F.col(label).alias("label"), "gene", (F.col("s") / F.col("n")).alias("mean"))


def vectors(df: DataFrame, key: str, feature: str, value: str, features: DataFrame) -> DataFrame:
    """key, features (dense vector) in the order of a list of features (feature, position); absent ones are 0."""
    from pyspark.ml.functions import array_to_vector

    n = features.count()
    m = df.join(F.broadcast(features), feature).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("position").cast("int"), F.col(value).cast("double")))).alias("m"))
    return m.select(key, array_to_vector(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))).alias("features"))


def principal_components(table: DataFrame, k: int, fit_on: DataFrame | None = None):
    """The table (features) with a column pca, and the fitted model; fitted on all rows or on a base table."""
    from pyspark.ml.feature import PCA, StandardScaler

    base = fit_on if fit_on is not None else table
    scale = StandardScaler(inputCol="features", outputCol="z", withMean=True).fit(base)
    model = PCA(k=k, inputCol="z", outputCol="pca").fit(scale.transform(base))
    return model.transform(scale.transform(table)), model


def project(expr: DataFrame, loadings: DataFrame, reference: DataFrame, value: str = "norm") -> DataFrame:
    """cell_id, dim, value: query cells in a reference's components.  loadings: gene, dim, w; reference: gene, mean, sd.

    A zero of the query is worth -mean / sd, summed once for each component.
    """
    l = loadings.join(reference.where("sd > 0"), "gene")
    base = l.groupBy("dim").agg(F.sum(-F.col("mean") / F.col("sd") * F.col("w")).alias("base"))
    s = expr.join(l.select("gene", "dim", (F.col("w") / F.col("sd")).alias("f")), "gene").groupBy("cell_id", "dim").agg(F.sum(F.col(value) * F.col("f")).alias("s"))
    return expr.select("cell_id").distinct().crossJoin(F.broadcast(base)).join(s, ["cell_id", "dim"], "left").select("cell_id", "dim", (F.col("base") + F.coalesce("s", F.lit(0.0))).alias("value"))


def vote(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """id, label, share: the most frequent label (id, label) among a cell's neighbours; ties to the first."""
    n = neighbours.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.count("*").alias("n"))
    w = Window.partitionBy("id")
    n = n.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("__k", F.row_number().over(w.orderBy(F.desc("n"), "label")))
    return n.where("__k = 1").select("id", "label", "share")


def linear_classifier(train: DataFrame, query: DataFrame, label: str, kind="softmax", strength: float = 0.01):
    """query with a predicted label, from softmax regression, one-vs-rest linear SVMs (svm), or any estimator of pyspark.ml, on features."""
    from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
    from pyspark.ml.feature import IndexToString, StringIndexer

    index = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc").fit(train)
    if kind == "softmax":
        est = LogisticRegression(labelCol="__y", featuresCol="features", regParam=strength, family="multinomial", predictionCol="__p")
    elif kind == "svm":
        est = OneVsRest(classifier=LinearSVC(regParam=strength), labelCol="__y", featuresCol="features", predictionCol="__p")
    else:
        est = kind.copy({kind.labelCol: "__y", kind.featuresCol: "features", kind.predictionCol: "__p"})
    out = est.fit(index.transform(train)).transform(query)
    return IndexToString(inputCol="__p", outputCol="predicted", labels=index.labels).transform(out).drop("__p", "rawPrediction", "probability")


def prediction_votes(predicted: DataFrame, condition: str, state: str, label: str) -> DataFrame:
    """condition, state, label, share of the state's cells that were given the label."""
    n = predicted.groupBy(condition, state, label).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(condition, state)))


def simulate_doublets(expr: DataFrame, obs: DataFrame, batch: str, ratio: float = 2.0, seed: int = 0) -> DataFrame:
    """cell_id (negative), batch, gene, count: sums of pairs of cells of the same batch, picked by hash."""
    w = Window.partitionBy(batch)
    ranked = obs.select("cell_id", batch, (F.row_number().over(w.orderBy("cell_id")) - 1).alias("__k"), F.count("*").over(w).alias("__n"))
    n = obs.groupBy(batch).agg(F.count("*").alias("__n"), F.min("cell_id").alias("__first"))
    sim = n.select(batch, "__n", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.col("__n") * ratio).cast("int")))).alias("i"))
    pick = lambda s: draws.number(batch, "i", seed, s) % F.col("__n")
    sim = sim.select(batch, (-draws.number(batch, "i", seed) - 1).alias("cell_id"), F.explode(F.array(pick(1), pick(2))).alias("__k"))
    parents = sim.join(ranked.select(batch, "__k", F.col("cell_id").alias("parent")), [batch, "__k"])
    return parents.join(expr.select(F.col("cell_id").alias("parent"), "gene", "count"), "parent").groupBy("cell_id", batch, "gene").agg(F.sum("count").alias("count"))


def doublet_scores(neighbours: DataFrame, obs: DataFrame) -> DataFrame:
    """id, score: share of simulated cells (negative ids) among the neighbours of each observed one."""
    s = neighbours.where("src >= 0").groupBy(F.col("src").alias("id")).agg(F.avg((F.col("dst") < 0).cast("double")).alias("score"))
    return obs.select("id").join(s, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def valley(scores: DataFrame, score: str, bins: int = 50, spread: float = 1.5) -> float | None:
    """The lowest place between the two highest modes of the smoothed histogram of a score from 0 to 1; None where there is one mode.

    The driver sees the counts of the bins.  Of two modes the lower one must
    stand out of the valley by a tenth of its height.
    """
    n = np.zeros(bins)
    for r in scores.where(F.col(score).between(0, 1)).groupBy(F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int").alias("b")).count().collect():
        n[r.b] = r["count"]
    at = np.arange(bins)
    kernel = np.exp(-((at[:, None] - at[None, :]) ** 2) / (2 * spread**2))
    smooth = (kernel / kernel.sum(1)[:, None]) @ n
    edge = np.concatenate([[-1.0], smooth, [-1.0]])
    modes = [i for i in range(bins) if edge[i + 1] > edge[i] and edge[i + 1] >= edge[i + 2] and smooth[i] > 0]
    best = None
    for i, left in enumerate(modes):
        for right in modes[i + 1 :]:
            low = left + int(smooth[left : right + 1].argmin())
            height = min(smooth[left], smooth[right])
            if smooth[low] < 0.9 * height and (best is None or height - smooth[low] > best[0]):
                best = (height - smooth[low], low)
    return None if best is None else (best[1] + 0.5) / bins


def matched_score(expr: DataFrame, cells: DataFrame, genes: DataFrame, moments: DataFrame, value: str, bins: int = 25, controls: int = 50, seed: int = 0) -> DataFrame:
    """cell_id, score: mean of a gene list less the mean of control genes from the same bins of mean expression."""
    m = moments.withColumn("bin", F.ntile(bins).over(Window.orderBy("mean", "gene")))
    mine = m.join(genes.select("gene"), "gene", "left_semi")
    pool = m.join(genes.select("gene"), "gene", "left_anti").join(mine.select("bin").distinct(), "bin", "left_semi")
    ctrl = pool.withColumn("__k", F.row_number().over(Window.partitionBy("bin").orderBy(draws.ticket("gene", seed), "gene"))).where(F.col("__k") <= controls).select("gene")
    both = mine.select("gene", F.lit(1).alias("w")).union(ctrl.select("gene", F.lit(0).alias("w")))
    n = both.agg(F.sum("w").alias("n1"), F.sum(1 - F.col("w")).alias("n0"))
    s = expr.join(F.broadcast(both), "gene").groupBy("cell_id").agg(F.sum(F.col(value) * F.col("w")).alias("s1"), F.sum(F.col(value) * (1 - F.col("w"))).alias("s0"))
    x = cells.select("cell_id").join(s, "cell_id", "left").crossJoin(F.broadcast(n))
    return x.select("cell_id", (F.coalesce("s1", F.lit(0.0)) / F.col("n1") - F.coalesce("s0", F.lit(0.0)) / F.col("n0")).alias("score"))


def cycle_phase(s_score: DataFrame, g2m_score: DataFrame) -> DataFrame:
    """cell_id, phase: the larger score's phase, G1 if neither is positive."""
    x = s_score.select("cell_id", F.col("score").alias("s")).join(g2m_score.select("cell_id", F.col("score").alias("g")), "cell_id")
    return x.select("cell_id", F.when((F.col("s") <= 0) & (F.col("g") <= 0), "G1").when(F.col("s") >= F.col("g"), "S").otherwise("G2M").alias("phase"))


def reference_angle(expr: DataFrame, loadings: DataFrame, value: str = "norm") -> DataFrame:
    """cell_id, angle: direction of a cell in a two-column reference (gene, pc1, pc2), log-normalised values, centred by gene."""
    n = expr.select("cell_id").distinct().count()
    e = expr.join(F.broadcast(loadings), "gene").withColumn("__v", F.log1p(value))
    mean = e.groupBy("gene").agg((F.sum("__v") / n).alias("__m"))
    base = loadings.join(mean, "gene").agg(F.sum(F.col("__m") * F.col("pc1")).alias("b1"), F.sum(F.col("__m") * F.col("pc2")).alias("b2"))
    s = e.groupBy("cell_id").agg(F.sum(F.col("__v") * F.col("pc1")).alias("a1"), F.sum(F.col("__v") * F.col("pc2")).alias("a2")).crossJoin(F.broadcast(base))
    return s.select("cell_id", F.pmod(F.atan2(F.col("a2") - F.col("b2"), F.col("a1") - F.col("b1")), F.lit(2 * math.pi)).alias("angle"))


def donor_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """donor_a, donor_b, dist: for each donor of a the one of b with the smallest mean genotype difference over shared SNPs.

    a, b: donor, snp, p.
    """
    x = a.select("snp", F.col("donor").alias("donor_a"), F.col("p").alias("pa")).join(b.select("snp", F.col("donor").alias("donor_b"), F.col("p").alias("pb")), "snp")
    d = x.groupBy("donor_a", "donor_b").agg(F.avg(F.abs(F.col("pa") - F.col("pb"))).alias("dist"))
    return d.withColumn("__k", F.row_number().over(Window.partitionBy("donor_a").orderBy(F.round("dist", 9), "donor_b"))).where("__k = 1").drop("__k")


def donor_labels(obs: DataFrame, donors: DataFrame, missing: str = "unassigned") -> DataFrame:
    """obs with donor_id; barcodes without a call get the missing label."""
    return obs.join(donors.select("cell_id", F.col("donor_id").alias("__d")), "cell_id", "left").withColumn("donor_id", F.coalesce("__d", F.lit(missing))).drop("__d")
