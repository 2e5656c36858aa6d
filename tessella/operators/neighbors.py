"""Nearest neighbours and what lives among them; state graphs; smoothing; clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .settle import settle


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


#: Numbers of the vectors that a block of the reference, or of the queries, has at most on average.
BLOCK = 1 << 24
#: Pairs that are worth a block of their own.
PAIRS = 1 << 22
#: Queries and reference vectors whose product is taken at once.
TILE_Q, TILE_R = 512, 4096


def knn(queries: DataFrame, reference: DataFrame, k: int, metric: str = "euclidean", include_self: bool = False, blocks: int | None = None, within: str | None = None, share: str | None = None, digits: int | None = 9) -> DataFrame:
    """src, dst, dist, rank: the exact k nearest reference vectors of each query (id, vec); with within, a column of the reference, those of each of its values, and the value.

    Queries and reference are dealt over blocks that meet pair by pair; matrix
    products sort out what can't be among the k best of a block, and the
    distances of the rest are summed number by number, as SQL would.  A query
    keeps its k best of a block, and the best of those are kept, so no task
    sees all pairs of a query.  Ties go to the smaller id.  A distance that
    isn't a number (nulls, lengths other than the longest of the reference) is null and comes last.  With share, a column of
    arrays of numbers on both sides, only vectors count that have the same
    number at one place at least.  digits: None leaves distances unrounded.
    """
    spark = queries.sparkSession
    nr, dim = reference.agg(F.count("*"), F.max(F.when(F.col("vec").isNotNull(), F.size("vec")))).first()
    nq, dim = queries.count(), dim or 1
    rows = max(1, BLOCK // dim)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks or max(1, -(-nr // rows), min(parts, -(-nq * nr // PAIRS)))
    deals = max(1, -(-nq // rows))
    group = [within] if within else []
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    # columns of both sides get names of their own, as both may come from one table
    vec = lambda df: F.col("vec") if df.schema["vec"].dataType.simpleString() == "array<float>" else F.col("vec").cast("array<double>")
    r = reference.select(F.col("id").alias("dst"), vec(reference).alias("rvec"), *([F.col(share).alias("rkeys")] if share else []), *[F.col(g).alias("grp") for g in group], F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("rb")).withColumn("qb", every(deals))
    q = queries.select(F.col("id").alias("src"), vec(queries).alias("qvec"), *([F.col(share).alias("qkeys")] if share else []), F.pmod(F.xxhash64("id"), F.lit(deals)).alias("qb")).withColumn("rb", every(blocks))
    types = {"src": queries.schema["id"].dataType, "dst": reference.schema["id"].dataType} | ({"grp": reference.schema[within].dataType} if within else {})
    schema = ", ".join(f"{c} {t.simpleString()}" for c, t in types.items()) + ", dist double"
    none = spark.createDataFrame([], schema).toArrow()

    def tiles(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return none
        return _block_best(left, right, k, metric, include_self, dim, bool(group))

    # a pair of blocks is a partition of its own, or shares one with few
    n = max(parts, blocks * deals)
    p = q.repartition(n, "rb", "qb").groupBy("rb", "qb").cogroup(r.repartition(n, "rb", "qb").groupBy("rb", "qb")).applyInArrow(tiles, schema)
    p = p.select("src", "dst", *[F.col("grp").alias(g) for g in group], (F.col("dist") if digits is None else F.round("dist", digits)).alias("dist"))
    order = [F.asc_nulls_last("dist"), F.asc("dst")]
    return p.withColumn("rank", F.row_number().over(Window.partitionBy("src", *group).orderBy(*order))).where(F.col("rank") <= k).select("src", "dst", "dist", "rank", *group)


def _matrix(t: pa.Table, vec: str, dim: int) -> np.ndarray:
    """The vectors of a table in rows; one that is null, of another length or has nulls is of NaN."""
    lists = t.column(vec).combine_chunks()
    out = np.full((t.num_rows, dim), np.nan)
    fits = (lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dim)
    flat = lists.filter(pa.array(fits)).flatten()
    out[fits] = flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    return out


def _block_best(left: pa.Table, right: pa.Table, k: int, metric: str, include_self: bool, dim: int, grouped: bool) -> pa.Table:
    """The k best reference vectors (of each group) of each query in a pair of blocks, and what rounding may still put before them."""
    right = right.sort_by("dst")
    x, y, i, j = _matrix(left, "qvec", dim), _matrix(right, "rvec", dim), left.column("src").combine_chunks(), right.column("dst").combine_chunks()
    # a vector isn't its own neighbour, however often its id occurs
    own, named, most = np.full(len(i), -1), np.zeros(len(j), dtype=np.int64), 0
    if not include_self and len(i) and len(j):
        ids = j.dictionary_encode()
        named = ids.indices.fill_null(-2).to_numpy(zero_copy_only=False)
        own = pc.index_in(i, value_set=ids.dictionary).fill_null(-1).to_numpy(zero_copy_only=False)
        most = int(np.unique(named, return_counts=True)[1].max())
    keys = [_matrix(t, c, t.column(c)[0].as_py().__len__()) for t, c in ((left, "qkeys"), (right, "rkeys"))] if "qkeys" in left.column_names else None
    parts = [np.arange(len(y))]
    if grouped and len(y):
        codes = right.column("grp").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(codes[order])) + 1)
    src, dst, dist = [], [], []
    for at in range(0, len(x), TILE_Q):
        a = x[at : at + TILE_Q]
        for rows in parts:
            s, d, v = _tile_best(a, y, rows, own[at : at + TILE_Q], named, k, k + most, metric, (keys[0][at : at + TILE_Q], keys[1]) if keys else None)
            src.append(s + at)
            dst.append(d)
            dist.append(v)
    s, d, v = (np.concatenate(c) if c else np.empty(0, dtype=t) for c, t in ((src, np.int64), (dst, np.int64), (dist, float)))
    cols = {"src": i.take(pa.array(s)), "dst": j.take(pa.array(d))} | ({"grp": right.column("grp").take(pa.array(d))} if grouped else {})
    return pa.table(cols | {"dist": pa.array(v, mask=~(np.abs(v) < np.inf))})


def _tile_best(a: np.ndarray, y: np.ndarray, rows: np.ndarray, own: np.ndarray, named: np.ndarray, k: int, enough: int, metric: str, keys: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a, of y and distances: the candidates for the k best among the rows of y (ascending by id) of each row of a."""
    cosine = metric == "cosine"
    if not len(rows):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
    na = np.einsum("ij,ij->i", a, a)
    with np.errstate(all="ignore"):
        scaled = a / np.sqrt(na)[:, None] if cosine else a
    limit = np.full(len(a), np.inf)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, len(rows), TILE_R):
        at = rows[lo : lo + TILE_R]
        b = y[at]
        nb = np.einsum("ij,ij->i", b, b)
        with np.errstate(all="ignore"):
            if cosine:
                d = 1 - scaled @ (b / np.sqrt(nb)[:, None]).T
                slack = 1e-15 * (a.shape[1] + 64)
            else:
                # squared distances, with the error of the product taken off
                d = na[:, None] + nb[None, :] - 2 * (a @ b.T)
                slack = 1e-15 * (a.shape[1] + 64) * (na + (nb[np.isfinite(nb)].max() if np.isfinite(nb).any() else 0.0))[:, None]
            d = np.where(np.isfinite(d), d - slack, np.inf)
            near = d <= limit[:, None]
            if keys and np.count_nonzero(near) > len(a):
                met = np.zeros(d.shape, dtype=bool)
                for x, z in zip(keys[0].T, keys[1][at].T, strict=True):
                    met |= x[:, None] == z[None, :]
                near &= met
                d[~met] = np.inf
            if len(at) > 4 * enough and np.count_nonzero(near) > 8 * enough * len(a):
                # of many at once those up to the last that is needed of this tile, with the error added
                edge = np.partition(d, enough, axis=1)[:, enough] + np.broadcast_to(3 * np.asarray(slack), (len(a), 1))[:, 0]
                near &= ~(d > (edge + 1e-8 * (1 + np.sqrt(np.abs(edge))))[:, None])
        r, c = np.nonzero(near)
        c = at[c]
        other = own[r] != named[c]
        if keys:
            other &= (keys[0][r] == keys[1][c]).any(axis=1)
        held.append((r[other], c[other], _exact(a, y, r[other], c[other], cosine)))
        r, c, v = (np.concatenate(z) for z in zip(*held, strict=True))
        r, c, v, worst = _first(r, c, v, len(a), k)
        held = [(r, c, v)]
        with np.errstate(all="ignore"):
            limit = np.where(np.isfinite(worst), worst if cosine else worst * worst * (1 + 1e-12) + 1e-300, np.inf)
    return held[0]


def _exact(a: np.ndarray, y: np.ndarray, r: np.ndarray, c: np.ndarray, cosine: bool) -> np.ndarray:
    """Distances of pairs, summed number by number from the first on; infinite where they aren't numbers."""
    out = np.empty(len(r))
    with np.errstate(all="ignore"):
        for lo in range(0, len(r), 65536):
            p, q = a[r[lo : lo + 65536]], y[c[lo : lo + 65536]]
            total = lambda z: np.cumsum(z, axis=1)[:, -1] if z.shape[1] else np.zeros(len(z))
            out[lo : lo + 65536] = 1 - total(p * q) / np.sqrt(total(p * p) * total(q * q)) if cosine else np.sqrt(total((p - q) ** 2))
    return np.where(np.isfinite(out), out, np.inf)


def _first(r: np.ndarray, c: np.ndarray, v: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each of n queries, those that rounding to nine digits may put level with them (k of each distance), and the distance up to which they reach."""
    order = np.lexsort((c, v, r))
    r, c, v = r[order], c[order], v[order]
    start = np.searchsorted(r, np.arange(n))
    many = np.diff(np.append(start, len(r)))
    worst = np.full(n, np.inf)
    full = many >= k
    worst[full] = v[start[full] + k - 1] + 2e-9
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (v[1:] != v[:-1])]) if len(r) else np.zeros(0, dtype=bool)
    run = np.flatnonzero(new)
    place = np.arange(len(r)) - np.repeat(run, np.diff(np.append(run, len(r))))
    keep = (v <= worst[r]) & (place < k)
    return r[keep], c[keep], v[keep], worst


def knn_approximate(vectors: DataFrame, k: int, bucket: float, tables: int = 4, reach: float | None = None, seed: int = 0, queries: DataFrame | None = None) -> DataFrame:
    """src, dst, dist, rank among candidates that share a bucket of a random projection in at least one table; of all vectors, or of the queries among them."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.select("id", array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(v)

    def hashed(df: DataFrame) -> DataFrame:
        x = df.select("id", "vec", array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
        return model.transform(x).select("id", "vec", F.array(*(F.get(vector_to_array(F.get("hashes", t)), F.lit(0)) for t in range(tables))).alias("buckets"))

    # pairs of a bucket meet in blocks: joined as rows, those of wide buckets would be shuffled once for each table
    r = hashed(vectors)
    return knn(r if queries is None else hashed(queries), r, k, share="buckets", digits=None).where(F.col("dist") < (reach or 1e9))


def knn_by_batch(vectors: DataFrame, batch: str, k: int, queries: DataFrame | None = None) -> DataFrame:
    """Neighbours balanced over batches: the k nearest of every batch, of all vectors or of the queries.  vectors: id, vec, batch; one pass for all batches."""
    return knn(vectors if queries is None else queries, vectors, k, within=batch)


def edges(neighbours: DataFrame, parts: int | None = None) -> DataFrame:
    """src, dst of each undirected edge once, src < dst; with parts, told apart in so many tasks."""
    e = neighbours.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return (e.repartition(parts, "src", "dst") if parts else e).distinct()


def adjacency(e: DataFrame, parts: int | None = None) -> DataFrame:
    """Both directions of each edge; with parts, in so many tasks by src."""
    both = e.select("src", "dst").union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return (both.repartition(parts, "src", "dst") if parts else both).distinct()


def composition(neighbours: DataFrame, obs: DataFrame, category: str, include_self: bool = True) -> DataFrame:
    """id, category, n: neighbours of each category around a cell, and the cell itself."""
    lab = obs.select(F.col("id").alias("dst"), F.col(category))
    n = neighbours.select("src", "dst")
    if include_self:
        n = n.union(obs.select(F.col("id"), F.col("id"))).distinct()
    return n.join(lab, "dst").groupBy(F.col("src").alias("id"), category).agg(F.count("*").alias("n"))


def density_ratio(neighbours: DataFrame, obs: DataFrame, category: str, a, b, offset: float = 1.0) -> DataFrame:
    """id, log2_density: log2((n_a + offset) / (n_b + offset)) around each cell."""
    c = composition(neighbours, obs, category)
    n = lambda v: F.sum(F.when(F.col(category) == v, F.col("n")).otherwise(0))
    return c.groupBy("id").agg(F.log2((n(a) + offset) / (n(b) + offset)).alias("log2_density"))


def neighbour_mean(neighbours: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """id, mean of a value over a cell's neighbours."""
    return neighbours.join(values.select(F.col("id").alias("dst"), value), "dst").groupBy(F.col("src").alias("id")).agg(F.avg(value).alias("mean"))


def smooth(neighbours: DataFrame, values: DataFrame, value: str, beta: float, rounds: int, every: int = 4) -> DataFrame:
    """id, value after rounds of x = beta x + (1 - beta) mean of neighbours; lineage is cut every few rounds by a checkpoint.

    Cells without neighbours keep their value.
    """
    if rounds > 1:
        neighbours = settle(neighbours.select("src", "dst"))
    now = values.select("id", F.col(value).cast("double").alias("value"))
    for k in range(rounds):
        m = neighbour_mean(neighbours, now, "value")
        now = now.join(m, "id", "left").select("id", F.coalesce(beta * F.col("value") + (1 - beta) * F.col("mean"), "value").alias("value"))
        if (k + 1) % every == 0 and k + 1 < rounds:
            now = settle(now)
    return now


def observed_expected(neighbours: DataFrame, obs: DataFrame, condition: str, control) -> DataFrame:
    """condition, ratio: share of control cells among the control and own-condition neighbours, over what chance gives.

    neighbours should include the cells themselves.
    """
    n = obs.groupBy(condition).agg(F.count("*").alias("n"))
    nc = n.where(F.col(condition) == control).select(F.col("n").alias("__c"))
    c = composition(neighbours, obs, condition, include_self=False)
    own = obs.select("id", F.col(condition).alias("__own"))
    x = c.join(own, "id").where(F.col("__own") != control).groupBy("__own").agg(F.sum(F.when(F.col(condition) == control, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col(condition) == F.col("__own"), F.col("n")).otherwise(0)).alias("b"))
    x = x.join(n, x["__own"] == n[condition]).crossJoin(F.broadcast(nc))
    return x.select(F.col("__own").alias(condition), ((F.col("a") / (F.col("a") + F.col("b"))) / (F.col("__c") / (F.col("__c") + F.col("n")))).alias("ratio"))


def state_graph(e: DataFrame, obs: DataFrame, state: str, progenitors: list | None = None, cut: float = 0.3) -> DataFrame:
    """t1, t2 (t1 < t2), weight: cross-state edges over the root of both states' cross edges, cut at a share of the largest.

    With progenitors, edges between those and other states and all further
    edges are weighed and cut on their own, and the larger weight stays.
    """
    lab = obs.select(F.col("id"), F.col(state).alias("t"))
    x = e.join(lab.select(F.col("id").alias("src"), F.col("t").alias("a")), "src").join(lab.select(F.col("id").alias("dst"), F.col("t").alias("b")), "dst").where("a <> b")
    n = x.groupBy(F.least("a", "b").alias("t1"), F.greatest("a", "b").alias("t2")).agg(F.count("*").alias("n"))
    cross = (F.col("t1").isin(progenitors) != F.col("t2").isin(progenitors)) if progenitors else F.lit(False)
    n = n.withColumn("part", cross.cast("int"))
    m = n.select("part", F.col("t1").alias("t"), "n").union(n.select("part", F.col("t2").alias("t"), "n")).groupBy("part", "t").agg(F.sum("n").alias("m"))
    w = n.join(m.select("part", F.col("t").alias("t1"), F.col("m").alias("m1")), ["part", "t1"]).join(m.select("part", F.col("t").alias("t2"), F.col("m").alias("m2")), ["part", "t2"])
    w = w.withColumn("weight", F.col("n") / F.sqrt(F.col("m1") * F.col("m2"))).withColumn("__top", F.max("weight").over(Window.partitionBy("part")))
    return w.where(F.col("weight") >= cut * F.col("__top")).groupBy("t1", "t2").agg(F.max("weight").alias("weight"))


def maximum_spanning_tree(graph: DataFrame) -> DataFrame:
    """t1, t2, weight of a maximum spanning forest of a state graph, by rounds in which every tree takes its best outgoing edge.

    Ties go to the smaller pair, so each edge has a place of its own and a
    round adds no cycle.
    """
    g = settle(graph.select("t1", "t2", "weight")).withColumn("place", F.struct((-F.col("weight")).alias("w"), "t1", "t2"))
    comp = g.select(F.col("t1").alias("t")).union(g.select("t2")).distinct().withColumn("c", F.col("t"))
    tree = None
    while True:
        x = g.join(comp.select(F.col("t").alias("t1"), F.col("c").alias("c1")), "t1").join(comp.select(F.col("t").alias("t2"), F.col("c").alias("c2")), "t2").where("c1 <> c2")
        both = x.select("c1", "c2", "place").union(x.select(F.col("c2").alias("c1"), F.col("c1").alias("c2"), "place"))
        best = both.groupBy("c1").agg(F.min(F.struct("place", "c2")).alias("b")).select("c1", "b.c2", "b.place")
        # states are few: a round's edges and labels are a handful of rows
        rows = best.collect()
        if not rows:
            break
        labels = {r.t: r.c for r in comp.collect()}
        root = {c: c for c in labels.values()}

        def find(c):
            while root[c] != c:  # noqa: B023
                c = root[c]  # noqa: B023
            return c

        for r in rows:
            a, b = find(r.c1), find(r.c2)
            root[max(a, b)] = min(a, b)
        spark = graph.sparkSession
        comp = spark.createDataFrame([(t, find(c)) for t, c in labels.items()], comp.schema)
        new = spark.createDataFrame(sorted({(r.place.t1, r.place.t2, -r.place.w) for r in rows}), g.select("t1", "t2", "weight").schema)
        tree = new if tree is None else tree.union(new)
    return tree.distinct() if tree is not None else g.select("t1", "t2", "weight").limit(0)


def label_propagation(e: DataFrame, rounds: int = 10) -> DataFrame:
    """id, cluster: every cell takes the most frequent label around it, its own counting once, ties to the smallest; deterministic."""
    adj = settle(adjacency(e))
    now = adj.select(F.col("src").alias("id")).distinct().withColumn("cluster", F.col("id"))
    for _ in range(rounds):
        votes = adj.join(now.select(F.col("id").alias("dst"), "cluster"), "dst").select(F.col("src").alias("id"), "cluster").union(now.select("id", "cluster"))
        n = votes.groupBy("id", "cluster").agg(F.count("*").alias("n"))
        now = n.groupBy("id").agg(F.max(F.struct("n", (-F.col("cluster")).alias("c"))).alias("m")).select("id", (-F.col("m.c")).alias("cluster"))
        now = settle(now)
    return now


def modularity(e: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: modularity of a clustering of an undirected graph."""
    c = clusters.select("id", "cluster")
    m = e.agg(F.count("*").alias("m"))
    deg = adjacency(e).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k")).join(c, "id").groupBy("cluster").agg(F.sum("k").alias("k"))
    inside = e.join(c.select(F.col("id").alias("src"), "cluster"), "src").join(c.select(F.col("id").alias("dst"), F.col("cluster").alias("c2")), "dst").where("cluster = c2").groupBy("cluster").agg(F.count("*").alias("l"))
    x = deg.join(inside, "cluster", "left").crossJoin(F.broadcast(m))
    return x.agg(F.sum(F.coalesce("l", F.lit(0)) / F.col("m") - (F.col("k") / (2 * F.col("m"))) ** 2).alias("modularity"))


def spectral_clusters(e: DataFrame, k: int, rounds: int = 20) -> DataFrame:
    """id, cluster from power iteration on the graph."""
    from pyspark.ml.clustering import PowerIterationClustering

    return PowerIterationClustering(k=k, maxIter=rounds, srcCol="src", dstCol="dst").assignClusters(e.select("src", "dst")).select("id", "cluster")


def lineage_products(scores: DataFrame, lineage: DataFrame, levels: list[str]) -> DataFrame:
    """The lineage table (one column a level, youngest first) with score: product of the expansion from each level to the next.

    scores: level (the older level's name), parent, ratio.  A step without a score gives null.
    """
    out = lineage
    total = F.lit(1.0)
    for i, level in enumerate(levels[1:]):
        s = scores.where(F.col("level") == level).select(F.col("parent").alias(level), F.col("ratio").alias(f"__{i}"))
        out = out.join(s, level, "left")
        total = total * F.col(f"__{i}")
    return out.withColumn("score", total).drop(*[f"__{i}" for i in range(len(levels) - 1)])


def expansion(numbers: DataFrame, lineage: DataFrame, child: str, parent: str) -> DataFrame:
    """parent, ratio: the daughters' summed number over the parent's.  numbers: state, n."""
    d = lineage.select(child, parent).distinct().join(numbers.select(F.col("state").alias(child), "n"), child).groupBy(parent).agg(F.sum("n").alias("s"))
    return d.join(numbers.select(F.col("state").alias(parent), F.col("n").alias("p")), parent).select(F.col(parent).alias("parent"), (F.col("s") / F.col("p")).alias("ratio"))
