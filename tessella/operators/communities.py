"""Graph clustering by modularity, in synchronous rounds, and weights of neighbour graphs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .settle import settle


def connectivities(neighbours: DataFrame, steps: int = 64) -> DataFrame:
    """src, dst, weight of the fuzzy neighbour graph, both directions of an edge alike.

    neighbours: src, dst, dist, a bounded list for each src.  The nearest
    neighbour (of those at a distance) has membership 1; a bandwidth for each
    src, found by bisection, makes the memberships sum to log2 of the number
    of neighbours; a and b of the two directions become a + b - a b.
    """
    # the distances of a src are one bounded array
    g = neighbours.where("src <> dst").groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dist", "dst"))).alias("n"))
    d = F.transform("n", lambda x: x["dist"])
    g = g.withColumn("near", F.coalesce(F.array_min(F.filter(d, lambda x: x > 0)), F.lit(0.0)))
    g = g.withColumn("off", F.transform("n", lambda x: F.greatest(x["dist"] - F.col("near"), F.lit(0.0)))).withColumn("target", F.log2(F.size("n")))
    total = lambda s: F.aggregate("off", F.lit(0.0), lambda acc, x: acc + F.exp(-x / s))
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(math.inf).alias("hi"), F.lit(1.0).alias("s"))

    def halve(acc, _):
        large = total(acc["s"]) > F.col("target")
        lo, hi = F.when(large, acc["lo"]).otherwise(acc["s"]), F.when(large, acc["s"]).otherwise(acc["hi"])
        return F.struct(lo.alias("lo"), hi.alias("hi"), F.when(hi == math.inf, lo * 2).otherwise((lo + hi) / 2).alias("s"))

    g = g.withColumn("s", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda acc: acc["s"]))
    # a bandwidth below a thousandth of the mean distance stays there
    mean = F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x) / F.size("n")
    g = g.withColumn("s", F.greatest("s", mean / 1000, F.lit(1e-12)))
    a = g.select("src", "s", F.explode(F.arrays_zip(F.transform("n", lambda x: x["dst"]).alias("dst"), F.col("off").alias("off"))).alias("x")).select("src", F.col("x.dst").alias("dst"), F.exp(-F.col("x.off") / F.col("s")).alias("a"))
    both = a.union(a.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "a"))
    two = both.groupBy("src", "dst").agg(F.sum("a").alias("s"), F.product("a").alias("p"), F.count("*").alias("n"))
    return two.select("src", "dst", F.when(F.col("n") > 1, F.col("s") - F.col("p")).otherwise(F.col("s")).alias("weight"))


def weighted_modularity(edges: DataFrame, clusters: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of a clustering (id, cluster) of a graph (src, dst, weight: both directions of each edge; loops once, with twice their weight)."""
    c = clusters.select("id", "cluster")
    x = edges.join(c.select(F.col("id").alias("src"), F.col("cluster").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("cluster").alias("b")), "dst")
    per = x.groupBy("a").agg(F.sum("weight").alias("k"), F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("inside"))
    whole, inside, square = per.agg(F.sum("k"), F.sum("inside"), F.sum(F.col("k") * F.col("k"))).first()
    return 0.0 if not whole else inside / whole - resolution * square / whole**2


def _summed(i: np.ndarray, c: np.ndarray, t: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each pair of a node and a cluster once, in order, with its weights summed."""
    if not len(i):
        return i, c, t, w
    low, least = int(i.min()), int(c.min())
    wide = int(c.max()) - least + 1
    # one number for both where it fits
    order = np.argsort((i - low) * wide + (c - least), kind="stable") if (int(i.max()) - low + 1) * wide < 1 << 63 else np.lexsort((c, i))
    i, c = i[order], c[order]
    start = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (c[1:] != c[:-1])]))
    return i[start], c[start], t[order[start]], np.add.reduceat(w[order], start)


#: Edges that lie in a block on average, and parts that nodes are dealt to for each task.
BLOCK, FINER = 1 << 18, 4


def _flat(batch: pa.RecordBatch, names: tuple[str, ...]) -> list[np.ndarray]:
    return [batch.column(x).flatten().to_numpy(zero_copy_only=False) for x in names]


def _lists(at: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (p, q, src, dst, weight) as rows of arrays, of one p each, in order of q."""
    held, rows, names = [], 0, ("p", "q", "src", "dst", "weight")

    def block():
        p, q, src, dst, w = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((q, p))
        p = p[order]
        at = np.append(np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])), len(p))
        return pa.record_batch([pa.array(p[at[:-1]]), *(_lists(at, x[order], t) for x, t in ((q, pa.int32()), (src, kind), (dst, kind), (w, pa.float64())))], names=list(names))

    for b in batches:
        kind = b.schema.field("src").type
        held.append([b.column(x).to_numpy(zero_copy_only=False) for x in names])
        rows += b.num_rows
        if rows >= BLOCK:
            yield block()
            held, rows = [], 0
    if rows:
        yield block()


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of edges, each with the nodes (id, c, t) of its p, as what their src hears, a row a q: the cluster of dst and its weight."""
    for b in batches:
        kind = b.schema.field("src").type.value_type
        for r in range(b.num_rows):
            one = b.slice(r, 1)
            q, src, dst, w, n, c, t = _flat(one, ("q", "src", "dst", "weight", "id", "c", "t"))
            order = np.argsort(n, kind="stable")
            x = order[np.searchsorted(n[order], dst)]
            at = np.append(np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])), len(q))
            cols = [_lists(at, v, k) for v, k in ((src, kind), (c[x], kind), (t[x], pa.float64()), (w, pa.float64()))]
            yield pa.record_batch([pa.array(q[at[:-1]]), *cols, pa.array(np.zeros(len(at) - 1, bool))], names=["q", "id", "c", "t", "w", "own"])


def _met(batches: Iterator[pa.RecordBatch]) -> tuple | None:
    """What lies in a part: nodes in order (id, cluster, its weight, their own), their edges (place of the node, cluster, its weight, the edge's) summed by cluster and in order, and how clusters are written."""
    most, nodes, held, rows = 1 << 21, [], [], 0
    for b in batches:
        kind = b.schema.field("id").type.value_type
        own = b.column("own")
        for mine, to in ((own, nodes), (pc.invert(own), held)):
            part = b.filter(mine)
            if part.num_rows:
                to.append(_flat(part, ("id", "c", "t", "w")))
                rows += len(to[-1][0]) if to is held else 0
        if rows > most and held[0][0].dtype != object:
            held = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
            rows = len(held[0][0])
            most = max(most, 2 * rows)
    if not nodes:
        return None
    n, cluster, tot, k = map(np.concatenate, zip(*nodes, strict=True))
    i, c, t, w = map(np.concatenate, zip(*held, strict=True)) if held else (n[:0], n[:0], k[:0], k[:0])
    names = None
    if n.dtype == object:
        # ids that aren't numbers go by their rank
        names, rank = np.unique(np.concatenate([n, cluster, i, c]), return_inverse=True)
        n, cluster, i, c = np.split(rank, np.cumsum([len(n), len(n), len(i)]))
    i, c, t, w = _summed(i, c, t, w)
    order = np.argsort(n, kind="stable")
    n, cluster, tot, k = n[order], cluster[order], tot[order], k[order]
    return n, cluster, tot, k, np.searchsorted(n, i), c, t, w, lambda x: pa.array(x if names is None else names[x], kind)


def _choose(batches: Iterator[pa.RecordBatch], total: float, resolution: float) -> Iterator[pa.RecordBatch]:
    """A row a node of a part: where it lies, the cluster that is worth the most to it, the worth of this and of staying, and its weight inside."""
    met = _met(batches)
    if met is None:
        return
    n, cluster, tot, k, at, c, t, w, named = met
    mine = c == cluster[at]
    # what joining c is worth to a node outside of it, and what staying is worth
    worth = w - resolution * k[at] * (t - np.where(mine, k[at], 0.0)) / total
    # a node without a neighbour in its own cluster gains nothing by staying but the others' weight
    stay, inside = -resolution * k * (tot - k) / total, np.zeros(len(n))
    stay[at[mine]], inside[at[mine]] = worth[mine], w[mine]
    nxt, gain = cluster.copy(), stay.copy()
    if len(at):
        start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        even = np.round(worth, 9)
        top = np.flatnonzero(even == np.repeat(np.maximum.reduceat(even, start), np.diff(np.append(start, len(at)))))
        # clusters are in order, so the first of the best is the smallest
        first = top[np.concatenate([[True], at[top[1:]] != at[top[:-1]]])]
        nxt[at[first]], gain[at[first]] = c[first], worth[first]
    yield pa.record_batch([named(n), pa.array(k), named(cluster), pa.array(tot), named(nxt), *map(pa.array, (gain, stay, inside))], names=["id", "k", "cluster", "tot", "next", "gain", "stay", "inside"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights between clusters, of the edges of a part."""
    met = _met(batches)
    if met is None:
        return
    _, cluster, _, _, at, c, t, w, named = met
    s, d, _, w = _summed(cluster[at], c, t, w)
    yield pa.record_batch([named(s), named(d), pa.array(w)], names=["src", "dst", "weight"])


class _Edges:
    """Edges without loops as blocks that lie by dst; a pass sends nodes to them, and what they say on to src: the edges move once, as arrays."""

    def __init__(self, edges: DataFrame):
        self.kind = edges.schema["src"].dataType.simpleString()
        self.parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        x = edges.where("src <> dst").select(self._part("dst").alias("p"), (self._part("src") % self.parts).alias("q"), "src", "dst", "weight")
        rows = f"p int, q array<int>, src array<{self.kind}>, dst array<{self.kind}>, weight array<double>"
        # kept on disk, they stay where they were dealt to
        self.blocks = x.repartition(self.parts, "p").mapInArrow(_blocks, rows).repartition(self.parts, "p").persist(StorageLevel.DISK_ONLY)

    def _part(self, x: str) -> Column:
        return F.pmod(F.hash(x), F.lit(FINER * self.parts))

    def around(self, nodes: DataFrame) -> DataFrame:
        """Nodes (id, cluster, tot, k) and what lies around them, in the same task."""
        s = nodes.groupBy(self._part("id").alias("p")).agg(F.collect_list(F.struct("id", "cluster", "tot", "k")).alias("m"))
        s = s.select("p", "m.id", F.col("m.cluster").alias("c"), F.col("m.tot").alias("t"), F.col("m.k").alias("w"))
        to = self.blocks.join(s.drop("w").hint("shuffle_hash"), "p")
        to = to.mapInArrow(_send, f"q int, id array<{self.kind}>, c array<{self.kind}>, t array<double>, w array<double>, own boolean")
        return to.union(s.select((F.col("p") % self.parts).alias("q"), "id", "c", "t", "w", F.lit(True))).repartition(self.parts, "q")


def _survey(edges: _Edges, now: DataFrame, loops: float, total: float, resolution: float) -> tuple[DataFrame, float]:
    """now (id, k, cluster) with the neighbouring cluster of the largest worth to each node, its worth, and what staying is worth; and the modularity."""
    size = now.groupBy("cluster").agg(F.sum("k").alias("tot"))
    s = settle(now.join(size, "cluster").select("id", "k", "cluster", "tot"))
    best = settle(edges.around(s).mapInArrow(lambda it: _choose(it, total or 1.0, resolution), f"id {edges.kind}, k double, cluster {edges.kind}, tot double, next {edges.kind}, gain double, stay double, inside double"))
    # the squares of all clusters' weights, node by node
    inside, square = best.agg(F.sum("inside"), F.sum(F.col("k") * F.col("tot"))).first()
    return best, (0.0 if not total else (inside + loops) / total - resolution * square / total**2)


def _contracted(edges: _Edges, nodes: DataFrame, named: DataFrame) -> DataFrame:
    """The graph of clusters, from edges, loops of nodes and the cluster of each node (id, next)."""
    s = settle(nodes.join(named, "id").select("id", F.col("next").alias("cluster"), F.lit(0.0).alias("tot"), "k", "loop"))
    across = edges.around(s).mapInArrow(_merge, f"src {edges.kind}, dst {edges.kind}, weight double")
    own = s.where("loop <> 0").select(F.col("cluster").alias("src"), F.col("cluster").alias("dst"), F.col("loop").alias("weight"))
    return settle(across.union(own).groupBy("src", "dst").agg(F.sum("weight").alias("weight")))


def _local_moves(edges: _Edges, nodes: DataFrame, total: float, resolution: float, rounds: int, seed: int, log: list) -> tuple[DataFrame, float]:
    """id, cluster after nodes have moved to the neighbouring cluster of the largest gain, as long as modularity rises.

    nodes: id, k, loop.  One pass over the edges a round tells whether the
    round is taken and what comes next.
    """
    loops = nodes.agg(F.sum("loop")).first()[0] or 0.0
    now, q = _survey(edges, nodes.select("id", "k", F.col("id").alias("cluster")), loops, total, resolution)
    share, turn = 2, 0
    wish = (F.col("next") != F.col("cluster")) & (F.col("gain") > F.col("stay") + 1e-9)
    while turn < rounds:
        turn += 1
        chosen = wish & (F.pmod(F.xxhash64("id", F.lit(seed + turn)), F.lit(share)) == 0)
        moving, willing = now.agg(F.count_if(chosen), F.count_if(wish)).first()
        if not moving:
            if not willing:
                break
            continue
        nxt, new = _survey(edges, now.select("id", "k", F.when(chosen, F.col("next")).otherwise(F.col("cluster")).alias("cluster")), loops, total, resolution)
        if new > q + 1e-12:
            now, q = nxt, new
            share = max(2, share // 2)
        elif share >= 64:
            break
        else:
            # too many moved at once: fewer of them
            share *= 2
    log.append(q)
    return now.select("id", "cluster"), q


def modularity_clusters(edges: DataFrame, resolution: float = 1.0, rounds: int = 8, levels: int = 5, seed: int = 0, log: list | None = None) -> DataFrame:
    """id, cluster (smallest id of it) by modularity.  edges: src, dst, and weight or 1 each, every undirected edge once or in both directions alike.

    Nodes move at once, but only a part that a hash picks in each round, and a
    round that doesn't raise modularity isn't taken; then clusters become the
    nodes of a smaller graph.  Ties go to the smaller cluster.  log receives
    the modularity of each level, which never falls.  Nodes without edges are
    not part of the graph; loops are left out.
    """
    log = [] if log is None else log
    w = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    one = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max(w.cast("double")).alias("weight"))
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    e = settle(one).select(both.alias("e"), F.coalesce("weight", F.lit(0.0)).alias("weight")).select("e.src", "e.dst", "weight")
    total, place, best = None, None, -1.0
    for level in range(levels):
        loop = F.when(F.col("src") == F.col("dst"), F.col("weight")).otherwise(0.0)
        nodes = settle(e.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k"), F.sum(loop).alias("loop")))
        if place is None:
            total = nodes.agg(F.sum("k")).first()[0] or 0.0
            place = nodes.select("id", F.col("id").alias("cluster"))
        around = _Edges(e)
        try:
            moved, q = _local_moves(around, nodes, total, resolution, rounds, seed + 1000 * level, log)
            if q <= best + 1e-9:
                log.pop()
                break
            best = q
            low = moved.groupBy("cluster").agg(F.min("id").alias("low"))
            named = settle(moved.join(low, "cluster").select("id", F.col("low").alias("next")))
            place = settle(place.join(named.withColumnRenamed("id", "cluster"), "cluster").select("id", F.col("next").alias("cluster")))
            if level < levels - 1:
                e = _contracted(around, nodes, named)
        finally:
            around.blocks.unpersist()
    return place
