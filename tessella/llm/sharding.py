"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

The tree has regions, racks in them and shards in those.  A row descends it:
at each level every child draws -ln(u)/weight, with u a hash of the row's key
and the child's name, and the smallest draw wins.  A node weighs what its
shards weigh together.  If the weight of a child grows, rows only move into
it; if it falls, only out of it; subtrees whose weights stay keep their rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that the rows of a shard are numbered in: bounds the rows one task sorts.
SLOT_PARTS = 512


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def fleet(n: int, base: int = 24, racks: int = 2, per_rack: int = 4) -> list[Shard]:
    """The first base shards in regions of racks x per_rack; each further shard is a region of its own.

    So a fleet of n + 1 shards differs from one of n, for n >= base, by a new
    subtree at the top, and rows move into that one only.
    """
    return [Shard(i // (racks * per_rack), i // per_rack, i) for i in range(min(n, base))] + [Shard(1_000_000 + i, 1_000_000 + i, i) for i in range(base, n)]


def _winner(key: Column, children: list[tuple[int, float]], level: int) -> Column:
    """The child with the smallest draw; ties go to the smaller number."""
    draws = []
    for child, weight in children:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(child)), 11).cast("double") + 0.5) / F.lit(float(2**53))
        draws.append(F.struct((-F.log(u) / F.lit(weight)).alias("draw"), F.lit(child).alias("child")))
    return (F.least(*draws) if len(draws) > 1 else draws[0])["child"]


def descend(df: DataFrame, key: str, tree: list[Shard], name: str) -> DataFrame:
    """Adds column name: the shard that the tree gives to the key (a null key is one key)."""
    live = [s for s in tree if s.weight > 0]
    if not live:
        raise ValueError("a tree needs a shard with a weight above 0")

    def level(nodes: list[Shard], child) -> list[tuple[int, float]]:
        total: dict[int, float] = {}
        for s in nodes:
            total[child(s)] = total.get(child(s), 0.0) + s.weight
        return sorted(total.items())

    def pick(column: str, groups: dict[int, list[tuple[int, float]]], depth: int) -> Column:
        out = None
        for parent, children in groups.items():
            hit = _winner(F.col(key), children, depth)
            out = F.when(F.col(column) == parent, hit) if out is None else out.when(F.col(column) == parent, hit)
        return out

    regions = level(live, lambda s: s.region)
    racks = {r: level([s for s in live if s.region == r], lambda s: s.rack) for r, _ in regions}
    shards = {k: level([s for s in live if s.rack == k], lambda s: s.shard) for rs in racks.values() for k, _ in rs}
    df = df.withColumn("__region", _winner(F.col(key), regions, 0))
    df = df.withColumn("__rack", pick("__region", racks, 1))
    return df.withColumn(name, pick("__rack", shards, 2)).drop("__region", "__rack")


def number_slots(df: DataFrame, shard: str, order: list[str], name: str = "slot") -> DataFrame:
    """Adds name: gapless numbers from 0 within each shard.

    Rows of a shard are dealt over SLOT_PARTS parts by the hash of the order
    columns and numbered in each; parts follow each other.  No task sees a
    whole shard.
    """
    df = df.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(SLOT_PARTS)).cast("int"))
    counts = df.groupBy(shard, "__part").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy(shard).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).select(F.col(shard).alias("__shard"), F.col("__part").alias("__p"), F.coalesce("__before", F.lit(0)).alias("__before"))
    own = df.withColumn("__row", F.row_number().over(Window.partitionBy(shard, "__part").orderBy(*order)))
    # at most shards x SLOT_PARTS rows
    joined = own.join(F.broadcast(before), (own[shard] == F.col("__shard")) & (own["__part"] == F.col("__p")))
    return joined.withColumn(name, (F.col("__row") - 1 + F.col("__before")).cast("bigint")).drop("__part", "__p", "__shard", "__row", "__before")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Puts documents into shards by the hash tree: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    law is key: doc_id and the number of shards decide, and with one more
    shard rows move only into it (grown_shard).  size is the UTF-8 bytes of
    the text plus 8; null text counts as no bytes.  Equal doc_ids, null ones
    too, share a shard; repeated rows get slots of their own.  An empty table
    gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = descend(rows, "doc_id", fleet(shards), "shard")
    rows = descend(rows, "doc_id", fleet(shards + 1), "grown_shard")
    rows = number_slots(rows, "shard", ["doc_id", "size", "text_crc32"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
