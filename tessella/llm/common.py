"""Helpers shared by the corpus operators: shared-folder tables, word hashing over Arrow buffers, components.

Hashing works on the bytes of many texts at once: a chunk of a few MB of text
is turned into word boundaries and 64-bit word hashes with a handful of numpy
passes, so no operator loops over words in Python.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
MIX1, MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
BASE = U(0x9E3779B97F4A7C15)

#: Bytes of text hashed in one pass; a longer text is a pass of its own.
CHUNK_BYTES = 2_000_000


# ---------------------------------------------------------------- tables


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; without one, a folder of our own if all of Spark runs in this process, else an error."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives the loss of an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a table made by materialize() that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/tessella-" in f:
            p = jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of one Arrow batch on its way to a Python worker: rows with long texts come in small batches.
BATCH_BYTES = 8_000_000


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by size too; a smaller bound that the session has stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, str(2**31 - 2)).rstrip("bB") or 0) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: 64-bit words of a bit filter: at most so many rows (some 8 MB) are broadcast, however many keys there are.
FILTER_WORDS = 1 << 18


def flag_match(df: DataFrame, key: str, keys: DataFrame, flag: str) -> DataFrame:
    """df with a boolean column: whether its hash column key may occur in the single column of keys.

    A bit filter of fixed size, made and applied by Spark, so that a join
    with few keys doesn't shuffle the rows that can't match.  With very many
    keys it lets more rows pass; the join that follows decides.
    """
    h = F.col(keys.columns[0])
    place = lambda c: F.shiftrightunsigned(c, 64 - 18)
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), c.bitwiseAND(63).cast("int"))
    bits = keys.select(place(h).alias("__w"), bit(h).alias("__b")).groupBy("__w").agg(F.bit_or("__b").alias("__b"))
    hit = F.coalesce(F.col("__b").bitwiseAND(bit(F.col(key))) != 0, F.lit(False))
    return df.join(F.broadcast(bits), place(F.col(key)) == F.col("__w"), "left").withColumn(flag, hit).drop("__w", "__b")


def might_match(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of df whose hash column key may occur in the single column of keys, see flag_match()."""
    return flag_match(df, key, keys, "__might").where("__might").drop("__might")


# ---------------------------------------------------------------- expressions

#: Items of an array that are folded together: a fold that gathers an array copies it at each step.
PART = 128


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(items: Column, value: Callable[[Column], Column], combine: Callable[[Column, Column], Column], zero: int) -> Column:
    """Parts of PART structs (before, x) in order: each item x, and what combine() makes of the ints that the items before it have.

    Parts are folded by themselves, then their totals, so that the time is
    all but linear.  combine() is associative with zero as its neutral.
    """

    def fold(array, of):
        start = F.struct(F.lit(zero).alias("all"), F.array().cast("array<int>").alias("before"))
        return F.aggregate(array, start, lambda acc, x: F.struct(combine(acc["all"], of(x)).alias("all"), F.concat(acc["before"], F.array(acc["all"])).alias("before")))

    def parts(a):
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / PART).cast("int")), lambda i: F.slice(a, i * PART + 1, F.lit(PART)))
        return F.when(F.size(a) > 0, F.transform(cut, lambda c: F.struct(c.alias("items"), fold(c, value).alias("run"))))

    def rebased(ps):
        one = lambda base, p: F.transform(F.arrays_zip(p["items"].alias("x"), p["run"]["before"].alias("b")), lambda y: F.struct(combine(base, y["b"]).alias("before"), y["x"].alias("x")))
        return let(fold(ps, lambda p: p["run"]["all"])["before"], lambda bases: F.transform(ps, lambda p, i: one(F.get(bases, i), p)))

    return let(let(items, parts), rebased)


# ---------------------------------------------------------------- bytes to words


def space_lut() -> np.ndarray:
    """Byte classes for words [^\\x20\\x09-\\x0D]+ with A-Z lowered: 0 separates, else the byte."""
    lut = np.arange(256, dtype=np.uint8)
    lut[[9, 10, 11, 12, 13, 32]] = 0
    lut[65:91] += 32
    lut[0] = 255  # NUL is an ordinary byte of a word; 0xFF never occurs in UTF-8
    return lut


def space_lut_cased() -> np.ndarray:
    """As space_lut() but case is kept."""
    lut = space_lut()
    lut[65:91] = np.arange(65, 91)
    return lut


def alnum_lut() -> np.ndarray:
    """Byte classes for words of ASCII letters and digits (A-Z lowered) and all bytes above 0x7F."""
    lut = np.zeros(256, dtype=np.uint8)
    lut[48:58] = np.arange(48, 58)
    lut[97:123] = np.arange(97, 123)
    lut[65:91] = np.arange(97, 123)
    lut[128:] = np.arange(128, 256)
    return lut


_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U) | U(1)
_POW = [np.cumprod(np.full(256, 0x2545F4914F6CDD1D, dtype=U), dtype=U)]


def _powers(n: int) -> np.ndarray:
    if len(_POW[0]) < n:
        _POW[0] = np.cumprod(np.full(2 * n, 0x2545F4914F6CDD1D, dtype=U), dtype=U)
    return _POW[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    h = h ^ (h >> U(30))
    h = h * MIX1
    h ^= h >> U(27)
    h = h * MIX2
    h ^= h >> U(31)
    return h


class Words:
    """Words of a chunk of texts: hash and byte range of each, and the slice of words of each text."""

    __slots__ = ("hash", "start", "end", "first", "buf", "base")

    def __init__(self, texts: list[bytes], lut: np.ndarray):
        total = sum(map(len, texts)) + len(texts) + 1
        buf = np.full(total, 32, dtype=np.uint8)
        base = np.empty(len(texts) + 1, dtype=np.int64)
        at = 1
        for i, t in enumerate(texts):
            base[i] = at
            buf[at : at + len(t)] = np.frombuffer(t, dtype=np.uint8)
            at += len(t) + 1
        base[-1] = at
        cls = lut[buf]
        # the byte between two texts separates whatever the table says of a space
        cls[0] = 0
        cls[base[1:] - 1] = 0
        word = cls != 0
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        self.buf, self.base = buf, base
        lens = self.end - self.start
        if len(lens):
            body = cls[word]
            off = np.cumsum(lens) - lens
            pos = np.arange(len(body)) - np.repeat(off, lens)
            h = np.add.reduceat(BYTE_CODE[body] * _powers(int(lens.max()) + 1)[pos], off)
            self.hash = mix(h + U(7) * lens.astype(U))
        else:
            self.hash = np.empty(0, dtype=U)
        self.first = np.searchsorted(self.start, base)

    def chars(self) -> np.ndarray:
        """Code points before each byte of the buffer (and one more entry): turns byte into code point offsets."""
        lead = (self.buf & 0xC0) != 0x80
        out = np.empty(len(lead) + 1, dtype=np.int64)
        out[0] = 0
        np.cumsum(lead, out=out[1:])
        return out


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive words; fewer words than n: one hash of the whole sequence, or none."""
    if len(h) < n:
        n = len(h)
        if not n:
            return h
    out = h[: len(h) - n + 1] * U(2 * n + 1)
    for k in range(1, n):
        out = out + h[k : len(h) - n + 1 + k] * U((int(BASE) * (2 * k + 1) ** 7 | 1) % 2**64)
    return mix(out)


def chunks(col: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Row number of the first text and the UTF-8 bytes of some texts; null is empty."""
    part: list[bytes] = []
    size, first = 0, 0
    col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else pa.binary())
    for i in range(len(col)):
        t = col[i].as_py() or b""
        if part and size + len(t) > limit:
            yield first, part
            part, size, first = [], 0, i
        part.append(t)
        size += len(t)
    if part:
        yield first, part


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph by alternating large-star and small-star rounds.

    edges: columns u, v (bigint, both not null; self loops and repeats allowed).
    Returns node, root with root the smallest node id of the component, one row
    for each node of a proper edge.  Each round pre-aggregates the smallest
    neighbour of a node on the map side, so a hub costs one row a task there,
    and its edges meet it in an ordinary join that Spark can split.  Each round
    is written to the shared folder.  No edges: no rows.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialize(e, name)
    seen = None
    for _ in range(max_rounds):
        # large star: larger neighbours of u go to the smallest of u and its neighbours
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours of u, and u, go to the smallest of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        nxt = materialize(small, name)
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(e)
        e = nxt
        if state == seen or not state[0]:
            break
        seen = state
    else:
        raise RuntimeError("components() did not settle")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root")))
