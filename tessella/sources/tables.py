"""Sources and sinks: text matrices, Matrix Market, FASTQ, gene sets, archives, per-key stores."""

from __future__ import annotations

import gzip
import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Layouts of the tables that operators take.
SCHEMAS = {
    "expr": "cell_id string, gene string, count double",
    "obs": "cell_id string, library string, condition string, replicate string, cell_state string",
    "edges": "src bigint, dst bigint, weight double",
    "gene_sets": "set_name string, gene string",
    "programs": "program string, gene string, weight double",
    "reads": "name string, r1 string, r2 string, r3 string, r4 string, q1 string, q2 string, q3 string, q4 string",
}


def missing(value: Column) -> Column:
    """NaN as null, since Spark sorts NaN above all numbers."""
    return F.when(~F.isnan(value), value)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0), value: lines of text files, plain or .gz, in their order.

    Lines are numbered inside their part and parts of a file by their order,
    so no task sees more than a part.
    """
    t = spark.read.text(path).select(F.input_file_name().alias("file"), "value", F.monotonically_increasing_id().alias("__m"))
    t = t.withColumn("__p", F.shiftright("__m", 33))
    n = t.groupBy("file", "__p").agg(F.count("*").alias("n"), F.min("__m").alias("lo"))
    off = n.select("file", "__p", "lo", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    return t.join(F.broadcast(off), ["file", "__p"]).select("file", (F.col("__m") - F.col("lo") + F.col("off")).alias("line"), "value")


def read_names(spark: SparkSession, path: str, sep: str = "\t", column: int = 0, skip: int = 0) -> DataFrame:
    """position, name: a column of names from delimited text."""
    x = numbered_lines(spark, path).where(F.col("line") >= skip)
    return x.select((F.col("line") - skip).alias("position"), F.get(F.split("value", _quoted(sep)), F.lit(column)).alias("name"))


def _quoted(sep: str) -> str:
    return "\\" + sep if sep in "|.*+?()[]{}^$\\" else sep


def unique_names(names: DataFrame) -> DataFrame:
    """Repeated names get __1, __2 ... in order of position."""
    w = Window.partitionBy("name")
    k, n = F.row_number().over(w.orderBy("position")), F.count("*").over(w)
    return names.select("position", F.when(n > 1, F.concat("name", F.lit("__"), k.cast("string"))).otherwise(F.col("name")).alias("name"))


def read_matrix_market(spark: SparkSession, path: str, cells: DataFrame | None = None, genes: DataFrame | None = None) -> DataFrame:
    """row, col, count from .mtx (1-based places), or gene, cell_id, count given names (position from 0, name) of rows and columns."""
    x = numbered_lines(spark, path).where(~F.col("value").startswith("%"))
    first = x.groupBy("file").agg(F.min("line").alias("__f"))
    p = F.split(F.trim("value"), r"\s+")
    x = x.join(F.broadcast(first), "file").where("line > __f").select(F.get(p, F.lit(0)).cast("bigint").alias("row"), F.get(p, F.lit(1)).cast("bigint").alias("col"), F.coalesce(F.get(p, F.lit(2)).cast("double"), F.lit(1.0)).alias("count")).where("count <> 0")
    if cells is None:
        return x
    g, c = genes.select((F.col("position") + 1).alias("row"), F.col("name").alias("gene")), cells.select((F.col("position") + 1).alias("col"), F.col("name").alias("cell_id"))
    return x.join(g, "row").join(c, "col").select("cell_id", "gene", "count")


def read_counts_text(spark: SparkSession, path: str, sep: str = "\t", header: bool = True, transpose: bool = False, rows: DataFrame | None = None, columns: DataFrame | None = None) -> DataFrame:
    """cell_id, gene, count from a labelled wide text matrix: the first line names genes, the first column cells (or the other way round).

    Rows of another width are an error.  rows, columns (name): keep only these.
    """
    x = numbered_lines(spark, path).withColumn("p", F.split("value", _quoted(sep)))
    head = x.where("line = 0").select("file", F.posexplode("p").alias("i", "gene"))
    width = x.where("line > 0").select("file", F.size("p").alias("w")).distinct().groupBy("file").count().where("count > 1").limit(1).count()
    if width:
        raise ValueError("rows of a matrix must have the same number of fields")
    body = x.where("line > 0").select("file", F.get("p", F.lit(0)).alias("cell_id"), F.posexplode("p").alias("i", "v")).where("i > 0").withColumn("count", F.col("v").cast("double")).where("count <> 0")
    e = body.join(F.broadcast(head), ["file", "i"]).select("cell_id", "gene", "count")
    if transpose:
        e = e.select(F.col("gene").alias("cell_id"), F.col("cell_id").alias("gene"), "count")
    if rows is not None:
        e = e.join(rows.select(F.col("name").alias("cell_id")), "cell_id", "left_semi")
    if columns is not None:
        e = e.join(columns.select(F.col("name").alias("gene")), "gene", "left_semi")
    return e.select("cell_id", "gene", "count")


def read_unlabelled_text(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """row, col, count of the numbers of a text matrix whose labels, if any, stand before the first numeric cell."""
    x = numbered_lines(spark, path).withColumn("p", F.split("value", _quoted(sep)))
    num = x.select("file", "line", F.posexplode("p").alias("i", "v")).withColumn("n", F.expr("try_cast(v as double)")).where("n is not null")
    at = num.groupBy("file").agg(F.min(F.struct("line", "i")).alias("a"))
    return num.join(F.broadcast(at), "file").where("line >= a.line and i >= a.i and n <> 0").select((F.col("line") - F.col("a.line")).alias("row"), (F.col("i") - F.col("a.i")).alias("col"), F.col("n").alias("count"))


def read_numpy(spark: SparkSession, path: str) -> DataFrame:
    """row, col, count of .npy matrices or compressed-column .npz files, one task a file."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for raw in pdf["content"]:
                a = np.load(io.BytesIO(raw), allow_pickle=False)
                if isinstance(a, np.ndarray):
                    r, c = np.nonzero(a)
                    v = a[r, c]
                else:
                    ptr, r, v = a["indptr"], a["indices"], a["data"]
                    c = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
                    if bytes(a["format"].item() if hasattr(a["format"], "item") else a["format"]) == b"csr":
                        r, c = c, r
                yield pd.DataFrame({"row": r.astype("int64"), "col": c.astype("int64"), "count": v.astype("float64")})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row bigint, col bigint, count double")


def read_zipped_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line, value of the text members of .zip (or .gz) archives, one task an archive."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                if raw[:2] == b"\x1f\x8b":
                    members = [(name, gzip.decompress(raw))]
                else:
                    z = zipfile.ZipFile(io.BytesIO(raw))
                    members = [(f"{name}/{m}", z.read(m)) for m in z.namelist()]
                for m, data in members:
                    lines = data.decode().splitlines()
                    yield pd.DataFrame({"file": m, "line": np.arange(len(lines)), "value": lines})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, line bigint, value string")


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", library: bool = False) -> DataFrame:
    """Delimited results and metadata with a header; no text but the empty one is read as null.  library: adds the file's name."""
    r = spark.read.option("header", True).option("sep", sep).option("nullValue", "")
    df = r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)
    return df.withColumn("library", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[a-z]+)*$", 1)) if library else df


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """file, record, name, seq, qual of FASTQ files: four lines a record."""
    x = numbered_lines(spark, path).withColumn("record", F.floor(F.col("line") / 4)).withColumn("k", F.col("line") % 4)
    one = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    g = x.groupBy("file", "record").agg(one(0).alias("h"), one(1).alias("seq"), one(3).alias("qual"))
    return g.select("file", "record", F.regexp_extract("h", r"^@(\S+)", 1).alias("name"), "seq", "qual")


def weave(streams: dict[str, DataFrame], strict: bool = True) -> DataFrame:
    """record, name and r<k>, q<k> of parallel FASTQ files joined record by record.

    A record whose names differ stops the job; if not strict it is left out.
    """
    out = None
    for k, df in streams.items():
        d = df.select("record", F.col("name").alias(f"__n{k}"), F.col("seq").alias(f"r{k}"), F.col("qual").alias(f"q{k}"))
        out = d if out is None else out.join(d, "record")
    first, *rest = list(streams)
    for k in rest:
        same = F.col(f"__n{first}").eqNullSafe(F.col(f"__n{k}"))
        if strict:
            what = F.concat(F.lit("names of record "), F.col("record").cast("string"), F.lit(" differ: "), F.coalesce(F.col(f"__n{first}"), F.lit("none")), F.lit(" and "), F.coalesce(F.col(f"__n{k}"), F.lit("none")))
            same = F.when(same, F.lit(True)).otherwise(F.raise_error(what).cast("boolean"))
        out = out.where(same)
    return out.withColumnRenamed(f"__n{first}", "name").drop(*[f"__n{k}" for k in rest])


def header_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """file, cell, umi from FASTQ headers "@CELL:UMI:..."."""
    x = numbered_lines(spark, path).where("line % 4 = 0")
    p = F.split(F.expr("substring(value, 2)"), ":")
    return x.select(F.regexp_extract("file", r"([^/]+?)(?:\.[a-z]+)*$", 1).alias("file"), F.get(p, F.lit(0)).alias("cell"), F.get(p, F.lit(1)).alias("umi"))


def pathway_sets(texts: DataFrame, dropped: list[str] = ()) -> DataFrame:
    """set_name, gene from flat pathway entries (name, text): the lines from GENE up to COMPOUND; entries whose CLASS is dropped go."""
    x = texts.withColumn("cls", F.regexp_extract("text", r"(?m)^CLASS\s+(.*)$", 1)).where(~F.col("cls").isin(list(dropped)) if dropped else F.lit(True))
    block = F.regexp_extract("text", r"(?s)\nGENE\s(.*?)(?:\n[A-Z]|$)", 1)
    lines = F.explode(F.split(block, "\n")).alias("l")
    return x.select(F.col("name").alias("set_name"), lines).select("set_name", F.regexp_extract("l", r"^\s*\S+\s+([^;\s]+)", 1).alias("gene")).where("gene <> ''").distinct()


def long_pairs(wide: DataFrame, key: str, meta: list[str], value: str = "value") -> DataFrame:
    """key, cells, value: the pair columns of a wide result table as rows."""
    cols = [c for c in wide.columns if c != key and c not in meta]
    return wide.unpivot([key], cols, "cells", value)


# ---------------------------------------------------------------- sinks


def write_by(df: DataFrame, path: str, key: str, form: str = "csv") -> None:
    """One folder for each value of the key (result tables by condition, reads by library)."""
    w = df.repartition(key).write.partitionBy(key)
    w.option("header", True).csv(path) if form == "csv" else w.format(form).save(path)


def write_fastq(reads: DataFrame, path: str, library: str = "library") -> None:
    """FASTQ text for each library from name, seq, qual."""
    body = F.concat_ws("\n", F.concat(F.lit("@"), "name"), "seq", F.lit("+"), "qual")
    reads.select(body.alias("value"), library).write.partitionBy(library).text(path)


def write_store(expr: DataFrame, table: str, key: str, buckets: int = 64) -> None:
    """The matrix as a table bucketed and sorted by gene or by cell, so that later joins on it don't shuffle."""
    expr.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").format("parquet").saveAsTable(table)


def write_edges(edges: DataFrame, path: str) -> None:
    edges.select("src", "dst").write.option("sep", ";").csv(path)


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """value: one JSON line for each node and link."""
    n = nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), *nodes.columns)).alias("value"))
    return n.union(edges.select(F.to_json(F.struct(F.lit("link").alias("kind"), F.col("src").alias("source"), F.col("dst").alias("target"))).alias("value")))


def color_tracks(values: DataFrame) -> DataFrame:
    """value: a line "name,v1,v2..." for each track (name, pos, value), three decimals, sorted by name."""
    g = values.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("pos", F.format_string("%.3f", "value").alias("v")))).alias("a"))
    return g.orderBy("name").select(F.concat_ws(",", "name", F.array_join("a.v", ",")).alias("value"))


def allow_list(obs: DataFrame, library: str, barcode: str) -> DataFrame:
    """library, barcode: different barcodes of each library without their -1 suffix."""
    return obs.select(library, F.regexp_replace(barcode, r"-\d+$", "").alias(barcode)).distinct()
