"""Web archive records and Merkle fixity audit.

Pages become WARC records that lie one behind the other in archive files.
Records are hashed, records that begin in the same range of offsets are hashed
together, and ranges are hashed up to one root a file.  An audit compares the
roots of two replicas, each with its own records at its own offsets, and
descends only the branches that differ, level by level, until it has the
damaged, moved, missing and additional records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of one archive file, of one range of offsets, and ranges hashed into one node above.
FILE_BYTES, RANGE_BYTES, FANOUT = 67_108_864, 65_536, 16


def records(pages: DataFrame) -> DataFrame:
    """page_id, url, record: the bytes of a WARC response record of each page.

    Null url or html count as empty.  Repeated rows give equal records.
    """
    html = F.coalesce("html", F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(html).cast("string"), F.lit("\r\n\r\n"),
    )
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.concat(head, html, F.lit("\r\n\r\n")).alias("record"))


def manifest(recs: DataFrame) -> DataFrame:
    """page_id, url, file, offset, length, sha256 of each record, in order of page_id within a file.

    Files hold about FILE_BYTES; the digest of a record names its file, so
    files fill evenly whatever the page_ids are.  Repeated rows follow each
    other in one file.
    """
    m = recs.select("page_id", "url", F.octet_length("record").cast("bigint").alias("length"), F.sha2(F.col("record").cast("binary"), 256).alias("sha256"))
    m = common.materialize(m, "warc-records")
    files = -(-(m.agg(F.sum("length")).first()[0] or 0) // FILE_BYTES) or 1
    m = m.withColumn("file", _file("sha256", files))
    w = Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), "sha256", "url").rowsBetween(Window.unboundedPreceding, -1)
    return m.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)))


def _file(digest: str, files: int) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.lit(files)


def tree(leaves: DataFrame, levels: int) -> DataFrame:
    """level, file, node, hash of a Merkle tree.  leaves: file, offset, sha256 (null: the record is missing).

    Level 1 has the ranges of offsets, each level above has FANOUT nodes of
    the one below; the last has one root a file.
    """
    leaf = F.concat_ws("=", F.col("offset").cast("string"), F.coalesce("sha256", F.lit("missing")))
    now = leaves.groupBy("file", F.floor(F.col("offset") / RANGE_BYTES).alias("node")).agg(F.array_sort(F.collect_list(F.struct("offset", leaf.alias("h")))).alias("hs"))
    now = now.select(F.lit(1).alias("level"), "file", "node", F.sha2(F.array_join("hs.h", ","), 256).alias("hash"))
    out = now
    for k in range(2, levels + 1):
        up = now.groupBy("file", F.floor(F.col("node") / FANOUT).alias("up")).agg(F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("hs"))
        now = up.select(F.lit(k).alias("level"), "file", F.col("up").alias("node"), F.sha2(F.array_join("hs.hash", ","), 256).alias("hash"))
        out = out.union(now)
    return out


def levels_for(leaves: DataFrame) -> int:
    top = (leaves.agg(F.max("offset")).first()[0] or 0) // RANGE_BYTES
    k = 1
    while top:
        top //= FANOUT
        k += 1
    return k


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Status of every record of ours in a replica, and the records that only the replica has.

    Both: page_id, file, offset, length, sha256, each with the offsets of its
    own bytes, unique in a file.  Returns these columns and status: ok (same
    bytes at the same offset), moved (same bytes elsewhere in the file),
    corrupt (other bytes under the page_id), missing, extra (a row of theirs
    that none of ours answers to).  Equal records are matched in the order of
    offsets.  Only nodes below a differing node are compared, and only records
    in differing ranges; all others are ok because their range is.  A null
    page_id is a page_id of its own; empty tables are allowed.
    """
    n = max(levels_for(ours), levels_for(theirs))
    a, b = common.materialize(tree(ours, n), "warc-ours"), common.materialize(tree(theirs, n), "warc-theirs")
    bad = None
    for k in range(n, 0, -1):
        x, y = a.where(F.col("level") == k), b.where(F.col("level") == k).select("file", "node", F.col("hash").alias("other"))
        if bad is not None:
            up = bad.select("file", F.col("node").alias("up"))
            x, y = (t.withColumn("up", F.floor(F.col("node") / FANOUT)).join(up, ["file", "up"], "left_semi") for t in (x, y))
        bad = x.join(y, ["file", "node"], "full").where(~F.col("hash").eqNullSafe(F.col("other"))).select("file", "node")
    bad = common.materialize(bad, "warc-bad")
    cols = ["page_id", "file", "offset", "length", "sha256"]
    near = lambda t: t.withColumn("node", F.floor(F.col("offset") / RANGE_BYTES)).join(bad, ["file", "node"], "left_semi").select(cols)
    at = ["file", "offset", "sha256"]
    x, y = near(ours), near(theirs)
    x, y = x.join(y.select(at), at, "left_anti"), y.join(x.select(at), at, "left_anti")
    x, y = common.materialize(x, "warc-left"), common.materialize(y, "warc-right")
    nth = lambda t, *by: t.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("offset")))
    same = nth(x, "file", "sha256").join(nth(y, "file", "sha256").select("file", "sha256", "k", F.col("offset").alias("there")), ["file", "sha256", "k"]).select("file", "offset", "there")
    same = common.materialize(same, "warc-moved")
    x1 = nth(x.join(same.select("file", "offset"), ["file", "offset"], "left_anti"), "file", "page_id").alias("x")
    y1 = nth(y.join(same.select("file", F.col("there").alias("offset")), ["file", "offset"], "left_anti"), "file", "page_id").alias("y")
    both = x1.join(y1, (F.col("x.file") == F.col("y.file")) & F.col("x.page_id").eqNullSafe(F.col("y.page_id")) & (F.col("x.k") == F.col("y.k")), "full")
    both = common.materialize(both.select(*(F.col(f"{t}.{c}").alias(f"{t}_{c}") for t in "xy" for c in cols)), "warc-rest")
    found = same.select("file", "offset", F.lit("moved").alias("found"))
    found = found.union(both.where("x_file is not null").select("x_file", "x_offset", F.when(F.col("y_file").isNull(), "missing").otherwise("corrupt")))
    extra = both.where("x_file is null").select(*(F.col(f"y_{c}").alias(c) for c in cols), F.lit("extra").alias("status"))
    return ours.join(found, ["file", "offset"], "left").select(*cols, F.coalesce("found", F.lit("ok")).alias("status")).union(extra)


def write_archive(recs: DataFrame, files: DataFrame, path: str) -> None:
    """Writes uncompressed WARC files, one folder for each file number, records in order of offset.

    files: the manifest; each of its rows, also of null page_ids and repeats, is written once at its offset.
    A record ends with an empty line, which is the line separator of the text sink.
    """
    # repeated rows have the same bytes: one of them serves every place that the manifest gives them
    once = recs.select(F.col("page_id").alias("id"), F.sha2(F.col("record").cast("binary"), 256).alias("now"), "record").dropDuplicates(["id", "now"])
    lines = files.join(once, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("sha256") == F.col("now")))
    body = F.expr("substring(record, 1, length(record) - 4)")
    lines.select(body.alias("value"), "file", "offset").repartition("file").sortWithinPartitions("file", "offset").drop("offset").write.partitionBy("file").option("lineSep", "\r\n\r\n").text(path)


def drill(recs: DataFrame, files: int) -> DataFrame:
    """page_id, file, offset, length, sha256 of a damaged replica: a copy whose damage the digest of page_id decides.

    md5 of page_id beginning with 00: the first byte has changed; 01: the
    place is there but no record; 020 or 021: a byte is inserted behind, so
    what follows moves; 022 or 023: a record that the original lacks stands
    behind it.  Null page_ids stay whole.  Offsets are those of the replica's
    own bytes.
    """
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    tag = F.coalesce(F.md5(F.col("page_id").cast("string").cast("binary")), F.lit("ff"))
    record = F.col("record")
    now = F.when(tag.startswith("00"), F.concat(F.lit("X"), F.expr("substring(record, 2)"))).when(tag.startswith("020") | tag.startswith("021"), F.concat(record, F.lit("X"))).otherwise(record)
    own = F.struct(F.col("page_id").alias("page_id"), F.octet_length(now).alias("length"), digest(now).alias("sha256"), F.lit(0).alias("more"))
    other = F.concat(F.lit("E"), record)
    more = F.struct((-F.col("page_id") - 1).alias("page_id"), F.octet_length(other).alias("length"), digest(other).alias("sha256"), F.lit(1).alias("more"))
    rows = recs.select(F.col("page_id").alias("was"), "url", digest(record).alias("before"), tag.startswith("01").alias("gone"), F.explode(F.when(tag.startswith("022") | tag.startswith("023"), F.array(own, more)).otherwise(F.array(own))).alias("r"))
    rows = rows.select("was", "url", "before", "gone", "r.page_id", F.col("r.length").cast("bigint").alias("length"), "r.sha256", "r.more").withColumn("file", _file("before", files))
    w = Window.partitionBy("file").orderBy(F.col("was").asc_nulls_first(), "before", "url", "more").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0))).where("not gone").select("page_id", "file", "offset", "length", "sha256")


def fixity(pages: DataFrame) -> DataFrame:
    """Audit of a drill replica of all pages: page_id, file, offset, length, sha256, status of every record, and of the replica's own.

    Null urls and texts count as empty, a null page_id is never damaged.
    Repeated page_ids are told apart by their place; in the replica a damaged
    page_id is damaged in each of its rows.  Other columns are ignored; an
    empty table gives no rows.
    """
    recs = records(pages)
    ours = common.materialize(manifest(recs), "warc-manifest")
    files = -(-(ours.agg(F.sum("length")).first()[0] or 0) // FILE_BYTES) or 1
    theirs = common.materialize(drill(recs, files), "warc-replica")
    return audit(ours, theirs)


#: The same audit by comparing every record.
FIXITY_SQL = """
WITH r AS (
  SELECT page_id, url, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, 'none') || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))::VARCHAR
    || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages
), m AS (SELECT page_id, url, record, strlen(record) AS length, sha256(record) AS sha256 FROM r),
n AS (SELECT greatest(1, CAST(ceil(sum(length) / 67108864.0) AS BIGINT)) AS files FROM m),
f AS (SELECT m.*, ('0x' || substr(sha256, 1, 8))::BIGINT % files AS file, coalesce(md5(page_id::VARCHAR), 'ff') AS tag FROM m, n),
o AS (SELECT page_id, file, CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id NULLS FIRST, sha256, url ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", length, sha256 FROM f),
c AS (SELECT page_id AS was, page_id, url, sha256 AS before, tag, file, 0 AS more, CASE WHEN tag[1:2] = '00' THEN 'X' || substr(record, 2) WHEN tag[1:3] IN ('020', '021') THEN record || 'X' ELSE record END AS record FROM f
  UNION ALL SELECT page_id, -page_id - 1, url, sha256, tag, file, 1, 'E' || record FROM f WHERE tag[1:3] IN ('022', '023')),
d AS (SELECT *, strlen(record) AS length, sha256(record) AS sha256 FROM c),
e AS (SELECT page_id, file, CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY was NULLS FIRST, before, url, more ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", length, sha256, tag FROM d),
t AS (SELECT * EXCLUDE (tag) FROM e WHERE tag[1:2] <> '01'),
x AS (SELECT *, row_number() OVER (PARTITION BY file, sha256 ORDER BY "offset") AS k FROM o ANTI JOIN t USING (file, "offset", sha256)),
y AS (SELECT *, row_number() OVER (PARTITION BY file, sha256 ORDER BY "offset") AS k FROM t ANTI JOIN o USING (file, "offset", sha256)),
mv AS (SELECT x.file, x."offset", y."offset" AS there FROM x JOIN y USING (file, sha256, k)),
x1 AS (SELECT * EXCLUDE (k), row_number() OVER (PARTITION BY file, page_id ORDER BY "offset") AS k FROM x ANTI JOIN mv USING (file, "offset")),
y1 AS (SELECT * EXCLUDE (k), row_number() OVER (PARTITION BY file, page_id ORDER BY "offset") AS k FROM y ANTI JOIN (SELECT file, there AS "offset" FROM mv) USING (file, "offset")),
co AS (SELECT x1.file, x1."offset", y1."offset" AS there FROM x1 JOIN y1 ON x1.file = y1.file AND x1.page_id IS NOT DISTINCT FROM y1.page_id AND x1.k = y1.k)
SELECT page_id, file, "offset", length, sha256, CASE WHEN (file, "offset") IN (SELECT (file, "offset") FROM mv) THEN 'moved' WHEN (file, "offset") IN (SELECT (file, "offset") FROM co) THEN 'corrupt' WHEN (file, "offset") IN (SELECT (file, "offset") FROM x1) THEN 'missing' ELSE 'ok' END AS status FROM o
UNION ALL SELECT page_id, file, "offset", length, sha256, 'extra' FROM y1 WHERE (file, "offset") NOT IN (SELECT (file, there) FROM co)
"""
