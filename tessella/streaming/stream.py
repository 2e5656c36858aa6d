"""Streaming forms: the same narrow transformations on a stream, with watermarks where state must end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener

#: Keyed state with timers lives in this store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tag_counts(reads: DataFrame, cell: str, tag: str) -> DataFrame:
    """Running reads of each cell and tag (update or complete mode); on a batch the same totals."""
    return reads.groupBy(cell, tag).agg(F.count("*").alias("reads"))


def dedup(reads: DataFrame, keys: list[str], time: str | None = None, late: str = "1 hour") -> DataFrame:
    """First read of each key; with a time column, keys are remembered as long as events may be late."""
    return reads.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if time and reads.isStreaming else reads.dropDuplicates(keys)


def windowed_counts(events: DataFrame, time: str, keys: list[str], size: str, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """start, keys, n in tumbling or sliding windows of event time."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return e.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def session_counts(events: DataFrame, time: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """start, end, key, n of sessions that a gap without events ends."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def progress(reads: DataFrame, name: str = "progress") -> DataFrame:
    """reads with observed totals of rows and outcomes, for batch actions and streaming listeners."""
    return reads.observe(name, F.count("*").alias("reads"), F.sum((F.col("outcome") == "ok").cast("int")).alias("kept"))


class ProgressTotals(StreamingQueryListener):
    """Sums what progress() observes over the batches of all queries; a batch that is run again counts once."""

    def __init__(self, name: str = "progress"):
        self.name, self.batches = name, {}

    def onQueryStarted(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.batches[str(event.progress.id), event.progress.batchId] = (row["reads"] or 0, row["kept"] or 0)

    def onQueryTerminated(self, event):  # noqa: N802
        pass

    def totals(self) -> tuple[int, int]:
        """Reads and kept ones so far."""
        return sum(r for r, _ in self.batches.values()), sum(k for _, k in self.batches.values())


class _Totals(StatefulProcessor):
    """Reads and kept ones of a key: a row when another `every` reads are full, and one when no read came for a while."""

    def __init__(self, names: list[str], every: int, quiet: int | None):
        self.names, self.every, self.quiet = names, every, quiet

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("totals", "reads bigint, kept bigint, due bigint")

    def _row(self, key, reads, kept, final):
        return pd.DataFrame([(*key, reads, kept, final)], columns=[*self.names, "reads", "kept", "final"])

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        reads, kept, due = self.state.get() if self.state.exists() else (0, 0, 0)
        before = reads
        for part in rows:
            reads, kept = reads + int(part["reads"].sum()), kept + int(part["kept"].sum())
        if self.quiet is not None:
            if due:
                self.handle.deleteTimer(due)
            due = timerValues.getCurrentProcessingTimeInMs() + self.quiet
            self.handle.registerTimer(due)
        self.state.update((reads, kept, due))
        if reads // self.every > before // self.every:
            yield self._row(key, reads, kept, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        reads, kept, _ = self.state.get()
        self.state.update((reads, kept, 0))
        yield self._row(key, reads, kept, True)

    def close(self):
        pass


def _partial(keys: list[str]):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b]).group_by(keys).aggregate([("one", "sum"), ("ok", "sum")])
            yield from t.select([*keys, "one_sum", "ok_sum"]).rename_columns([*keys, "reads", "kept"]).combine_chunks().to_batches()

    return sums


def running_totals(reads: DataFrame, keys: list[str], every: int = 1_000_000, quiet: int | None = None) -> DataFrame:
    """keys, reads, kept, final of a stream with a column outcome, in update mode.

    A row with final false comes with the batch in which another `every` reads
    of the keys are full; one with final true when no read of them came for
    `quiet` milliseconds (timers fire with the next batch, so the trigger must
    be one by time: with quiet, availableNow doesn't end); reads that come
    later are added.  A read is kept if its outcome is ok; null keys are a key.
    Rows are summed in Arrow batches before the shuffle, so a hot key sends
    few rows to its state; a stream started again from its checkpoint goes on
    with the totals it had.  The session's state store is STATE_STORE.
    """
    ok = F.coalesce(F.col("outcome") == "ok", F.lit(False)).cast("bigint").alias("ok")
    kinds = ", ".join(f"`{k}` {reads.schema[k].dataType.simpleString()}" for k in keys)
    few = reads.select(*keys, F.lit(1).cast("bigint").alias("one"), ok).mapInArrow(_partial(keys), f"{kinds}, reads bigint, kept bigint")
    out = f"{kinds}, reads bigint, kept bigint, final boolean"
    return few.groupBy(*keys).transformWithStateInPandas(_Totals(keys, every, quiet), out, "Update", "ProcessingTime" if quiet is not None else "None")


def read_stream(spark, path: str, schema: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_to_end(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, writes it below path and reads it back: all rows appended, or the last complete result.

    Each batch has a folder of its own, which a repeated batch overwrites.
    """
    seen: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batches/batch={number}")
        seen.append(number)

    q = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    parts = [f"{path}/batches/batch={n}" for n in (seen[-1:] if mode == "complete" else seen)]
    spark = df.sparkSession
    return spark.read.schema(df.schema).parquet(*parts) if parts else spark.createDataFrame([], df.schema)
