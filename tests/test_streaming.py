"""Keyed streaming state: totals go on from a checkpoint, timers fire, observed metrics are summed."""

import time
from collections import Counter

import pytest

from tessella.streaming import stream


@pytest.fixture
def stateful(spark):
    s = spark.newSession()
    s.conf.set("spark.sql.streaming.stateStore.providerClass", stream.STATE_STORE)
    return s


def reads(s, rows, path):
    s.createDataFrame(rows, "library string, outcome string").repartition(3).write.mode("append").parquet(path)


def test_running_totals_survive_a_restart(stateful, tmp_path):
    src = str(tmp_path / "in")

    def run():
        df = stream.read_stream(stateful, src, "library string, outcome string", 3)
        return stream.run_to_end(stream.running_totals(df, ["library"], 10), str(tmp_path / "out"), "update").collect()

    first = [("a", "ok")] * 130 + [("a", "low")] * 30 + [("b", None)] * 65 + [(None, "ok")] * 10 + [("d", "ok")] * 9
    reads(stateful, first, src)
    got = run()
    assert max((r.reads, r.kept) for r in got if r.library == "a") == (160, 130)
    assert all(r.library != "d" for r in got)
    second = [("b", "ok")] * 45 + [("c", "ok")] * 250
    reads(stateful, second, src)
    again = run()
    assert {r.library for r in again} == {"b", "c"} and min(r.reads for r in again if r.library == "b") >= 70
    n, ok = Counter(x for x, _ in first + second), Counter(x for x, o in first + second if o == "ok")
    last = {}
    for r in sorted(got + again, key=lambda r: r.reads):
        last[r.library] = (r.reads, r.kept, r.final)
    assert last == {k: (n[k], ok[k], False) for k in ("a", "b", "c", None)}


def test_quiet_keys_report(stateful, tmp_path):
    src = str(tmp_path / "in")
    reads(stateful, [("a", "ok")] * 7 + [("a", "low")], src)
    df = stream.read_stream(stateful, src, "library string, outcome string", 3)
    q = stream.running_totals(df, ["library"], 1000, 1).writeStream.format("memory").queryName("quiet").outputMode("update")
    q = q.option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds").start()
    try:
        end = time.time() + 30
        while not (got := stateful.table("quiet").collect()) and time.time() < end:
            time.sleep(0.3)
        assert [tuple(r) for r in got] == [("a", 8, 7, True)]
    finally:
        q.stop()


def test_observed_progress(spark, tmp_path):
    src = str(tmp_path / "in")
    reads(spark, [("a", "ok")] * 30 + [("b", "low")] * 12, src)
    seen = stream.ProgressTotals()
    spark.streams.addListener(seen)
    try:
        df = stream.progress(stream.read_stream(spark, src, "library string, outcome string"))
        assert stream.run_to_end(df, str(tmp_path / "out")).count() == 42
        end = time.time() + 20
        while seen.totals()[0] < 42 and time.time() < end:
            time.sleep(0.2)
        assert seen.totals() == (42, 30)
    finally:
        spark.streams.removeListener(seen)
