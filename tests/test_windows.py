"""Windowed streams in append mode: what comes out once, what is late, and what state is left; medians of groups from sorted ranges."""

import statistics
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sigloom.operators import blocks
from sigloom.streaming import ingest

T0 = datetime(2020, 1, 1, tzinfo=timezone.utc)
SCHEMA = "channel string, sample_idx long, ts timestamp, re double"


def _run(spark, tmp_path, windows, batches):
    """What each batch adds to the output, a restart before each; (start hour, n) by window."""
    at, out, back = (str(tmp_path / x) for x in ("in", "out", "check"))
    seen, added = set(), []
    for minutes in batches:
        rows = [("a", m, T0 + timedelta(minutes=m), 1.0) for m in minutes]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(at)
        q = ingest.sink(windows(ingest.source(spark, at, SCHEMA)), out, back)
        got = {tuple(r) for r in spark.read.parquet(out).select(F.unix_seconds("w.start"), "n").collect()}
        added.append(sorted(((s - int(T0.timestamp())) // 60, n) for s, n in got - seen))
        assert seen <= got
        seen = got
    return added, q.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_sliding_waits_and_drops_late(spark, tmp_path):
    windows = lambda x: ingest.sliding_sums(x, "2 hours", "1 hour", delay="30 minutes")
    # 100 comes after 130, but its windows are open; 5 comes after its windows' ends have passed and is left out
    added, left = _run(spark, tmp_path, windows, [[0, 10, 110], [130, 100], [220], [5, 300], [1000]])
    assert added == [[(-60, 2)], [], [(0, 4), (60, 3)], [(120, 2)], [(180, 1), (240, 1), (300, 1)]]
    # the last sample's windows are all that is held
    assert left == 2


def test_session_closes_once(spark, tmp_path):
    windows = lambda x: ingest.sessions(x, "20 minutes", delay="10 minutes")
    added, left = _run(spark, tmp_path, windows, [[0, 10], [25, 100], [140], [500]])
    assert added == [[], [(0, 3)], [(100, 1)], [(140, 1)]] and left == 1


@pytest.mark.parametrize("n", [1, 2, 301])
def test_medians(spark, tmp_path, n):
    values = {"a": [float(k * 7919 % 101) for k in range(n)], "b": [3.0] * n, None: [-1.5, 4.0]}
    rows = [(g, x, k) for g, xs in values.items() for k, x in enumerate(xs)] + [("a", None, -1), ("b", float("nan"), -2), ("none", None, 0)]
    got = blocks.medians(spark.createDataFrame(rows, "g string, x double, k long"), "g", "x", "k", str(tmp_path / "m")).collect()
    assert {r["g"]: (r["n"], r["low"], r["high"], r["median"]) for r in got} == {g: (len(xs), min(xs), max(xs), statistics.median(xs)) for g, xs in values.items()}
