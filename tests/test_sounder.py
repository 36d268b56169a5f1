"""Whitened analyses against numpy, and the stream against the table."""

import numpy as np
import pytest

from sigloom.operators import sounder, spectral
from sigloom.plans import catalogue
from sigloom.streaming import ingest

SF = "/root/testdata/sf0.001"
N, R, L = 12, 4, 6


def plain(x, code):
    """x by segment; {(block, range, k): power}."""
    b = np.linalg.pinv(np.stack([np.roll(code, k) for k in range(R)], 1))
    t = np.arange(L) / (L - 1)
    w = 0.35875 - 0.48829 * np.cos(2 * np.pi * t) + 0.14128 * np.cos(4 * np.pi * t) - 0.01168 * np.cos(6 * np.pi * t)
    out = {}
    for block in range(max(x) // L + 1):
        if all(block * L + j in x for j in range(L)):
            z = np.array([b @ (x[block * L + j] - np.median(x[block * L + j])) for j in range(L)])
            s = np.fft.fftshift(np.fft.fft(w[:, None] * z, axis=0), axes=0)
            s = s / np.median(abs(s), axis=1)[:, None]
            out |= {(block, r, k - L // 2): abs(s[k, r]) ** 2 for k in range(L) for r in range(R)}
    return out


def test_analyses(spark, tmp_path):
    """Gaps, repeats, nulls and short periods; the stream, stopped and begun again, gives the table's rows once."""
    rng, code = np.random.default_rng(2), spectral.random_code(N, 3)
    x = {s: rng.normal(size=N) for s in range(40) if s != 9}
    rows = [("a", s, v.tolist()) for s, v in x.items()]
    bad = [("a", 9, [1.0, None] + [0.0] * (N - 2)), ("a", 9, [1.0]), ("a", 3, x[3].tolist()), ("a", None, x[3].tolist()), ("a", 9, None), ("a", -2, x[3].tolist())]
    kind = "channel string, segment long, x array<double>"
    want = plain(x, code)
    table = sounder.analyses(spark.createDataFrame(rows + bad, kind).repartition(3), code, R, L).collect()
    assert {(r.block, r.range, r.k): r.power for r in table} == {k: pytest.approx(v) for k, v in want.items()}
    assert len(table) == len(want)
    path, out, checkpoint = (str(tmp_path / p) for p in ("in", "out", "check"))
    for part in (rows[:17], rows[17:30] + bad, rows[30:] + [("~clock", 99, [0.0] * N)]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(path)
        ingest.sink(sounder.analyses(ingest.source(spark, path, kind, files_at_once=10), code, R, L), out, checkpoint)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, table))


def test_no_periods(spark):
    df = spark.createDataFrame([], "channel string, segment long, x array<double>")
    assert sounder.analyses(df, spectral.random_code(N, 3), R, L).collect() == []


def test_equal_ranges_have_no_level(spark):
    """Constant periods have no echo: nothing to divide by."""
    df = spark.createDataFrame([("a", s, [1.0] * N) for s in range(L)], "channel string, segment long, x array<double>")
    assert {r.power for r in sounder.analyses(df, spectral.random_code(N, 3), R, L).collect()} == {None}


def test_queries_agree(spark):
    table, stream = (sorted(map(tuple, catalogue.queries()[q](spark, SF).collect())) for q in ("prc_whitened", "prc_online"))
    assert table and table == stream
