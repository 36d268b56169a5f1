"""Recursive zero-phase filters against a plain loop over each run, with stretches and spans of any size."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.functions.signal import chebyshev
from sigloom.operators import recursive

SECTIONS = chebyshev(8, 0.05, 0.2)


def once(x):
    """Section by section, sample by sample, from the state that x[0] would have kept."""
    for b0, b1, b2, a1, a2 in SECTIONS:
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        s1, s2 = x[0] * (gain - b0), x[0] * (b2 - a2 * gain)
        y = []
        for v in x:
            out = b0 * v + s1
            s1, s2 = b1 * v - a1 * out + s2, b2 * v - a2 * out
            y.append(out)
        x = y
    return x


def plain(x, pad=27):
    p = min(pad, len(x) - 1)
    ext = [2 * x[0] - v for v in x[p:0:-1]] + list(x) + [2 * x[-1] - v for v in x[-2 : -2 - p : -1]]
    return once(once(ext)[::-1])[::-1][p : p + len(x)]


def test_design():
    """Ripple within 0.05 dB up to the cutoff, an eighth order's fall beyond it."""
    w = np.pi * np.array([0.0, 0.05, 0.1, 0.15, 0.19, 0.2, 0.3, 0.4])
    z = np.exp(-1j * w)
    h = np.ones(len(w), complex)
    for b0, b1, b2, a1, a2 in SECTIONS:
        h *= (b0 + b1 * z + b2 * z**2) / (1 + a1 * z + a2 * z**2)
    db = 20 * np.log10(abs(h))
    assert all(-0.0501 <= x <= 1e-9 for x in db[:6]) and db[0] == pytest.approx(-0.05) and db[5] == pytest.approx(-0.05)
    assert db[6] < -35 and db[7] < -60


def test_system_equals_sections():
    x = np.random.default_rng(1).normal(size=333)
    c = recursive.Cascade(SECTIONS)
    y, state = c.run(x)
    free = c.free(333) @ (c.steady * x[0])
    assert np.allclose(y + free, once(list(x)), atol=1e-12)
    again, _ = c.run(np.ones(5000))
    assert again[-1] == pytest.approx(10 ** (-0.05 / 20)) and state.shape == (8,)


@pytest.mark.parametrize("length, span", [(16, 3), (100, 2), (1 << 14, 1 << 12)])
def test_runs(spark, length, span):
    rng = np.random.default_rng(7)
    runs = {("a", 5): 900, ("a", 1000): 1, ("a", 1002): 2, ("a", 2000): 30, ("b", 65_500): 300}
    rows, want = [], {}
    for (channel, start), n in runs.items():
        x = rng.normal(size=n) + 5
        rows += [(channel, start + k, float(v)) for k, v in enumerate(x)]
        want |= {(channel, start + k): v for k, v in enumerate(plain(list(x)))}
    got = {(r.channel, r.sample_idx): r.y for r in recursive.zero_phase(spark.createDataFrame(rows, "channel string, sample_idx long, x double"), SECTIONS, length=length, span=span).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_one_run_is_many_tasks_and_keeps_a_tone(spark):
    """A slow tone in 20,000 samples of one run comes out without delay; a fast one goes."""
    t = F.col("id") / 40.0
    x = spark.range(20_000).select(F.lit("c").alias("channel"), F.col("id").alias("sample_idx"), (F.cos(2 * np.pi * t) + F.cos(np.pi * 0.9 * F.col("id"))).alias("x"))
    got = recursive.decimate_zero_phase(x, 4, length=512, span=8).where("sample_idx between 100 and 4900").collect()
    assert len(got) == 4801
    assert max(abs(r.y - np.cos(2 * np.pi * 4 * r.sample_idx / 40) * 10 ** (-0.1 / 20)) for r in got) < 0.02


def test_short_runs_go_side_by_side(spark, tmp_path):
    """A hundred thousand samples in runs of one to twelve: no pairs of samples and runs, no Python call a run (before: over 100 s for a tenth of these)."""
    x = spark.range(120_000).where("id % 13 not in (3, 5, 12) and id % 7 <> 6").select(F.lit("c").alias("channel"), (F.col("id") - 60_000).alias("sample_idx"), (F.col("id") % 11).cast("double").alias("x"))
    began = time.monotonic()
    got = {r.sample_idx: r.y for r in recursive.zero_phase(x, SECTIONS, path=str(tmp_path)).collect()}
    assert time.monotonic() - began < 40
    held = sorted(got)
    assert len(held) == x.count()
    for start in (-60_000, held[len(held) // 2], held[-40]):
        while start - 1 in got:
            start -= 1
        n = next(k for k in range(1, 20) if start + k not in got)
        want = plain([float((start + k + 60_000) % 11) for k in range(n)])
        assert max(abs(got[start + k] - want[k]) for k in range(n)) < 1e-9


def test_a_folder_changes_nothing(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [("a", start + k, float(rng.normal())) for start, n in ((0, 900), (1000, 3), (1100, 70), (65_400, 300)) for k in range(n)]
    x = spark.createDataFrame(rows, "channel string, sample_idx long, x double")
    with_folder, without = ({r.sample_idx: r.y for r in recursive.zero_phase(x, SECTIONS, length=100, span=2, path=p).collect()} for p in (str(tmp_path), None))
    assert with_folder.keys() == without.keys() == {r[1] for r in rows}
    assert max(abs(with_folder[k] - without[k]) for k in without) < 1e-12
