"""Stripes with gaps and two-frequency runs against plain numpy."""

import math
from itertools import pairwise

import numpy as np
import pytest

from sigloom.operators import dualfreq, stripes


def signal_of(n, gone, seed=3):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=n) + 1j * rng.normal(size=n) + 0.5
    return {i: complex(z[i]) for i in range(n) if i not in gone}


@pytest.mark.parametrize(("length", "step", "bins", "mean"), [(12, 5, 4, True), (6, 6, 5, False), (4, 9, 4, False)])
def test_stripes_with_gaps(spark, length, step, bins, mean):
    """One sample missing, a gap of several stripes, and stripes that do not meet."""
    z = {"a": signal_of(140, {17, *range(40, 75)}), "b": signal_of(30, range(9))}
    df = spark.createDataFrame([(c, i, v.real, v.imag) for c, s in z.items() for i, v in s.items()], "channel string, sample_idx long, re double, im double").repartition(3)
    got = {}
    for r in stripes.spectra(df, length, step, bins, rate_hz=8.0, mean=mean).collect():
        got.setdefault((r.channel, r.start), {})[r.k] = (r.hz, r.db)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(bins) / bins)
    for c, s in z.items():
        touched = [m for m in range(200) if any(m * step <= i < m * step + length for i in s)]
        starts = {m * step for m in range(touched[0], touched[-1] + 1)}
        assert starts == {b for a, b in got if a == c}
        for start in starts:
            mine = [got[c, start][k] for k in range(-(bins // 2), bins - bins // 2)]
            assert len(got[c, start]) == bins
            assert [m[0] for m in mine] == pytest.approx(list(np.fft.fftshift(np.fft.fftfreq(bins, 1 / 8))))
            if not all(start + p in s for p in range(length)):
                assert all(math.isnan(m[1]) for m in mine)
                continue
            x = np.array([s[start + p] for p in range(length)])
            pieces = [x[a : a + bins] for a in range(0, length - bins + 1, bins - bins // 2)]
            power = np.mean([abs(np.fft.fft((p - p.mean() if mean else p) * w)) ** 2 for p in pieces], axis=0) / w.sum() ** 2
            assert [m[1] for m in mine] == pytest.approx(list(10 * np.log10(np.fft.fftshift(power) + 1e-20)), abs=1e-9)


def test_decimated_stripes(spark, tmp_path):
    """A slow tone keeps its frequency and level through the filter."""
    rows = [("a", i, math.cos(2 * math.pi * i / 64), math.sin(2 * math.pi * i / 64)) for i in range(768)]
    df = spark.createDataFrame(rows, "channel string, sample_idx long, re double, im double")
    out = [r for r in stripes.spectra(df, 64, 64, 32, rate_hz=64.0, decimation=4, path=str(tmp_path / "y")).collect() if r.start == 256]
    top = max(out, key=lambda r: r.db)
    assert top.hz == 1.0 and abs(top.db) < 0.2


def test_no_samples(spark):
    df = spark.createDataFrame([], "channel string, sample_idx long, re double, im double")
    assert stripes.spectra(df, 8, 4, 4).collect() == []
    with pytest.raises(ValueError):
        stripes.spectra(df, 3, 4, 4)


@pytest.mark.parametrize("span", [1, 4, 1 << 14])
def test_sums_of_runs(spark, span):
    """Runs that end at a stretch's edge, fill stretches, or stand alone."""
    rng = np.random.default_rng(5)
    at = {"hot": [i for i in range(60) if i not in (7, 8, 20, 44)], "b": [3, 4, 8, 11, 12], "c": [0]}
    rows = [(c, i, float(rng.integers(-9, 9))) for c, s in at.items() for i in s]
    value = {(c, i): v for c, i, v in rows}
    want = set()
    for c, s in at.items():
        run, total = s[0], value[c, s[0]]
        want.add((c, s[0], run, total))
        for a, b in pairwise(s):
            run, total = (run, total + value[c, b]) if b == a + 1 else (b, value[c, b])
            want.add((c, b, run, total))
    df = spark.createDataFrame(rows, "channel string, stripe long, x double").repartition(3)
    got = dualfreq.run_sums(df, ["x"], span=span).select("channel", "stripe", "run", "x")
    assert {tuple(r) for r in got.collect()} == want


def test_medians(spark, tmp_path):
    rng = np.random.default_rng(1)
    values = {"a": rng.integers(0, 5, 401).astype(float), "b": rng.normal(size=40), "c": np.array([2.5])}
    rows = [(c, float(v)) for c, s in values.items() for v in s] + [("a", None), ("d", None)]
    got = dict(dualfreq.medians(spark.createDataFrame(rows, "channel string, x double").repartition(3), "x", str(tmp_path / "p")).collect())
    assert got == {c: pytest.approx(np.median(s)) for c, s in values.items()}


@pytest.mark.parametrize("span", [3, 1 << 14])
def test_electron_content_of_a_slope(spark, tmp_path, span):
    """A content that grows evenly turns both phases, each by its frequency; a gap of samples ends the run."""
    f0, f1, per_sample = 150e6, 400e6, 0.002
    scale = 4 * math.pi**2 * 40.308e16 / 299792458.0
    turn = lambda f, i: -scale * per_sample * i / (2 * math.pi * f)
    rows = []
    for i in range(400):
        if i != 203:
            a, b = (complex(np.exp(1j * turn(f, i))) for f in (f0, f1))
            rows.append(("x", i, a.real, a.imag, b.real, b.imag))
    df = spark.createDataFrame(rows, "channel string, sample_idx long, re0 double, im0 double, re1 double, im1 double")
    steps = dualfreq.phase_steps(df, 8, 4, 2, f1 / f0)
    got = sorted(dualfreq.electron_content(steps, str(tmp_path), f0, f1, 8, 2, span=span).collect(), key=lambda r: r.stripe)
    # a stripe of 24 samples begins every 20; the 203rd sample is in the stripe from 200 on and in the one from 180 on
    assert [r.stripe for r in got] == [m for m in range(19) if m not in (9, 10)]
    assert {r.run for r in got} == {0, 11}
    for r in got:
        assert r.tec == pytest.approx((r.stripe - r.run) * 4 * per_sample, abs=1e-6)
        assert r.tec_sigma == pytest.approx(0, abs=1e-6) and r.s4 >= 0
