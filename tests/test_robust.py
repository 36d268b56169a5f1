"""Robust polynomials against numpy on every channel, rounds and all."""

import numpy as np
import pytest

from sigloom.operators import robust


def plain(y, w, rounds=10, terms=7):
    y = np.array(y, float)
    t = np.linspace(-1, 1, len(y)) if len(y) > 1 else np.array([-1.0])
    p = np.polynomial.legendre.legvander(t, terms - 1)
    root, left, gone = np.sqrt(np.array(w, float)), y.copy(), np.zeros(len(y), bool)
    for _ in range(rounds):
        keep = np.where(gone, 0.0, root)
        fit = p @ np.linalg.lstsq(p * keep[:, None], left * keep, rcond=None)[0]
        slope = np.gradient(fit - left) if len(y) > 1 else np.zeros(1)
        more = abs(slope) > 2 * slope.std()
        fresh = more & ~gone
        gone |= more
        left[more] = 0.0
        if not fresh.any():
            break
    return fit, gone


@pytest.mark.parametrize("stretch", [16, 1 << 14])
def test_polynomials(spark, tmp_path, stretch):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    # the first channel holds most of all points
    for channel, n in (("hot", 1500), ("b", 200), ("c", 33), ("d", 8), ("e", 2), ("f", 1), (None, 50)):
        t = np.linspace(-1, 1, n)
        y = 3 + 2 * t - 4 * t**3 + t**6 + rng.normal(scale=0.05, size=n)
        y[rng.random(n) < 0.06] += 30
        w = rng.uniform(0.5, 2, n)
        rows += [(channel, k, float(a), float(b)) for k, (a, b) in enumerate(zip(y, w, strict=True))]
        want[channel] = plain(y, w)
    df = spark.createDataFrame(rows, "channel string, k long, y double, w double").repartition(3)
    got = {}
    for r in robust.polynomials(df, str(tmp_path / "rounds"), weight="w", stretch=stretch).collect():
        got.setdefault(r.channel, {})[r.k] = (r.fit, r.gone)
    for channel, (fit, gone) in want.items():
        mine = got[channel]
        assert sorted(mine) == list(range(len(fit)))
        if len(fit) > 7:
            assert [mine[k][1] for k in range(len(fit))] == gone.tolist(), channel
            assert max(abs(mine[k][0] - fit[k]) for k in range(len(fit))) < 1e-6, channel


def test_a_clean_curve_stays(spark, tmp_path):
    """A polynomial of its order is met exactly."""
    t = np.linspace(-1, 1, 400)
    rows = [("a", k, float(v)) for k, v in enumerate(1 - 2 * t + 5 * t**4)]
    got = robust.polynomials(spark.createDataFrame(rows, "channel string, k long, y double"), str(tmp_path / "r"), rounds=1).collect()
    assert max(abs(r.fit - r.y) for r in got) < 1e-9
