"""Equiripple low-pass design: ripple and stop band of several specifications, and level errors."""

import numpy as np
import pytest

from sigloom.functions.signal import equiripple


@pytest.mark.parametrize("cutoff, width, attenuation, ripple", [(0.9, 0.05, 80, None), (0.2, 0.1, 60, None), (0.45, 0.1, 80, 40), (0.1, 0.02, 50, 50), (0.5, 0.3, 100, 60), (0.25, 0.2, 40, 70)])
def test_specification(cutoff, width, attenuation, ripple):
    taps = np.array(equiripple(cutoff, width, attenuation, ripple))
    assert len(taps) % 2 == 1 and np.allclose(taps, taps[::-1])
    # denser than the design looks at
    f = np.linspace(0, 1, 20_001)
    h = np.abs(np.exp(-1j * np.pi * np.outer(f, np.arange(len(taps)))) @ taps)
    passed, stopped = np.abs(1 - h[f <= cutoff]), h[f >= cutoff + width]
    assert -20 * np.log10(passed.max()) >= (ripple or attenuation) - 0.05 and -20 * np.log10(stopped.max()) >= attenuation - 0.05
    # level: about one ripple of the same height for each two taps
    peaks = lambda e: e[1:-1][(e[1:-1] >= e[:-2]) & (e[1:-1] > e[2:])]
    for e in (passed, stopped):
        high = peaks(e)
        assert len(high) and (len(high) < 3 or np.median(high) > 0.9 * e.max())


def test_refused():
    for wrong in ((0, 0.1), (0.5, 0), (0.9, 0.1)):
        with pytest.raises(ValueError):
            equiripple(*wrong)
