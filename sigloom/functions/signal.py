"""Point-wise signal expressions; complex values are two DOUBLE columns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Barker codes by length.
BARKER = {2: "+-", 3: "++-", 4: "++-+", 5: "+++-+", 7: "+++--+-", 11: "+++---+--+-", 13: "+++++--++-+-+"}


def barker(n: int) -> list[float]:
    return [1.0 if c == "+" else -1.0 for c in BARKER[n]]


def power(re: Column, im: Column) -> Column:
    return re * re + im * im


def decibel(x: Column, floor: float = 1e-12) -> Column:
    return 10 * F.log10(x + F.lit(floor))


def phase(re: Column, im: Column) -> Column:
    return F.atan2(im, re)


def iq_log(x: Column, bits: int | None = None) -> Column:
    """MTH-04: scaled by 2^bits, or signed log2."""
    return x * float(2**bits) if bits is not None else F.signum(x) * F.log2(F.abs(x) + F.lit(1e-30))


def rotate(re: Column, im: Column, angle: Column) -> tuple[Column, Column]:
    """MTH-05: times e^(j angle)."""
    c, s = F.cos(angle), F.sin(angle)
    return re * c - im * s, re * s + im * c


def quantize(x: Column, scale: float, kind: str = "long") -> Column:
    """MTH-09: scaled and rounded half to even."""
    return F.rint(x * F.lit(scale)).cast(kind)


def range_km(position: Column, rate_hz: float) -> Column:
    """MTH-06: 0.15 km a microsecond."""
    return position * F.lit(0.15e6 / rate_hz)


def bin_frequency(k: Column, bins: int, rate_hz: float, centre: float = 0.0) -> Column:
    """MTH-07: the frequency of FFT bin k, negative above half the bins."""
    return F.when(k < (bins + 1) // 2, k).otherwise(k - bins) * F.lit(rate_hz / bins) + F.lit(centre)


def hex_bits(text: Column, length: int) -> Column:
    """MTH-10: the last length bits of a hexadecimal string, as an array of ints."""
    nibbles = F.transform(F.filter(F.split(text, ""), lambda h: h != ""), lambda h: F.lpad(F.conv(h, 16, 2), 4, "0"))
    bits = F.right(F.concat(F.lit("0" * length), F.array_join(nibbles, "")), F.lit(length))
    return F.transform(F.filter(F.split(bits, ""), lambda b: b != ""), lambda b: b.cast("int"))


def replace_fill(x: Column, fill: float | None) -> Column:
    """PRJ-07: 0 for NaN, null and the type's fill value."""
    missing = x.isNull() | F.isnan(x)
    return F.when(missing if fill is None else missing | (x == fill), 0.0).otherwise(x)


def repeat_code(code: Column, times: int) -> Column:
    """ARR-03: each item times times over."""
    return F.flatten(F.transform(code, lambda v: F.array_repeat(v, times)))


#: TEC in 1e16 electrons/m^2 for a phase in cycles at the two beacon frequencies 150 and 400 MHz (public dispersion formula).
def tec_per_cycle(f1: float = 150e6, f2: float = 400e6) -> float:
    return 299792458.0 * f1 / (40.308 * (1 - (f1 / f2) ** 2)) / 1e16


def window(name: str, n: int, periodic: bool = True) -> np.ndarray:
    """Named window functions by their cosine sums."""
    terms = {"boxcar": [1.0], "hann": [0.5, 0.5], "hamming": [0.54, 0.46], "blackman": [0.42, 0.5, 0.08], "blackmanharris": [0.35875, 0.48829, 0.14128, 0.01168]}[name]
    t = 2 * np.pi * np.arange(n) / (n if periodic else max(n - 1, 1))
    return sum((-1) ** k * a * np.cos(k * t) for k, a in enumerate(terms)) * np.ones(n)


def lowpass(taps: int, cutoff: float) -> list[float]:
    """A windowed-sinc low-pass filter; cutoff in cycles a sample. For level ripples see equiripple."""
    w = window("hamming", taps, periodic=False)
    mid = (taps - 1) / 2
    h = [2 * cutoff * (1.0 if i == mid else math.sin(2 * math.pi * cutoff * (i - mid)) / (2 * math.pi * cutoff * (i - mid))) * w[i] for i in range(taps)]
    return [float(x / sum(h)) for x in h]


def chebyshev(order: int, ripple_db: float, cutoff: float) -> list[tuple[float, float, float, float, float]]:
    """DSP-09: a digital low-pass with equal ripple in its pass band, as sections (b0, b1, b2, a1, a2); cutoff as a share of half the rate, order even.

    Poles lie on an ellipse in the analog plane and go through the bilinear map; at frequency 0 the gain is the ripple's lower end.
    """
    if order < 2 or order % 2 or not 0 < cutoff < 1 or ripple_db <= 0:
        raise ValueError("an even order, a cutoff between 0 and 1, and some ripple")
    e = math.sqrt(10 ** (ripple_db / 10) - 1)
    mu, warped = math.asinh(1 / e) / order, math.tan(math.pi * cutoff / 2)
    out = []
    for k in range(order // 2):
        theta = math.pi * (2 * k + 1) / (2 * order)
        s = warped * complex(-math.sinh(mu) * math.sin(theta), math.cosh(mu) * math.cos(theta))
        z = (1 + s) / (1 - s)
        a1, a2 = -2 * z.real, abs(z) ** 2
        g = (1 + a1 + a2) / 4 * (1 / math.sqrt(1 + e * e) if k == 0 else 1.0)
        out.append((g, 2 * g, g, a1, a2))
    return out


def _exchange(half: int, cutoff: float, stop: float, weight: float, density: int = 24, rounds: int = 60) -> np.ndarray | None:
    """Taps of a symmetric low-pass of 2 * half + 1 taps whose weighted error is level, by the exchange of extremal frequencies; None where that fails.

    On half + 2 points the error of the best cosine sum alternates with one size. The sum through such points (barycentric) shows
    where the error is larger; its extremes, one to a run of one sign, are the next points.
    """
    r = half + 2
    n = density * r
    inside = max(2, round(n * cutoff / (cutoff + 1 - stop)))
    f = np.concatenate([np.linspace(0, cutoff, inside), np.linspace(stop, 1, max(2, n - inside))])
    wanted, w = (f <= cutoff).astype(float), np.where(f <= cutoff, weight, 1.0)
    x, signs = np.cos(np.pi * f), (-1.0) ** np.arange(r)
    at = np.round(np.linspace(0, len(f) - 1, r)).astype(int)
    for _ in range(rounds):
        apart = 2 * (x[at][:, None] - x[at][None, :])
        np.fill_diagonal(apart, 1.0)
        b = 1 / apart.prod(axis=1)
        level = (b @ wanted[at]) / (b @ (signs / w[at]))
        values, own = (wanted[at] - signs * level / w[at])[:-1], (b * 2 * (x[at] - x[at[-1]]))[:-1]

        def through(points: np.ndarray, values: np.ndarray = values, own: np.ndarray = own, nodes: np.ndarray = x[at[:-1]]) -> np.ndarray:
            d = points[:, None] - nodes[None, :]
            hit = np.abs(d) < 1e-14
            share = own / np.where(hit, 1.0, d)
            with np.errstate(divide="ignore", invalid="ignore"):  # only at nodes, whose values follow
                out = share @ values / share.sum(axis=1)
            rows, columns = np.nonzero(hit)
            out[rows] = values[columns]
            return out

        error = w * (wanted - through(x))
        edge = np.flatnonzero(np.diff(np.sign(error)) != 0) + 1
        runs = np.split(np.arange(len(f)), edge)
        new = [int(k[np.argmax(np.abs(error[k]))]) for k in runs]
        while len(new) > r:
            if len(new) == r + 1:
                new.pop(0 if abs(error[new[0]]) < abs(error[new[-1]]) else -1)
            else:
                # two neighbours go together, so that signs still alternate
                k = min(range(len(new) - 1), key=lambda k: max(abs(error[new[k]]), abs(error[new[k + 1]])))
                del new[k : k + 2]
        if len(new) < r:
            return None
        if np.abs(error).max() <= abs(level) * (1 + 1e-6):
            break
        at = np.array(new)
    else:
        return None
    taps = 2 * half + 1
    a = through(np.cos(2 * np.pi * np.arange(half + 1) / taps))
    k = np.arange(1, half + 1)
    return (a[0] + 2 * np.cos(2 * np.pi * np.outer(np.arange(taps) - half, k) / taps) @ a[1:]) / taps


def equiripple(cutoff: float, width: float, attenuation: float = 80.0, ripple: float | None = None) -> list[float]:
    """DSP-11: a symmetric low-pass of as few taps as are found from an estimate on, level in its ripples; frequencies as shares of half the rate.

    The pass band ends at cutoff, the stop band begins at cutoff + width. attenuation and ripple are how many decibels the largest errors in the stop and pass
    band lie below 1; ripple is attenuation by default. Orders are even and grow by two until both hold, 20 times at most.
    """
    ripple = attenuation if ripple is None else ripple
    if cutoff <= 0 or width <= 0 or cutoff + width >= 1:
        raise ValueError("a cutoff and a width over 0, together below 1")
    half = max(1, math.ceil(((attenuation + ripple) / 2 - 13) / 2.324 / (math.pi * width) / 2))
    for more in range(20):
        taps = _exchange(half + more, cutoff, cutoff + width, 10 ** ((ripple - attenuation) / 20))
        if taps is None:
            continue
        h = np.abs(np.fft.rfft(taps, 32 * len(taps)))
        f = np.arange(len(h)) / (len(h) - 1)
        passed, stopped = np.abs(1 - h[f <= cutoff]).max(), h[f >= cutoff + width].max()
        if -20 * np.log10(passed) >= ripple and -20 * np.log10(stopped) >= attenuation:
            return [float(t) for t in taps]
    raise RuntimeError("no filter of 20 orders meets this")
