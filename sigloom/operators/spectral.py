"""Fourier operators: segments as arrays through numpy kernels in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions.signal import window
from sigloom.functions.timebase import floor_div
from sigloom.operators.blocks import STRETCH


def segments(samples: DataFrame, length: int) -> DataFrame:
    """(segment, x): arrays of length consecutive samples (sample_idx, x); a partial last one is left out. A group is bounded by length."""
    rows = F.array_sort(F.collect_list(F.struct("sample_idx", "x")))
    out = samples.groupBy(F.floor(F.col("sample_idx") / length).cast("long").alias("segment")).agg(rows.alias("r"))
    return out.where(F.size("r") == length).select("segment", F.transform("r", lambda s: s["x"].cast("double")).alias("x"))


def _kernel(df: DataFrame, key: str, arrays: list[str], kernel, fields: str) -> DataFrame:
    """Rows (key, then kernel's columns): kernel takes 2-D arrays of a batch and gives equally long 2-D arrays to flatten."""
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            data = [np.asarray(b.column(1 + k).flatten()).astype(float).reshape(b.num_rows, -1) for k in range(len(arrays))]
            out = kernel(*data)
            size = out[0].shape[1]
            cols = [pa.array(np.repeat(np.asarray(b.column(0)), size))] + [pa.array(np.ascontiguousarray(np.broadcast_to(x, (b.num_rows, size))).ravel()) for x in out]
            yield pa.RecordBatch.from_arrays(cols, [key, *names])

    return df.select(F.col(key).cast("long").alias(key), *arrays).mapInArrow(run, f"{key} long, {fields}")


def power_spectrum(df: DataFrame, key: str, array: str, window_name: str = "boxcar", periodic: bool = True, detrend: bool = False, scale: bool = False) -> DataFrame:
    """DSP-01, DSP-22: (key, k, power) of each segment's FFT; scale divides by the window's squared sum."""

    def kernel(x: np.ndarray) -> list[np.ndarray]:
        w = window(window_name, x.shape[1], periodic)
        x = x - x.mean(axis=1, keepdims=True) if detrend else x
        p = np.abs(np.fft.fft(x * w)) ** 2 / (w.sum() ** 2 if scale else 1.0)
        return [np.arange(x.shape[1], dtype=np.int64)[None], p]

    return _kernel(df, key, [array], kernel, "k long, power double")


def _pieces(x: np.ndarray, nperseg: int, step: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, nperseg, axis=1)[:, ::step]


def welch(df: DataFrame, key: str, array: str, nperseg: int, noverlap: int, window_name: str = "hann") -> DataFrame:
    """AGG-07, DSP-05: mean of the segments' two-sided spectra, with spectrum scaling."""

    def kernel(x: np.ndarray) -> list[np.ndarray]:
        w = window(window_name, nperseg)
        p = (np.abs(np.fft.fft(_pieces(x, nperseg, nperseg - noverlap) * w)) ** 2).mean(axis=1) / w.sum() ** 2
        return [np.arange(nperseg, dtype=np.int64)[None], p]

    return _kernel(df, key, [array], kernel, "k long, power double")


def specgram(df: DataFrame, key: str, array: str, bins: int, noverlap: int, window_name: str = "hann") -> DataFrame:
    """DSP-02: (key, seg, k, power) of overlapping segments."""

    def kernel(x: np.ndarray) -> list[np.ndarray]:
        w = window(window_name, bins)
        p = np.abs(np.fft.fft(_pieces(x, bins, bins - noverlap) * w)) ** 2 / w.sum() ** 2
        n = p.shape[1]
        return [np.repeat(np.arange(n), bins)[None].astype(np.int64), np.tile(np.arange(bins), n)[None].astype(np.int64), p.reshape(len(x), -1)]

    return _kernel(df, key, [array], kernel, "seg long, k long, power double")


def cross_spectrum(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """DSP-07: (key, k, re, im) of X times conj(Y)."""

    def kernel(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        z = np.fft.fft(x) * np.conj(np.fft.fft(y))
        return [np.arange(x.shape[1], dtype=np.int64)[None], z.real, z.imag]

    return _kernel(df, key, [a, b], kernel, "k long, re double, im double")


def peak(spectrum: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """SRT-04, AGG-08, AGG-11: the peak bin in a sub-band (lowest on ties), the noise floor median / ln 2, and their ratio."""
    band = F.col("k").between(first, last)
    best = F.max(F.when(band, F.struct("power", (-F.col("k")).alias("k"))))
    out = spectrum.groupBy(key).agg(best.alias("b"), (F.median("power") / F.log(F.lit(2.0))).alias("noise"))
    return out.select(key, (-F.col("b.k")).alias("peak_k"), F.col("b.power").alias("peak_power"), "noise", (F.col("b.power") / F.col("noise")).alias("snr"))


def beamform(vectors: DataFrame, group: str, channel: str, phase_deg: float) -> DataFrame:
    """DSP-06: the sum over a group's channels of samples (pos, x) rotated by channel times phase."""
    angle = F.radians(F.col(channel) * phase_deg)
    return vectors.groupBy(group, "pos").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), F.sum(F.col("x") * F.sin(angle)).alias("im"))


def least_squares(df: DataFrame, key: str, array: str, code: np.ndarray, ranges: int) -> DataFrame:
    """DSP-14, DSP-15: (key, k, re, im): range profile h of each code period x = code (*) h, by the pseudo-inverse of the periodic convolution
    matrix, a few kB that travel with the function."""
    n = len(code)
    inverse = np.linalg.pinv(np.stack([np.roll(code, k) for k in range(ranges)], 1))

    def kernel(x: np.ndarray) -> list[np.ndarray]:
        h = (x - np.median(x, axis=1, keepdims=True))[:, :n] @ inverse.T
        return [np.arange(ranges, dtype=np.int64)[None], h.real, h.imag]

    return _kernel(df, key, [array], kernel, "k long, re double, im double")


def random_code(length: int, seed: int) -> np.ndarray:
    """Pseudorandom phases."""
    return np.exp(2j * np.pi * np.random.RandomState(seed).random_sample(length))


def doppler(profiles: DataFrame, window_name: str, length: int) -> DataFrame:
    """DSP-15: (range, block, k, power): FFT over length consecutive periods of each range, windowed."""
    rows = F.array_sort(F.collect_list(F.struct("segment", "re", "im")))
    own = profiles.groupBy(F.col("k").alias("range"), F.floor(F.col("segment") / length).cast("long").alias("block")).agg(rows.alias("r")).where(F.size("r") == length)
    flat = own.select((F.col("range") * (1 << 32) + F.col("block")).alias("id"), F.transform("r", lambda x: x["re"]).alias("re"), F.transform("r", lambda x: x["im"]).alias("im"))

    def kernel(re: np.ndarray, im: np.ndarray) -> list[np.ndarray]:
        return [np.arange(length, dtype=np.int64)[None], np.abs(np.fft.fft((re + 1j * im) * window(window_name, length))) ** 2]

    out = _kernel(flat, "id", ["re", "im"], kernel, "k long, power double")
    return out.select(F.floor(F.col("id") / (1 << 32)).cast("long").alias("range"), (F.col("id") % (1 << 32)).alias("block"), "k", "power")


def cross_db(spectrum: DataFrame, group: Column, floor: float = 1e-12) -> DataFrame:
    """DSP-07: (grp, k, db, phase) of cross spectra (k, re, im) averaged over each group: magnitude in dB and phase in radians."""
    mean = spectrum.groupBy(group.alias("grp"), "k").agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
    return mean.select("grp", "k", (10 * F.log10(F.sqrt(F.col("re") ** 2 + F.col("im") ** 2) + floor)).alias("db"), F.atan2("im", "re").alias("phase"))


def geometric_mean(samples: DataFrame, by: list[str], re: str = "re", im: str = "im") -> DataFrame:
    """AGG-12: the product of n complex values each to the power 1/n: log magnitudes and principal phases averaged; 0 where any value is 0."""
    size = F.sqrt(F.col(re) * F.col(re) + F.col(im) * F.col(im))
    out = samples.groupBy(*by).agg(F.exp(F.avg(F.when(size > 0, F.log(size)))).alias("m"), F.avg(F.when(size > 0, F.atan2(im, re))).alias("phase"), F.min(size).alias("least"))
    magnitude = F.when(F.col("least") > 0, F.col("m")).otherwise(0.0)
    return out.select(*by, magnitude.alias("magnitude"), F.when(F.col("least") > 0, F.col("phase")).otherwise(0.0).alias("phase"))


def detrend(df: DataFrame, by: list[str], value: str, how: str = "mean") -> DataFrame:
    """MTH-08: value less its group's mean or median."""
    middle = {"mean": F.avg, "median": F.median}[how](value).over(Window.partitionBy(*by))
    return df.withColumn(value, F.col(value) - middle)


def histogram(samples: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """AGG-06: (part, bin, n) of each column over its own range in equal bins; the last one is closed."""
    lows = samples.agg(*[f(c).alias(f"{n}_{c}") for c in columns for f, n in ((F.min, "lo"), (F.max, "hi"))])
    placed = samples.crossJoin(F.broadcast(lows))
    parts = []
    for c in columns:
        width = (F.col(f"hi_{c}") - F.col(f"lo_{c}")) / bins
        at = F.when(width > 0, F.least(F.floor((F.col(c) - F.col(f"lo_{c}")) / width), F.lit(bins - 1))).otherwise(0)
        parts.append(F.struct(F.lit(c).alias("part"), at.cast("long").alias("bin"), F.col(c).isNotNull().alias("there")))
    return placed.select(F.explode(F.array(*parts)).alias("p")).where("p.there").groupBy("p.part", "p.bin").agg(F.count(F.lit(1)).alias("n"))


def residual_frequency(df: DataFrame, key: str, a: str, b: str, first: int, last: int, bins: int, rate_hz: float, snr_db: float = 15.0) -> DataFrame:
    """DSP-18: (key, peak_k, hz, snr_db, found) of the cross spectrum of two windows: its strongest bin in a band, held against noise = median / ln 2.

    hz is that bin's frequency moved by the parabola through it and its neighbours in dB; found is false below snr_db.
    """
    cross = cross_spectrum(df, key, a, b).select(key, "k", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))
    top = peak(cross, key, first, last)
    near = cross.join(top.select(key, "peak_k"), key).where(F.abs(F.col("k") - F.col("peak_k")) == 1)
    db = lambda x: 10 * F.log10(x + F.lit(1e-300))
    sides = near.groupBy(key).agg(F.max(F.when(F.col("k") < F.col("peak_k"), F.col("power"))).alias("l"), F.max(F.when(F.col("k") > F.col("peak_k"), F.col("power"))).alias("r"))
    y0, y1, y2 = db(F.col("l")), db(F.col("peak_power")), db(F.col("r"))
    bend = y0 - 2 * y1 + y2
    move = F.when(bend < 0, 0.5 * (y0 - y2) / bend).otherwise(0.0)
    out = top.join(sides, key, "left").withColumn("snr_db", db(F.col("snr")))
    hz = (F.col("peak_k") + F.coalesce(move, F.lit(0.0))) * F.lit(rate_hz / bins)
    return out.select(key, "peak_k", hz.alias("hz"), "snr_db", (F.col("snr_db") >= snr_db).alias("found"))


def lag_of(samples: DataFrame, a: str, b: str, most: int, stretch: int = STRETCH) -> DataFrame:
    """DSP-18: (lag, r): the sum of a[i] b[i + lag] for lags up to most either way, for lags with any such pair.

    Samples are dealt out in stretches of the index, those within most of a stretch to it as well, so there is no join and no sample is sent once a lag.
    """
    at = F.col("sample_idx")
    near = F.explode(F.sequence(floor_div(at - most, stretch), floor_div(at + most, stretch)))
    dealt = samples.where(at.isNotNull()).select(near.alias("stretch"), at.cast("long").alias("sample_idx"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))

    def sums(part: pa.Table) -> pa.Table:
        idx, place = np.unique(part["sample_idx"].to_numpy(), return_inverse=True)
        held = []
        for c in ("x", "y"):
            there = part[c].is_valid().to_numpy()
            value = np.where(there, part[c].fill_null(0.0).to_numpy(), 0.0)
            held.append((np.bincount(place, value, len(idx)), np.bincount(place, there, len(idx)) > 0))
        (x, has_x), (y, has_y) = held
        own = np.flatnonzero(idx // stretch == part["stretch"][0].as_py())
        out = []
        for lag in range(-most, most + 1):
            j = np.minimum(np.searchsorted(idx, idx[own] + lag), len(idx) - 1)
            met = idx[j] == idx[own] + lag
            if met.any():
                i, j = own[met], j[met]
                both = has_x[i] & has_y[j]
                out.append((lag, float((x[i] * y[j])[both].sum()) if both.any() else None))
        return pa.table({"lag": pa.array([r[0] for r in out], pa.int32()), "r": pa.array([r[1] for r in out], pa.float64())})

    return dealt.groupBy("stretch").applyInArrow(sums, "lag int, r double").groupBy("lag").agg(F.sum("r").alias("r"))


def waveform(code: np.ndarray, repeat: int, taps: np.ndarray | None = None) -> np.ndarray:
    """DSP-17: a code's chips repeated, filtered around the circle by FFT, its largest magnitude 1."""
    x = np.repeat(np.asarray(code, complex), repeat)
    if taps is not None:
        h = np.zeros(len(x))
        h[: len(taps)] = taps
        x = np.fft.ifft(np.fft.fft(x) * np.fft.fft(np.roll(h, -(len(taps) // 2))))
    most = np.abs(x).max(initial=0)
    return x / most if most else x
