"""Sounding by a pseudorandom code: range profiles by period, whitened Doppler spectra by analysis, for tables and streams alike."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions.signal import window
from sigloom.functions.timebase import div
from sigloom.operators.stripes import over


def profiles(periods: DataFrame, code: np.ndarray, ranges: int) -> DataFrame:
    """DSP-14: periods (channel, segment, x) with h in place of x: the echoes of the first ranges, re and im in turn, by least squares of a period's samples less
    their median. The pseudo-inverse, of the code's length times ranges, travels with the function."""
    n = len(code)
    inverse = np.linalg.pinv(np.stack([np.roll(code, k) for k in range(ranges)], 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column(2).flatten(), float).reshape(b.num_rows, n)
            h = (x - np.median(x, axis=1, keepdims=True)) @ inverse.T
            flat = np.stack([h.real, h.imag], axis=2).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * (2 * ranges)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["channel", "segment", "h"])

    whole = periods.where((F.size("x") == n) & ~F.exists("x", lambda v: v.isNull()))
    x = F.col("x").cast("array<double>").alias("x")
    return whole.select("channel", F.col("segment").cast("long").alias("segment"), x).mapInArrow(run, "channel string, segment long, h array<double>")


def analyses(periods: DataFrame, code: np.ndarray, ranges: int, length: int, period_us: int = 1_000_000, origin: int = 0, delay: str = "0 seconds", white: bool = True) -> DataFrame:
    """DSP-15, DSP-16: (channel, block, range, k, power) of periods (channel, segment, x): the spectrum over length periods of each range, lowest frequency first.

    Analyses are blocks of length periods from the period origin on, one after the other; a block that lacks a period, or has one that is too short or
    holds a null, is skipped, and so is what lies before origin. white divides by the median magnitude of all ranges at a frequency, so that what all
    ranges share falls out; a power is null where that is 0. On a stream a block is an event-time window over the periods' times: its periods wait as
    state, a profile each, until the watermark passes its end, so that it comes out once, in append mode, and a stream goes on from its
    checkpoint where it stood. Repeats of a period count once.
    """
    if length < 1 or ranges < 1:
        raise ValueError("an analysis has a period and a range")
    span = length * period_us
    at = F.col("segment") - origin
    found = profiles(periods.where(at >= 0), code, ranges).withColumn("ts", F.timestamp_micros(at * period_us)).withWatermark("ts", delay)
    blocks = found.groupBy("channel", F.window("ts", f"{span} microseconds").alias("w")).agg(F.array_sort(F.collect_set(F.struct("segment", "h"))).alias("r"))
    held = blocks.where(F.size("r") == length).select("channel", div(F.unix_micros("w.start"), span).alias("block"), F.flatten("r.h").alias("h"))

    def kernel(h: np.ndarray) -> list[np.ndarray]:
        z = h.reshape(len(h), length, ranges, 2)
        s = np.fft.fft((z[..., 0] + 1j * z[..., 1]) * window("blackmanharris", length, periodic=False)[:, None], axis=1)
        power = np.abs(np.fft.fftshift(s, axes=1)) ** 2
        if white:
            level = np.median(np.sqrt(power), axis=2, keepdims=True) ** 2
            power = np.divide(power, level, out=np.full_like(power, np.nan), where=level > 0)
        k = np.repeat(np.arange(length) - length // 2, ranges)
        return [np.tile(np.arange(ranges), length)[None].astype(np.int64), k[None].astype(np.int64), power.reshape(len(h), -1)]

    out = over(held, ["channel", "block"], ["h"], kernel, "range long, k long, power double")
    return out.withColumn("power", F.nanvl("power", F.lit(None).cast("double")))
