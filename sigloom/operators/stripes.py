"""Stripes of a long signal with gaps: overlapping windows of fixed length, each whole or not, and what is computed on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions.signal import window
from sigloom.functions.timebase import div
from sigloom.operators import blocks, recursive


def _of(length: int, step: int) -> tuple[Column, Column]:
    """The first and last stripe that a sample is in; the first is the later one between stripes that do not meet."""
    i = F.col("sample_idx")
    return F.greatest(div(i - (length - step), step), F.lit(0).cast("long")), div(i, step)


def stripes(samples: DataFrame, columns: list[str], length: int, step: int) -> DataFrame:
    """(channel, stripe, whole, and an array of each column): stripe s is of the samples from s * step on, length of them.

    samples are (channel, sample_idx from 0, columns), an index once a channel. A sample goes to every stripe that it is in, across any border of
    the input's files or partitions; a group is bounded by length. Stripes that lack a sample are not whole and have null arrays.
    """
    if length < 1 or step < 1:
        raise ValueError("a stripe has a sample, and stripes move on")
    first, last = _of(length, step)
    placed = samples.where(first <= last).withColumn("stripe", F.explode(F.sequence(first, last)))
    rows = placed.groupBy("channel", "stripe").agg(F.array_sort(F.collect_list(F.struct("sample_idx", *columns))).alias("r"))
    whole = F.size("r") == length
    arrays = [F.when(whole, F.col(f"r.{c}").cast("array<double>")).alias(c) for c in columns]
    return rows.select("channel", "stripe", whole.alias("whole"), *arrays)


def absent(samples: DataFrame, length: int, step: int) -> DataFrame:
    """(channel, stripe) between a channel's first and last stripe without any sample: found from runs of stripes, not by a list of all."""
    first, last = _of(length, step)
    here = samples.where(first <= last).select("channel", F.explode(F.sequence(first, last)).alias("sample_idx")).distinct()
    gone = blocks.gaps(blocks.islands(here))
    return gone.select("channel", F.explode(F.sequence("gap_start", F.col("gap_start") + F.col("gap_n") - 1)).alias("stripe"))


def over(df: DataFrame, keys: list[str], arrays: list[str], kernel: Callable[..., list[np.ndarray]], fields: str) -> DataFrame:
    """Rows (keys, then kernel's columns): kernel takes a 2-D array a column, of a batch's rows, and gives 2-D arrays to flatten."""
    kinds = dict(df.dtypes)
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            data = [np.asarray(b.column(len(keys) + k).flatten(), float).reshape(b.num_rows, -1) for k in range(len(arrays))]
            out = kernel(*data)
            size = max(x.shape[1] for x in out)
            at = pa.array(np.repeat(np.arange(b.num_rows), size))
            made = [pa.array(np.ascontiguousarray(np.broadcast_to(x, (b.num_rows, size))).ravel()) for x in out]
            yield pa.RecordBatch.from_arrays([b.column(k).take(at) for k in range(len(keys))] + made, [*keys, *names])

    return df.select(*keys, *arrays).mapInArrow(run, ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [fields]))


def _decimated(samples: DataFrame, step: int) -> DataFrame:
    """Both parts of a complex signal by the recursive filter without delay."""
    one = lambda c: recursive.decimate_zero_phase(samples.select("channel", "sample_idx", F.col(c).alias("x")), step).withColumnRenamed("y", c)
    return one("re").join(one("im"), ["channel", "sample_idx"])


def spectra(samples: DataFrame, length: int, step: int, bins: int, rate_hz: float = 1.0, mean: bool = False, decimation: int = 1, floor: float = 1e-20, path: str | None = None) -> DataFrame:
    """DSP-05, DSP-04, WIN-05: (channel, start, k, hz, db): a spectrum a stripe of a complex signal (channel, sample_idx, re, im), lowest frequency first.

    The spectrum is the mean over pieces of bins samples, half overlapping, with a Hann window and spectrum scaling; mean takes each piece's mean
    off. A stripe with a gap has NaN in every bin, those without any sample too, between a channel's first and last. decimation filters the channel
    first, runs between gaps apart, so length and step count decimated samples; start counts the input's. The filtered signal is written to path.
    """
    if not 0 < bins <= length:
        raise ValueError("a stripe holds a piece")
    if decimation > 1:
        if path is None:
            raise ValueError("a filtered signal is written, as it is read twice")
        filtered = _decimated(samples, decimation)
        filtered.write.parquet(path)
        samples = samples.sparkSession.read.schema(filtered.schema).parquet(path)
    low, hop = -(bins // 2), bins - bins // 2

    def kernel(re: np.ndarray, im: np.ndarray) -> list[np.ndarray]:
        w = window("hann", bins)
        total = np.zeros((len(re), bins))
        at = range(0, length - bins + 1, hop)
        for a in at:
            z = re[:, a : a + bins] + 1j * im[:, a : a + bins]
            total += np.abs(np.fft.fft((z - z.mean(axis=1, keepdims=True) if mean else z) * w)) ** 2
        p = np.fft.fftshift(total / len(at), axes=1) / w.sum() ** 2
        return [np.arange(low, low + bins, dtype=np.int64)[None], 10 * np.log10(p + floor)]

    cut = stripes(samples, ["re", "im"], length, step)
    good = over(cut.where("whole"), ["channel", "stripe"], ["re", "im"], kernel, "k long, db double")
    bad = cut.where("not whole").select("channel", "stripe").unionByName(absent(samples, length, step))
    axis = F.explode(F.sequence(F.lit(low).cast("long"), F.lit(low + bins - 1).cast("long")))
    out = good.unionByName(bad.select("channel", "stripe", axis.alias("k"), F.lit(float("nan")).alias("db")))
    hz = F.col("k") * F.lit(rate_hz / decimation / bins)
    return out.select("channel", (F.col("stripe") * step * decimation).alias("start"), "k", hz.alias("hz"), "db")
