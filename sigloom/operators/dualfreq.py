"""Two coherent frequencies of one beacon: phase steps of stripes, electron content by runs without a break, scintillation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions.signal import tec_per_cycle, window as window_of
from sigloom.functions.timebase import div
from sigloom.operators.catalog import places
from sigloom.operators.filters import STRETCH, with_halo
from sigloom.operators.stripes import over, stripes


def phase_steps(samples: DataFrame, window: int, count: int, overlap: int, ratio: float) -> DataFrame:
    """DSP-20, AGG-12: (channel, stripe, step, spread, snr0, snr1) of whole stripes of samples (channel, sample_idx, re0, im0, re1, im1).

    A stripe has count Hann windows, overlap of them to a window's length, and one more to compare the last with. step is the mean turn
    of bin 0 from a window to the next, of the lower frequency times ratio less that of the upper; spread the sum of both turns' variances; snr bin 0's power
    over the median of all bins. Stripes with a gap give no row.
    """
    if window < 1 or count < 1 or overlap < 1 or window % overlap:
        raise ValueError("windows overlap by a whole share")
    hop = window // overlap

    def one(re: np.ndarray, im: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pieces = np.lib.stride_tricks.sliding_window_view(re + 1j * im, window, axis=1)[:, ::hop]
        f = np.fft.fft(pieces * window_of("hann", window))
        power = (np.abs(f[:, :count]) ** 2).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            snr = power[:, 0] / np.median(power, axis=1)
        return np.angle(f[:, :-1, 0] * np.conj(f[:, 1:, 0])), snr

    def kernel(re0: np.ndarray, im0: np.ndarray, re1: np.ndarray, im1: np.ndarray) -> list[np.ndarray]:
        (a, snr0), (b, snr1) = one(re0, im0), one(re1, im1)
        return [x[:, None] for x in (a.mean(axis=1) * ratio - b.mean(axis=1), a.var(axis=1) + b.var(axis=1), snr0, snr1)]

    parts = ["re0", "im0", "re1", "im1"]
    cut = stripes(samples, parts, count * hop + window, (count - 1) * hop + window).where("whole")
    return over(cut, ["channel", "stripe"], parts, kernel, "step double, spread double, snr0 double, snr1 double")


def run_sums(rows: DataFrame, values: list[str], order: str = "stripe", span: int = STRETCH) -> DataFrame:
    """rows with run, where the unbroken run of order that a row is in begins, and each value's sum since then in its place.

    Sums go within stretches of span first; one row a stretch, with its last run's start and sums, then meets in a channel's window.
    """
    stretch = Window.partitionBy("channel", "_s").orderBy(order)
    part = rows.withColumn("_s", div(F.col(order), span)).withColumn("_g", F.col(order) - F.row_number().over(stretch))
    own = Window.partitionBy("channel", "_s", "_g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    part = part.select("*", F.min(order).over(own).alias("run"), *[F.sum(v).over(own).alias(f"_{v}") for v in values])
    runs = part.groupBy("channel", "_s", "run").agg(F.max(order).alias("end"), *[F.max_by(f"_{v}", order).alias(v) for v in values])
    edges = runs.groupBy("channel", "_s").agg(F.min("run").alias("head"), F.max(F.struct("run", "end", *values)).alias("tail"))
    by = Window.partitionBy("channel").orderBy("_s")
    edges = edges.withColumn("on", F.coalesce(F.lag("tail.end").over(by) == F.col("head") - 1, F.lit(False)))
    edges = edges.withColumn("seg", F.sum((~F.col("on") | (F.col("tail.run") != F.col("head"))).cast("long")).over(by))
    within = Window.partitionBy("channel", "seg").orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    edges = edges.select("*", F.min("tail.run").over(within).alias("_run"), *[F.sum(f"tail.{v}").over(within).alias(f"t_{v}") for v in values])
    carry = edges.select("channel", "_s", F.col("head").alias("_head"), F.lag("_run").over(by).alias("_from"), *[F.lag(f"t_{v}").over(by).alias(f"c_{v}") for v in values], "on").where("on")
    out = part.join(carry, ["channel", "_s"], "left")
    takes = F.col("run") == F.col("_head")
    kept = [c for c in rows.columns if c not in values]
    sums = [(F.col(f"_{v}") + F.when(takes, F.col(f"c_{v}")).otherwise(0.0)).alias(v) for v in values]
    return out.select(*kept, F.when(takes, F.col("_from")).otherwise(F.col("run")).alias("run"), *sums)


def medians(rows: DataFrame, value: str, path: str) -> DataFrame:
    """(channel, median) exactly, of values not null: by their places in one distributed order, written to path; no buffer holds a channel."""
    there = rows.where(F.col(value).isNotNull()).select("channel", F.col(value).alias("x"))
    placed = places(there, ["channel", "x"], path)
    spans = placed.groupBy("channel").agg(F.min("place").alias("a"), F.count(F.lit(1)).alias("n"))
    at = F.col("place") - F.col("a")
    middle = (at == div(F.col("n") - 1, 2)) | (at == div(F.col("n"), 2))
    return placed.join(spans, "channel").where(middle).groupBy("channel").agg(F.avg("x").alias("median"))


def electron_content(steps: DataFrame, path: str, f0: float, f1: float, weight: float, half: int, least: float = 0.0, span: int = STRETCH) -> DataFrame:
    """DSP-20, AGG-13: (channel, stripe, run, phase, tec, tec_sigma, s4, snr0, snr1) of phase steps; written to path on the way, as they are read again.

    Stripes whose snr of either frequency does not exceed least are left out; they and gaps end a run. In a run phase is the steps' sum, tec in
    10^16 electrons a square metre above the run's least, tec_sigma its deviation from the sum of weight times spread, and s4 the deviation of
    snr0 from half stripes before to half - 1 after, cut at the run's ends, over the channel's median snr0. A run may span any number of tasks.
    """
    spark = steps.sparkSession
    if half < 1:
        raise ValueError("a window of s4 holds a stripe")
    steps.where((F.col("snr0") > least) & (F.col("snr1") > least)).write.parquet(f"{path}/steps")
    kept = spark.read.schema(steps.schema).parquet(f"{path}/steps")
    run_sums(kept.withColumnRenamed("step", "phase"), ["phase", "spread"], span=span).write.parquet(f"{path}/runs")
    sums = spark.read.parquet(f"{path}/runs").withColumn("_s", div(F.col("stripe"), span))
    # a run's least phase: of its stretches first, so that a long run is not one key
    lows = sums.groupBy("channel", "run", "_s").agg(F.min("phase").alias("low"))
    lows = lows.withColumn("low", F.min("low").over(Window.partitionBy("channel", "run")))
    frame = Window.partitionBy("channel", "run", "stretch").orderBy("sample_idx").rangeBetween(-half, half - 1)
    placed = with_halo(sums.withColumnRenamed("stripe", "sample_idx"), half, half - 1, span)
    rolled = placed.withColumn("sd", F.stddev_pop("snr0").over(frame)).where("own").withColumnRenamed("sample_idx", "stripe").drop("stretch", "own")
    out = rolled.join(lows, ["channel", "run", "_s"]).join(medians(kept, "snr0", f"{path}/places"), "channel")
    scale = tec_per_cycle(f0, f1) * f0 / f1 / (2 * math.pi)
    return out.select(
        "channel", "stripe", "run", "phase", (scale * (F.col("phase") - F.col("low"))).alias("tec"), (scale * F.sqrt(weight * F.col("spread"))).alias("tec_sigma"),
        (F.col("sd") / F.col("median")).alias("s4"), "snr0", "snr1",
    )
