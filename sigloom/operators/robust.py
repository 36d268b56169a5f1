"""Robust polynomial curves: least squares of every channel at once from moment sums, outliers rejected for good by the slope of the residual."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions.timebase import div
from sigloom.operators.filters import STRETCH


def legendre(t: Column, terms: int) -> list[Column]:
    """The first Legendre polynomials at t in -1..1, nearly orthogonal over many points, so that sums of their products can be solved well."""
    out = [F.lit(1.0), t]
    for n in range(1, terms - 1):
        out.append((t * out[n] * float(2 * n + 1) - out[n - 1] * float(n)) / float(n + 1))
    return out[:terms]


def _along() -> Column:
    """Where a point lies in -1..1."""
    return F.when(F.col("n") == 1, -1.0).otherwise(-1 + 2 * F.col("k") / (F.col("n") - 1))


def _solved(terms: int):
    """Coefficients of each row's normal equations: sums g of products (upper half, by rows) and r with the values; the least ones where they do not say all."""
    upper = np.triu_indices(terms)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for g, r in zip(f["g"], f["r"], strict=True):
                m = np.zeros((terms, terms))
                m[upper] = np.asarray(g)
                m = m + np.triu(m, 1).T
                out.append(np.linalg.lstsq(m, np.asarray(r), rcond=None)[0])
            yield pd.DataFrame({"channel": f["channel"], "c": out})

    return run


def _fit(points: DataFrame, terms: int, weight: str) -> DataFrame:
    """points with fit. Rejected points weigh nothing. The polynomials are made anew after the join, as they are many times a point's own size."""
    kind = dict(points.dtypes)["channel"]
    at_points = lambda x: x.withColumn("_t", _along()).withColumn("_p", F.array(*legendre(F.col("_t"), terms))).drop("_t")
    p = at_points(points)
    own = F.when(F.col("gone"), 0.0).otherwise(F.col(weight))
    at = lambda i: F.get("_p", F.lit(i))
    g = [F.sum(own * at(i) * at(j)) for i in range(terms) for j in range(i, terms)]
    sums = p.groupBy("channel").agg(F.array(*g).alias("g"), F.array(*[F.sum(own * at(i) * F.col("y")) for i in range(terms)]).alias("r"))
    solved = sums.mapInPandas(_solved(terms), f"channel {kind}, c array<double>").withColumnRenamed("channel", "_of")
    joined = at_points(points.join(solved, points["channel"].eqNullSafe(solved["_of"])))
    fit = F.aggregate(F.zip_with("_p", "c", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return joined.withColumn("fit", fit).drop("_p", "c", "_of")


def _sloped(points: DataFrame, stretch: int) -> DataFrame:
    """points with slope: the central difference of fit less the value (0 for rejected points), one-sided at a channel's ends."""
    k = F.col("k")
    near = F.sequence(F.greatest(div(k - 1, stretch), F.lit(0).cast("long")), F.least(div(k + 1, stretch), div(F.col("n") - 1, stretch)))
    dealt = points.withColumn("_s", F.explode(near))
    w = Window.partitionBy("channel", "_s").orderBy("k")
    # of columns as they are, so that no residual is sent along beside what it is made of
    left = lambda of: of("fit") - F.when(of("gone"), 0.0).otherwise(of("y"))
    before, own, after = left(lambda c: F.lag(c).over(w)), left(F.col), left(lambda c: F.lead(c).over(w))
    slope = F.when(F.col("n") == 1, 0.0).when(k == 0, after - own).when(k == F.col("n") - 1, own - before).otherwise((after - before) / 2)
    return dealt.withColumn("slope", slope).where(F.col("_s") == div(k, stretch)).drop("_s")


def polynomials(points: DataFrame, path: str, rounds: int = 10, terms: int = 7, sigmas: float = 2.0, weight: str | None = None, stretch: int = STRETCH) -> DataFrame:
    """DSP-19: points (channel, k, y[, weight]) with fit and gone, by a polynomial of terms coefficients for each channel.

    k counts a channel's points from 0 without gaps; they lie evenly in -1..1. Each round fits what is left, and rejects for good where the
    slope of fit less value is over sigmas standard deviations of all slopes; a rejected value counts as 0 there, so its neighbours may go next. It
    ends after rounds, or when nothing more is rejected; the fit is the last round's. All channels go through a round together: two sums a channel and a
    window by stretch. path is a new folder that all machines share; each round's rejections are written there. A channel of one point keeps it.
    """
    spark = points.sparkSession
    last = F.max("k").alias("n")
    ends = points.groupBy("channel").agg(last).select(F.col("channel").alias("_c"), (F.col("n") + 1).alias("n"))
    own = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    now = points.join(ends, points["channel"].eqNullSafe(ends["_c"])).select("channel", "k", F.col("y").cast("double").alias("y"), "n", own.alias("w"), F.lit(False).alias("gone"))
    now.write.parquet(f"{path}/0")
    for k in range(1, rounds + 1):
        now = spark.read.parquet(f"{path}/{k - 1}").select("channel", "k", "y", "n", "w", "gone")
        sloped = _sloped(_fit(now, terms, "w"), stretch)
        spread = sloped.groupBy("channel").agg(F.stddev_pop("slope").alias("sd")).withColumnRenamed("channel", "_c")
        both = sloped.join(spread, sloped["channel"].eqNullSafe(spread["_c"]))
        more = F.abs("slope") > F.lit(sigmas) * F.col("sd")
        both.select("channel", "k", "y", "n", "w", "fit", (more & ~F.col("gone")).alias("new"), (F.col("gone") | more).alias("gone"), F.col("gone").alias("had")).write.parquet(f"{path}/{k}")
        held = spark.read.parquet(f"{path}/{k}")
        if not held.where("new").limit(1).count():
            break
    return held.select("channel", "k", "y", "fit", "gone")
