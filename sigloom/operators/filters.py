"""Finite filters and rolling statistics over a long signal (sample_idx, x), in stretches with halos."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions.timebase import div

#: Samples of a stretch; neighbours' edges are copied to it.
STRETCH = 1 << 14


def with_halo(samples: DataFrame, before: int, after: int, stretch: int = STRETCH) -> DataFrame:
    """samples with stretch and own: each also goes to the stretches whose halo it is in, so windows by stretch are exact and run apart."""
    i = F.col("sample_idx")
    first, last = div(i - after, stretch), div(i + before, stretch)
    return samples.withColumn("stretch", F.explode(F.sequence(F.greatest(first, F.lit(0).cast("long")), last))).withColumn("own", F.col("stretch") == div(i, stretch))


def fir(samples: DataFrame, taps: list[float], stretch: int = STRETCH, by: tuple[str, ...] = ()) -> DataFrame:
    """DSP-08, DSP-09: y[i] = sum taps[k] x[i + k], where all of those samples are there; none over a gap. Signals told by the columns by are apart."""
    w = Window.partitionBy(*by, "stretch").orderBy("sample_idx")
    terms = [F.lead("x", k).over(w) * F.lit(float(t)) if k else F.col("x") * F.lit(float(t)) for k, t in enumerate(taps)]
    y = terms[0]
    for t in terms[1:]:
        y = y + t
    whole = F.lead("sample_idx", len(taps) - 1).over(w) == F.col("sample_idx") + (len(taps) - 1)
    return with_halo(samples, 0, len(taps) - 1, stretch).withColumn("y", F.when(whole, y)).where("own and y is not null").select(*by, "sample_idx", "y")


def correlate(samples: DataFrame, code: list[float], stretch: int = STRETCH) -> DataFrame:
    """DSP-08: y[i] = sum code[k] x[i + k] for every sample, lag 0 aligned; samples that are not there, past the ends or in gaps, count as 0."""
    n = len(code)
    taps = F.array(*[F.lit(float(c)) for c in code])
    near = F.collect_list(F.struct("sample_idx", "x")).over(Window.partitionBy("stretch").orderBy("sample_idx").rangeBetween(0, n - 1))
    total = F.aggregate("near", F.lit(0.0), lambda a, s: a + s["x"] * F.get(taps, (s["sample_idx"] - F.col("sample_idx")).cast("int")))
    return with_halo(samples, 0, n - 1, stretch).withColumn("near", near).where("own").select("sample_idx", total.alias("y"))


def decimate(samples: DataFrame, taps: list[float], step: int) -> DataFrame:
    """DSP-09: filtered, every step-th kept and numbered."""
    return fir(samples, taps).where(F.col("sample_idx") % step == 0).select(div(F.col("sample_idx"), step).alias("sample_idx"), "y")


def decimate_centred(samples: DataFrame, taps: list[float], step: int) -> DataFrame:
    """DSP-09, DSP-12: filtered by an odd number of symmetric taps without their delay: the value at an index is of the taps around it; every step-th is kept."""
    if len(taps) % 2 == 0:
        raise ValueError("a filter has a middle tap")
    at = F.col("sample_idx") + len(taps) // 2
    return fir(samples, taps).where(at % step == 0).select(div(at, step).alias("sample_idx"), "y")


def _scatter(samples: DataFrame, first: Column, last: Column) -> DataFrame:
    return samples.withColumn("m", F.explode(F.sequence(F.greatest(first, F.lit(0).cast("long")), last)))


def resample(samples: DataFrame, up: int, down: int, taps: list[float]) -> DataFrame:
    """DSP-12: y[m] = sum x[i] taps[m down - i up]: each sample goes to the outputs it reaches; sums are combined before the shuffle."""
    i = F.col("sample_idx")
    n = len(taps)
    k = F.col("m") * down - i * up
    placed = _scatter(samples, div(i * up + down - 1, down), div(i * up + n - 1, down))
    tap = F.get(F.array(*map(F.lit, map(float, taps))), k.cast("int"))
    return placed.groupBy(F.col("m").alias("sample_idx")).agg(F.sum(F.col("x") * tap).alias("y"))


def channelize(samples: DataFrame, bands: int, taps: list[float]) -> DataFrame:
    """DSP-13: (sample_idx, band, re, im): sub-bands of width 1/bands, each shifted to zero, filtered and kept every bands-th."""
    i = F.col("sample_idx")
    placed = _scatter(samples, div(i - len(taps) + bands, bands), div(i, bands))
    tap = F.get(F.array(*map(F.lit, map(float, taps))), (i - F.col("m") * bands).cast("int"))
    sums = []
    for b in range(bands):
        angle = -2 * math.pi * b / bands * (i % bands).cast("double")
        sums += [F.sum(F.col("x") * tap * F.cos(angle)).alias(f"re{b}"), F.sum(F.col("x") * tap * F.sin(angle)).alias(f"im{b}")]
    wide = placed.groupBy(F.col("m").alias("sample_idx")).agg(*sums)
    both = F.array(*[F.struct(F.lit(b).cast("long").alias("band"), F.col(f"re{b}").alias("re"), F.col(f"im{b}").alias("im")) for b in range(bands)])
    return wide.select("sample_idx", F.explode(both).alias("c")).select("sample_idx", "c.*")


def running_sum(samples: DataFrame, value: str, stretch: int = STRETCH) -> DataFrame:
    """WIN-04: the sum up to each sample: within stretches, plus the total of the stretches before (one row each)."""
    part = samples.withColumn("stretch", div(F.col("sample_idx"), stretch))
    totals = part.groupBy("stretch").agg(F.sum(value).alias("_t"))
    before = totals.select("stretch", F.sum("_t").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)).alias("_b"))
    own = F.sum(value).over(Window.partitionBy("stretch").orderBy("sample_idx"))
    return part.withColumn("_o", own).join(before, "stretch").select("sample_idx", (F.col("_o") + F.coalesce("_b", F.lit(0.0))).alias("total"))


def phase_steps(samples: DataFrame, phase: str, stretch: int = STRETCH) -> DataFrame:
    """WIN-03: each phase's difference to the one before, wrapped to (-pi, pi]; 0 at the first and after a gap. Their running sum is the unwrapped phase."""
    w = Window.partitionBy("stretch").orderBy("sample_idx")
    d = F.col(phase) - F.lag(phase).over(w)
    next_ = F.lag("sample_idx").over(w) == F.col("sample_idx") - 1
    wrapped = F.when(next_, d - 2 * math.pi * F.ceil((d - math.pi) / (2 * math.pi)))
    return with_halo(samples, 1, 0, stretch).withColumn("step", F.coalesce(wrapped, F.lit(0.0))).where("own").select("sample_idx", "step")


def exact_median(samples: DataFrame, column: str, few: int = 1 << 16) -> float | None:
    """The median of all values that are neither null nor NaN: brackets narrowed by approximate percentiles until few values are left; counts and few values reach the driver."""
    x = F.col(column).cast("double")
    rows = samples.where(x.isNotNull() & ~F.isnan(x)).select(x.alias("x"))
    n = rows.count()
    if not n:
        return None
    wanted = {(n - 1) // 2, n // 2}
    below, left = 0, rows
    while True:
        held = left.count()
        if held <= few:
            got = sorted(r["x"] for r in left.collect())
            return sum(got[k - below] for k in sorted(wanted)) / len(wanted)
        share = [max(0.0, (min(wanted) - below) / held - 0.01), min(1.0, (max(wanted) - below + 1) / held + 0.01)]
        low, high = left.agg(F.percentile_approx("x", share, 10_000)).first()[0]
        less, over = left.agg(F.count_if(F.col("x") < low), F.count_if(F.col("x") > high)).first()
        if not below + less <= min(wanted) or not max(wanted) < below + held - over:
            low, high, less, over = None, None, 0, 0
        if low == high and low is not None:
            return low
        if low is None or less + over == 0:
            # an unlucky bracket, or few different values: the exact percentiles of what is left
            at = [(k - below) / max(1, held - 1) for k in sorted(wanted)]
            return sum(left.agg(F.percentile("x", F.array(*map(F.lit, at)))).first()[0]) / len(wanted)
        left, below = left.where(F.col("x").between(low, high)), below + less


def rolling_s4(samples: DataFrame, half: int, stretch: int = STRETCH, clamped: bool = False) -> DataFrame:
    """AGG-13, WIN-06: standard deviation over the indexes from half before to half - 1 after, over the signal's median.

    The frame is cut at the ends, or, clamped, the first and last sample stand for those beyond them. Samples that are missing in gaps are left out.
    """
    w = Window.partitionBy("stretch").orderBy("sample_idx").rangeBetween(-half, half - 1)
    placed = with_halo(samples, half, half - 1, stretch)
    middle = F.lit(exact_median(samples, "x")).cast("double")
    if not clamped:
        return placed.withColumn("sd", F.stddev_pop("x").over(w)).where("own").select("sample_idx", (F.col("sd") / middle).alias("s4"))
    ends = samples.agg(F.min("sample_idx").alias("lo"), F.max("sample_idx").alias("hi"), F.min_by("x", "sample_idx").alias("xl"), F.max_by("x", "sample_idx").alias("xh"))
    sums = placed.select("sample_idx", "own", *[f.over(w).alias(a) for f, a in ((F.count("x"), "k"), (F.avg("x"), "m"), (F.var_pop("x"), "v"))]).where("own")
    sums = sums.crossJoin(F.broadcast(ends))
    i = F.col("sample_idx")
    before, after = F.greatest(F.lit(0), F.col("lo") - (i - half)), F.greatest(F.lit(0), i + (half - 1) - F.col("hi"))
    n = F.col("k") + before + after
    mean = (F.col("k") * F.col("m") + before * F.col("xl") + after * F.col("xh")) / n
    apart = lambda c: (F.col(c) - mean) * (F.col(c) - mean)
    spread = (F.col("k") * (F.col("v") + apart("m")) + before * apart("xl") + after * apart("xh")) / n
    return sums.select("sample_idx", (F.sqrt(spread) / middle).alias("s4"))


def robust_lines(points: DataFrame, rounds: int = 10, sigmas: float = 2.0) -> DataFrame:
    """DSP-19 for each channel of points (channel, t, y, w): channel, slope, intercept. A row a channel and round reaches the driver."""
    spark = points.sparkSession
    schema = f"c {dict(points.dtypes)['channel']}, slope double, intercept double, most double"
    lines = {r[0]: (0.0, 0.0, None) for r in points.select("channel").distinct().collect()}
    live = set(lines)
    t, y, w = F.col("t"), F.col("y"), F.col("w")

    def against(channels: set) -> DataFrame:
        now = spark.createDataFrame([(c, *lines[c]) for c in channels], schema)
        return points.join(F.broadcast(now), points["channel"].eqNullSafe(now["c"])).withColumn("miss", y - (t * F.col("slope") + F.col("intercept")))

    for _ in range(rounds):
        if not live:
            break
        use = against(live).where("most is null or abs(miss) <= most")
        sums = use.groupBy("channel").agg(F.sum("w").alias("w"), F.sum(w * t).alias("t"), F.sum(w * y).alias("y"), F.sum(w * t * t).alias("tt"), F.sum(w * t * y).alias("ty")).collect()
        fitted = set()
        for s in sums:
            if s["w"] and (det := s["w"] * s["tt"] - s["t"] ** 2):
                slope = (s["w"] * s["ty"] - s["t"] * s["y"]) / det
                lines[s["channel"]] = (slope, (s["y"] - slope * s["t"]) / s["w"], None)
                fitted.add(s["channel"])
        live = set()
        if fitted:
            for c, spread in against(fitted).groupBy("channel").agg(F.stddev_pop("miss")).collect():
                if spread:
                    lines[c] = (*lines[c][:2], sigmas * spread)
                    live.add(c)
    return spark.createDataFrame([(c, a, b) for c, (a, b, _) in lines.items()], f"channel {dict(points.dtypes)['channel']}, slope double, intercept double")


def robust_line(points: DataFrame, rounds: int = 10, sigmas: float = 2.0) -> tuple[float, float]:
    """DSP-19: slope and intercept of y over t by weighted least squares; each round leaves out what lies sigmas away. Five sums a round reach the driver."""
    slope = offset = 0.0
    limit: float | None = None
    for _ in range(rounds):
        miss = F.abs(F.col("y") - (F.col("t") * slope + offset))
        use = points if limit is None else points.where(miss <= limit)
        s = use.agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("t")).alias("t"), F.sum(F.col("w") * F.col("y")).alias("y"), F.sum(F.col("w") * F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("w") * F.col("t") * F.col("y")).alias("ty")).first()
        if not s["w"] or not (det := s["w"] * s["tt"] - s["t"] ** 2):
            break
        slope = (s["w"] * s["ty"] - s["t"] * s["y"]) / det
        offset = (s["y"] - slope * s["t"]) / s["w"]
        spread = points.agg(F.stddev_pop(F.col("y") - (F.col("t") * slope + offset))).first()[0]
        if not spread:
            break
        limit = sigmas * spread
    return slope, offset
