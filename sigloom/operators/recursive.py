"""Recursive filters over long signals: states as affine maps, composed over stretches, so that one run of samples is many tasks.
Runs of less than a stretch go through the filter side by side, many to a matrix.

A filter's state after a stretch is M s + b, with s the state before it, M a power of the filter's matrix and b what the stretch alone leaves. These
maps compose in any grouping: those of SPAN stretches first, of a run's spans then, and back down to the state at the start of each stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions.timebase import div, floor_div
from sigloom.operators.blocks import STRETCH, islands

#: Samples of a stretch, stretches of a span, samples of a step within a stretch.
LENGTH, SPAN, STEP = 1 << 14, 1 << 12, 64
#: Numbers of a matrix of runs.
CELLS = 1 << 18


class Cascade:
    """Second-order sections (b0, b1, b2, a1, a2) as one linear system: state' = a state + b x, y = c state + d x."""

    def __init__(self, sections: list[tuple[float, float, float, float, float]]):
        self.sections, n = sections, 2 * len(sections)
        self.a, self.b, self.c, self.d = np.zeros((n, n)), np.zeros(n), np.zeros(n), 1.0
        for k, (b0, b1, b2, a1, a2) in enumerate(sections):
            own = slice(2 * k, 2 * k + 2)
            feed, self_ = np.array([b1 - a1 * b0, b2 - a2 * b0]), np.array([[-a1, 1.0], [-a2, 0.0]])
            self.a[own] = np.outer(feed, self.c)
            self.a[own, own] = self_
            self.b[own] = feed * self.d
            self.c = self.c * b0
            self.c[2 * k] += 1.0
            self.d *= b0
        #: The state that a constant 1 keeps.
        self.steady = np.linalg.solve(np.eye(n) - self.a, self.b)
        self._known: dict[int, tuple] = {}

    def power(self, n: int) -> np.ndarray:
        return np.linalg.matrix_power(self.a, n)

    def free(self, n: int) -> np.ndarray:
        """What a state alone puts out over n samples, by state."""
        out, row = np.empty((n, len(self.b))), self.c.copy()
        for k in range(n):
            out[k] = row
            row = row @ self.a
        return out

    def _of_step(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For steps of n samples: what states put out, what samples put out, the state that samples leave, and what becomes of a state."""
        if n not in self._known:
            free = self.free(n)
            impulse = np.concatenate([[self.d], free[:-1] @ self.b])
            late = np.arange(n)[:, None] - np.arange(n)[None, :]
            powers = [self.b]
            for _ in range(n - 1):
                powers.append(self.a @ powers[-1])
            self._known[n] = free, np.where(late >= 0, impulse[np.maximum(late, 0)], 0.0).T, np.array(powers[::-1]), self.power(n)
        return self._known[n]

    def rows(self, x: np.ndarray) -> np.ndarray:
        """y of each row of x by itself, from the state that its first sample would have kept. A row is one step, or steps of STEP samples."""
        n = min(STEP, x.shape[1])
        free, response, reach, step = self._of_step(n)
        y, state = np.empty(x.shape), x[:, :1] * self.steady
        for k in range(0, x.shape[1], n):
            u = x[:, k : k + n]
            y[:, k : k + n] = u @ response + state @ free.T
            state = state @ step.T + u @ reach
        return y

    def run(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(y, state) from a zero state: steps of STEP samples at once, then from step to step."""
        n = len(x)
        whole = np.zeros(-(-n // STEP) * STEP)
        whole[:n] = x
        u = whole.reshape(-1, STEP)
        free, response, reach, step = self._of_step(STEP)
        y = u @ response
        left, state = u @ reach, np.zeros(len(self.b))
        for k in range(len(u)):
            y[k] += free @ state
            if (k + 1) * STEP > n:
                break
            state = step @ state + left[k]
        rest = n % STEP
        for v in whole[n - rest : n] if rest else ():
            state = self.a @ state + self.b * v
        return y.reshape(-1)[:n], state


def _starts(maps: DataFrame, cascade: Cascade, span: int) -> DataFrame:
    """(channel, run, s, state) at the start of each stretch of maps (channel, run, s, n, left, first): first is a run's first sample, at s 0."""
    key = "channel string, run long"
    a, size, steady = cascade.power, len(cascade.b), cascade.steady

    def composed(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        m, b, known = np.eye(size), np.zeros(size), {}
        for n, left in zip(rows["n"], rows["left"], strict=True):
            if n not in known:
                known[n] = a(int(n))
            m, b = known[n] @ m, known[n] @ b + np.asarray(left)
        return m, b

    def whole_span(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        m, b = composed(rows.sort_values("s"))
        first = rows["first"].dropna()
        return pd.DataFrame([(keys[0], keys[1], keys[2], m.ravel(), b, first.iloc[0] if len(first) else None)], columns=["channel", "run", "span", "m", "b", "first"])

    def over_spans(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, out = rows.sort_values("span"), []
        state = steady * float(rows["first"].iloc[0])
        for span_, m, b in zip(rows["span"], rows["m"], rows["b"], strict=True):
            out.append((keys[0], keys[1], span_, state))
            state = np.asarray(m).reshape(size, size) @ state + np.asarray(b)
        return pd.DataFrame(out, columns=["channel", "run", "span", "begin"])

    def within_span(keys: tuple, rows: pd.DataFrame, begins: pd.DataFrame) -> pd.DataFrame:
        rows, out, known = rows.sort_values("s"), [], {}
        state = np.asarray(begins["begin"].iloc[0])
        for s, n, left in zip(rows["s"], rows["n"], rows["left"], strict=True):
            out.append((keys[0], keys[1], s, state))
            if n not in known:
                known[n] = a(int(n))
            state = known[n] @ state + np.asarray(left)
        return pd.DataFrame(out, columns=["channel", "run", "s", "state"])

    spanned = maps.withColumn("span", div(F.col("s"), span))
    spans = spanned.groupBy("channel", "run", "span").applyInPandas(whole_span, f"{key}, span long, m array<double>, b array<double>, first double")
    begins = spans.groupBy("channel", "run").applyInPandas(over_spans, f"{key}, span long, begin array<double>")
    by = ["channel", "run", "span"]
    return spanned.groupBy(*by).cogroup(begins.groupBy(*by)).applyInPandas(within_span, f"{key}, s long, state array<double>")


def _kept(df: DataFrame, path: str | None, name: str) -> DataFrame:
    """df, written to path and read back if there is one: it is made once, however often the plan that follows holds it."""
    if path is None:
        return df
    df.write.parquet(f"{path}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")


def _filtered(chunks: DataFrame, cascade: Cascade, span: int, path: str | None = None) -> DataFrame:
    """chunks (channel, run, s, last, x) of runs, x an array; the same with x filtered, from the state that a run's first sample would have kept."""
    kinds = "channel string, run long, s long, last long, x array<double>"

    def alone(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [cascade.run(np.asarray(x)) for x in f["x"]]
            yield f.assign(n=[len(x) for x in f["x"]], first=[float(x[0]) if s == 0 else None for x, s in zip(f["x"], f["s"], strict=True)], x=[y for y, _ in made], left=[s for _, s in made])

    def joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free = np.empty((0, len(cascade.b)))
        for f in frames:
            longest = max(map(len, f["x"]), default=0)
            free = free if len(free) >= longest else cascade.free(longest)
            f["x"] = [np.asarray(x) + free[: len(x)] @ np.asarray(s) for x, s in zip(f["x"], f["state"], strict=True)]
            yield f[["channel", "run", "s", "last", "x"]]

    solo = _kept(chunks.mapInPandas(alone, f"{kinds}, n long, first double, left array<double>"), path, "alone")
    starts = _starts(solo.select("channel", "run", "s", "n", "left", "first"), cascade, span)
    both = solo.join(starts, ["channel", "run", "s"]).select("channel", "run", "s", "last", "x", "state")
    return both.mapInPandas(joined, kinds)


def _side_by_side(idx: np.ndarray, x: np.ndarray, cascade: Cascade, pad: int) -> np.ndarray:
    """y of samples in the order of idx, whose runs are all whole: runs of about the same length are rows of a matrix, at most CELLS cells at a time."""
    begins = np.flatnonzero(np.concatenate([[True], idx[1:] != idx[:-1] + 1]))
    n = np.diff(np.append(begins, len(idx)))
    p = np.minimum(pad, n - 1)
    most, y = n + 2 * p, np.empty(len(x))
    width = np.maximum(8, 1 << np.ceil(np.log2(most)).astype(int))
    for w in np.unique(width):
        of_width = np.flatnonzero(width == w)
        for k in range(0, len(of_width), max(1, CELLS // w)):
            own = of_width[k : k + max(1, CELLS // w)]
            first, size, ends, last = begins[own, None], n[own, None], p[own, None], most[own, None] - 1
            at = np.arange(w)[None, :]
            j = at - ends
            # the run, mirrored through its end points; nothing after that
            inner = np.clip(np.where(j < 0, -j, np.where(j < size, j, 2 * (size - 1) - j)), 0, size - 1)
            u = x[first + inner]
            u = np.where(j < 0, 2 * x[first] - u, np.where(j < size, u, np.where(at <= last, 2 * x[first + size - 1] - u, 0.0)))
            back = np.maximum(last - at, 0)
            for _ in range(2):
                u = np.where(at <= last, np.take_along_axis(cascade.rows(u), back, 1), 0.0)
            inside = (j >= 0) & (j < size)
            y[(first + j)[inside]] = u[inside]
    return y


def _with_runs(samples: DataFrame, runs: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """samples (channel, sample_idx, x) with the run and the n of the run (channel, run, n) that holds them: the last to start at or before them in their stretch."""
    reach = runs.withColumn("stretch", F.explode(F.sequence(floor_div(F.col("run"), stretch), floor_div(F.col("run") + F.col("n") - 1, stretch))))
    starts = reach.select("channel", "stretch", F.greatest("run", F.col("stretch") * stretch).alias("sample_idx"), F.lit(None).cast("double").alias("x"), F.struct("run", "n").alias("of"), F.lit(0).alias("own"))
    rows = samples.select("channel", floor_div(F.col("sample_idx"), stretch).alias("stretch"), "sample_idx", F.col("x").cast("double").alias("x"), F.lit(None).cast("struct<run:bigint,n:bigint>").alias("of"), F.lit(1).alias("own"))
    w = Window.partitionBy("channel", "stretch").orderBy("sample_idx", "own")
    held = starts.unionByName(rows).withColumn("of", F.last("of", ignorenulls=True).over(w)).where("own = 1")
    return held.select("channel", "sample_idx", "x", F.col("of.run").alias("run"), F.col("of.n").alias("n"))


def zero_phase(samples: DataFrame, sections: list[tuple], pad: int | None = None, length: int = LENGTH, span: int = SPAN, path: str | None = None) -> DataFrame:
    """DSP-09: (channel, sample_idx, y) of samples (channel, sample_idx, x) filtered forward and backward, so without delay; runs between gaps are apart.

    A run is first continued by pad samples at both ends, mirrored through its end points (by default 3 times the filter's coefficients, at most what it
    has), and begins in the state that its first such sample would have kept. Stretches of length samples are rows; of a run's
    stretches only states of a few numbers meet, span of them at a time, then one a span. Runs of at most length samples with their ends
    are filtered whole, those that begin in the same length indexes together. path, a new folder that all machines share, keeps the samples with their runs and what is known
    of stretches, so that each is made once; without it all is one plan.
    """
    cascade = Cascade(sections)
    pad = 3 * (2 * len(sections) + 1) if pad is None else pad
    held = _kept(_with_runs(samples, islands(samples).withColumnRenamed("block_start", "run")), path, "held")
    j, n, x = F.col("sample_idx") - F.col("run"), F.col("n"), F.col("x")
    p = F.least(F.lit(pad), n - 1)
    short = n + 2 * p <= length

    def whole(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sample_idx")
        idx, values = rows["sample_idx"].to_numpy(), rows["x"].to_numpy(dtype=float)
        return pd.DataFrame({"channel": rows["channel"], "sample_idx": idx, "y": _side_by_side(idx, values, cascade, pad)})

    together = held.where(short).select("channel", div(F.col("run"), length).alias("s"), "sample_idx", "x").groupBy("channel", "s")
    alone = together.applyInPandas(whole, "channel string, sample_idx long, y double")
    placed = held.where(~short)
    if path is not None and placed.isEmpty():
        return alone
    runs = placed.where(F.col("sample_idx") == F.col("run")).select("channel", "run", "n")
    ends = placed.groupBy("channel", "run").agg(F.min_by("x", "sample_idx").alias("x0"), F.max_by("x", "sample_idx").alias("x1"))
    own = placed.select("channel", "run", n, p.alias("p"), (j + p).alias("i"), "x")
    edge = placed.where((j <= pad) | (n - 1 - j <= pad)).join(ends, ["channel", "run"])
    front = edge.where((j >= 1) & (j <= p)).select("channel", "run", n, p.alias("p"), (p - j).alias("i"), (2 * F.col("x0") - x).alias("x"))
    back = edge.where((n - 1 - j >= 1) & (n - 1 - j <= p)).select("channel", "run", n, p.alias("p"), (p + 2 * (n - 1) - j).alias("i"), (2 * F.col("x1") - x).alias("x"))
    every = own.unionByName(front).unionByName(back)
    rows = every.withColumn("s", div(F.col("i"), length)).groupBy("channel", "run", "s").agg(F.max(div(n + 2 * F.col("p") - 1, length)).alias("last"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("r"))
    chunks = rows.select("channel", "run", "s", "last", F.transform("r", lambda v: v["x"]).alias("x"))
    # back to front: stretches and their samples in reverse
    turned = lambda c: c.select("channel", "run", (F.col("last") - F.col("s")).alias("s"), "last", F.reverse("x").alias("x"))
    forward = _filtered(chunks, cascade, span, path and f"{path}/forward")
    both = turned(_filtered(turned(forward), cascade, span, path and f"{path}/backward"))
    out = both.join(runs, ["channel", "run"]).select("channel", "run", "n", "s", F.posexplode("x").alias("k", "y"))
    at = F.col("s") * length + F.col("k") - F.least(F.lit(pad), n - 1)
    return alone.unionByName(out.where((at >= 0) & (at < n)).select("channel", (F.col("run") + at).alias("sample_idx"), "y"))


def decimate_zero_phase(samples: DataFrame, step: int, order: int = 8, ripple_db: float = 0.05, length: int = LENGTH, span: int = SPAN, path: str | None = None) -> DataFrame:
    """DSP-09: every step-th sample by index, after a Chebyshev low-pass of 0.8 / step of the band, forward and backward; numbered by index / step."""
    from sigloom.functions.signal import chebyshev

    y = zero_phase(samples, chebyshev(order, ripple_db, 0.8 / step), length=length, span=span, path=path)
    return y.where(F.col("sample_idx") % step == 0).select("channel", div(F.col("sample_idx"), step).alias("sample_idx"), "y")
