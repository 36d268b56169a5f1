"""Rasters and vectors: fixed-length segments of a stream, reduced, cut, tagged."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions.timebase import div

#: Named aggregates with their column expressions; take has a position.
AGGREGATES: dict[str, Callable] = {
    "mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "std": F.stddev_pop, "var": F.var_pop, "median": F.median, "prod": F.product,
    "ptp": lambda c: F.max(c) - F.min(c),
}


def aggregate_of(name: str, value: Column, order: Column, arg: int = 0) -> Column:
    """A registered aggregate; take(arg) is the arg-th value in order; any other name goes to the numpy method of the values in order."""
    if name == "take":
        return F.get(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), F.lit(arg))["v"]
    if name in AGGREGATES:
        return AGGREGATES[name](value)

    @F.pandas_udf("double")
    def method(v: pd.Series) -> pd.Series:
        return v.map(lambda x: float(getattr(np.asarray(x), name)()))

    return method(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]))


def vectors(df: DataFrame, id_col: str, array_col: str) -> DataFrame:
    """Long form (id, pos, x) of fixed-length vectors."""
    return df.select(F.col(id_col).alias("vec"), F.posexplode(array_col).alias("pos", "x")).select("vec", F.col("pos").cast("long").alias("pos"), F.col("x").cast("double").alias("x"))


def vector_aggregate(long: DataFrame, nagg: int, op: str, arg: int = 0) -> DataFrame:
    """AGG-04: every nagg consecutive vectors reduced item by item; a last partial group is left out."""
    group = div(F.col("vec"), nagg)
    out = long.groupBy(group.alias("grp"), "pos").agg(aggregate_of(op, F.col("x"), F.col("vec"), arg).alias("value"), F.count(F.lit(1)).alias("k"))
    return out.where(F.col("k") == nagg).drop("k")


def rasters(samples: DataFrame, length: int, origin: int = 0) -> DataFrame:
    """samples (sample_idx, x) with raster and pos."""
    at = F.col("sample_idx") - origin
    return samples.select(div(at, length).alias("raster"), (at % length).alias("pos"), "x")


def raster_aggregate(r: DataFrame, nagg: int, op: str, arg: int = 0) -> DataFrame:
    """AGG-03: every nagg consecutive rasters reduced position by position."""
    return vector_aggregate(r.withColumnRenamed("raster", "vec"), nagg, op, arg)


def raster_select(r: DataFrame, length: int, start: int, count: int) -> DataFrame:
    """PRJ-08: count positions from start (counted from the end when negative) of each raster, cut at its end."""
    start %= length
    return r.where((F.col("pos") >= start) & (F.col("pos") < min(start + count, length))).withColumn("pos", F.col("pos") - start)


def raster_chunk(r: DataFrame, length: int, nperseg: int, noverlap: int) -> DataFrame:
    """WIN-01: overlapping chunks of each raster, zeros beyond its end: a sample goes to each chunk it is in."""
    step = nperseg - noverlap
    n = -(-length // step)
    last = F.least(div(F.col("pos"), step), F.lit(n - 1).cast("long"))
    first = F.greatest(F.lit(0).cast("long"), div(F.col("pos") - nperseg + step, step))
    placed = r.withColumn("chunk", F.explode(F.sequence(first, last))).select("raster", "chunk", (F.col("pos") - F.col("chunk") * step).alias("at"), "x").where((F.col("at") >= 0) & (F.col("at") < nperseg))
    # positions past the raster's end, for the chunks that reach there
    tail = [(c, a) for c in range(n) for a in range(nperseg) if c * step + a >= length]
    pads = F.array(*[F.struct(F.lit(c).cast("long").alias("chunk"), F.lit(a).cast("long").alias("at")) for c, a in tail])
    if not tail:
        return placed
    zero = r.where("pos = 0").select("raster", F.explode(pads).alias("p")).select("raster", "p.chunk", "p.at", F.lit(0.0).alias("x"))
    return placed.unionByName(zero)


def raster_tags(r: DataFrame, tags: dict[int, str]) -> DataFrame:
    """WIN-08: a tag in every raster at each offset; the offsets are literals, nothing is joined."""
    keys = F.create_map(*[F.lit(v) for k, t in tags.items() for v in (k, t)])
    return r.where(F.col("pos").isin(list(tags))).select("raster", "pos", F.try_element_at(keys, F.col("pos").cast("int")).alias("tag"))


def block_average(samples: DataFrame, value: Column, modulus: int, integration: int, keep_partial: bool = False) -> DataFrame:
    """AGG-05: the mean of value at each position of modulus samples over integration windows."""
    block, pos = div(F.col("sample_idx"), modulus * integration), F.col("sample_idx") % modulus
    out = samples.groupBy(block.alias("block"), pos.alias("pos")).agg(F.avg(value).alias("value"), F.count(F.lit(1)).alias("k"))
    return (out if keep_partial else out.where(F.col("k") == integration)).drop("k")
