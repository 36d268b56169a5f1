"""Continuous blocks of samples: islands, clipping, gaps, unions of roots, vector reads."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.functions.timebase import div

#: Samples of a stretch within which islands are found before stretches of a channel are joined.
STRETCH = 1 << 16


def islands(samples: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """AGG-01: (channel, block_start, n) of maximal runs of consecutive sample_idx.

    First within stretches, so that one channel is many groups; then, over one row a run, across their edges.
    """
    part = samples.select("channel", "sample_idx", div(F.col("sample_idx"), stretch).alias("stretch"))
    w = Window.partitionBy("channel", "stretch").orderBy("sample_idx")
    runs = part.withColumn("island", F.col("sample_idx") - F.row_number().over(w)).groupBy("channel", "stretch", "island").agg(F.min("sample_idx").alias("block_start"), F.count(F.lit(1)).alias("n"))
    return merge_blocks(runs.select("channel", "block_start", "n"))


def merge_blocks(blocks: DataFrame, span: int = STRETCH) -> DataFrame:
    """Join blocks (channel, block_start, n) that touch.

    First those that start in one stretch; of the runs that this leaves only a stretch's first and last can touch others, so the window over
    a whole channel sees at most two rows a stretch.
    """
    part = blocks.select("channel", "block_start", "n", div(F.col("block_start"), span).alias("s"))
    runs = _touching(part, ["channel", "s"])
    w = Window.partitionBy("channel", "s")
    edge = (F.col("block_start") == F.min("block_start").over(w)) | (F.col("block_start") == F.max("block_start").over(w))
    runs = runs.withColumn("edge", edge)
    return runs.where("not edge").select("channel", "block_start", "n").unionByName(_touching(runs.where("edge").drop("edge", "s"), ["channel"]))


def _touching(blocks: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("block_start")
    begins = (F.col("block_start") != F.lag(F.col("block_start") + F.col("n")).over(w)) | F.lag("n").over(w).isNull()
    runs = blocks.withColumn("run", F.sum(begins.cast("long")).over(w))
    return runs.groupBy(*by, "run").agg(F.min("block_start").alias("block_start"), F.sum("n").alias("n")).drop("run")


def _reach(blocks: DataFrame, span: int = STRETCH) -> DataFrame:
    """blocks with reach: where the furthest of a channel's earlier blocks ends; null at its first. One row a stretch meets in a whole channel's window."""
    part = blocks.withColumn("s", div(F.col("block_start"), span))
    end = F.col("block_start") + F.col("n")
    ends = part.groupBy("channel", "s").agg(F.max(end).alias("e"))
    before = ends.select("channel", "s", F.max("e").over(Window.partitionBy("channel").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)).alias("b"))
    own = F.max(end).over(Window.partitionBy("channel", "s").orderBy("block_start", "n").rowsBetween(Window.unboundedPreceding, -1))
    return part.withColumn("o", own).join(before, ["channel", "s"]).withColumn("reach", F.greatest("o", "b")).drop("s", "o", "b")


def between(samples: DataFrame, first: int, last: int, file_span: int | None = None) -> DataFrame:
    """SRC-03, PRJ-03: samples of an inclusive range; with file_span the partition column file_idx is bounded too, so files are pruned."""
    if last < first:
        raise ValueError("the range ends before it starts")
    out = samples.where(F.col("sample_idx").between(first, last))
    return out if file_span is None else out.where(F.col("file_idx").between(first // file_span, last // file_span))


def clip(blocks: DataFrame, first: int, last: int) -> DataFrame:
    """PRJ-03: blocks cut to an inclusive range."""
    a, b = F.greatest("block_start", F.lit(first)), F.least(F.col("block_start") + F.col("n") - 1, F.lit(last))
    return blocks.where((F.col("block_start") <= last) & (F.col("block_start") + F.col("n") > first)).select("channel", a.alias("block_start"), (b - a + 1).alias("n"))


def bounds(samples: DataFrame) -> DataFrame:
    return samples.groupBy("channel").agg(F.min("sample_idx").alias("first_sample"), F.max("sample_idx").alias("last_sample"))


def gaps(blocks: DataFrame) -> DataFrame:
    """WIN-02: (channel, gap_start, gap_n) between blocks."""
    return _reach(blocks).select("channel", F.col("reach").alias("gap_start"), (F.col("block_start") - F.col("reach")).alias("gap_n")).where("gap_n > 0")


def gap_accounting(blocks: DataFrame) -> DataFrame:
    """AGG-14: samples held and missing by channel."""
    return blocks.groupBy("channel").agg(F.sum("n").alias("total_samples"), (F.max(F.col("block_start") + F.col("n")) - F.min("block_start") - F.sum("n")).alias("gap_samples"), F.count(F.lit(1)).alias("n_blocks"))


def fill_gaps(samples: DataFrame, channels: list[str], first: int, last: int, fill: Column) -> DataFrame:
    """SNK-06: every index of the range for every one of channels; absent values are fill. Indexes are made on the executors."""
    every = samples.sparkSession.range(first, last + 1).select(F.col("id").alias("sample_idx"), F.explode(F.array(*map(F.lit, channels))).alias("channel"))
    return every.join(samples, ["channel", "sample_idx"], "left").select("channel", "sample_idx", F.coalesce("re", fill).alias("re"), F.col("re").isNull().alias("filled"))


def fill_bounds(samples: DataFrame, fill: Column, stretch: int = STRETCH) -> DataFrame:
    """SNK-06: every index of each channel from its first to its last sample; absent values are fill. A channel is dealt out in stretches."""
    at = bounds(samples)
    part = at.select("channel", "first_sample", "last_sample", F.explode(F.sequence(div(F.col("first_sample"), stretch), div(F.col("last_sample"), stretch))).alias("stretch"))
    low, high = F.greatest("first_sample", F.col("stretch") * stretch), F.least("last_sample", (F.col("stretch") + 1) * stretch - 1)
    every = part.repartition("channel", "stretch").select("channel", F.explode(F.sequence(low, high)).alias("sample_idx"))
    return every.join(samples, ["channel", "sample_idx"], "left").select("channel", "sample_idx", F.coalesce("re", fill).alias("re"), F.col("re").isNull().alias("filled"))


def union_roots(roots: list[DataFrame]) -> DataFrame:
    """SET-01: one channel from several roots; of samples that two roots hold, the later root's."""
    out = None
    for k, r in enumerate(roots):
        r = r.withColumn("root", F.lit(k))
        out = r if out is None else out.unionByName(r)
    last = F.max(F.struct("root", "re")).alias("m")
    return out.groupBy("channel", "sample_idx").agg(last).select("channel", "sample_idx", "m.re")


def overlaps(blocks: DataFrame) -> DataFrame:
    """SRC-26: blocks of any root that start before an earlier one has ended; strict readers refuse them."""
    return _reach(blocks).where("reach > block_start").select("channel", "block_start", "n", "reach")


def read_vector(samples: DataFrame, channel: str, start: int, n: int) -> DataFrame:
    """SRC-04: exactly n samples as one array; an error when any is missing."""
    if n < 1:
        raise ValueError("a vector has at least one sample")
    got = between(samples.where(F.col("channel") == channel), start, start + n - 1)
    row = got.agg(F.count(F.lit(1)).alias("k"), F.array_sort(F.collect_list(F.struct("sample_idx", "re"))).alias("v"))
    checked = F.when(F.col("k") == n, F.transform("v", lambda x: x["re"])).otherwise(F.raise_error(F.concat(F.lit(f"{n} samples asked for, held: "), F.col("k").cast("string"))))
    return row.select(checked.alias("vector"))


#: SRC-05: smallest floating type that holds each storage type.
FLOAT_OF = {"tinyint": "float", "smallint": "float", "float": "float", "int": "double", "bigint": "double", "double": "double", "decimal(20,0)": "double"}


def _float_type(kind: T.DataType) -> str:
    if isinstance(kind, T.StructType):
        return f"struct<{','.join(f'{f.name}:{_float_type(f.dataType)}' for f in kind.fields)}>"
    if isinstance(kind, T.ArrayType):
        return f"array<{_float_type(kind.elementType)}>"
    return FLOAT_OF[kind.simpleString()]


def as_float(df: DataFrame, *columns: str) -> DataFrame:
    """SRC-05: columns of real values, of complex structs (re, im) or of arrays of either, in the smallest floating type that holds them."""
    return df.withColumns({c: F.col(c).cast(_float_type(df.schema[c].dataType)) for c in columns})


def as_complex64(df: DataFrame, *columns: str) -> DataFrame:
    """SRC-07: complex structs of single precision, the imaginary part of reals 0. Deprecated for as_float, and says so."""
    warnings.warn("as_complex64 loses digits of types wider than 16 bits; use as_float", DeprecationWarning, stacklevel=2)

    def one(c: str) -> Column:
        x = F.col(c)
        pair = (x["re"], x["im"]) if isinstance(df.schema[c].dataType, T.StructType) else (x, F.when(x.isNotNull(), F.lit(0.0)))
        return F.struct(pair[0].cast("float").alias("re"), pair[1].cast("float").alias("im"))

    return df.withColumns({c: one(c) for c in columns})


def interleaved(df: DataFrame, array: str) -> DataFrame:
    """ARR-01, SNK-05: an array of re, im, re, im, ... as an array of structs; an odd number of items raises."""
    x = F.col(array)
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(x).cast("int") / 2, F.lit(1)).cast("int") - 1), lambda k: F.struct(F.get(x, (2 * k).cast("int")).alias("re"), F.get(x, (2 * k + 1).cast("int")).alias("im")))
    return df.withColumn(array, F.when(F.size(x) % 2 == 1, F.raise_error("an interleaved array has an even number of items")).when(F.size(x) == 0, F.slice(pairs, 1, 0)).otherwise(pairs))


def nth_of_group(df: DataFrame, by: str, order: str, step: int, first: int = 0, stretch: int = STRETCH) -> DataFrame:
    """WIN-09: every step-th row of each group in the order of an index, from the first-th (0-based) on.

    Rows are numbered within stretches of the index, plus the rows of the stretches before; rows without an index come first.
    """
    part = df.withColumn("_s", F.coalesce(div(F.col(order), stretch), F.lit(-(2**63))))
    sizes = part.groupBy(F.col(by).alias("_g"), F.col("_s").alias("_t")).agg(F.count(F.lit(1)).alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.partitionBy("_g").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy(by, "_s").orderBy(order)) - 1
    offsets = sizes.select("_g", "_t", before.alias("_b"))
    met = part.withColumn("_own", own).join(offsets, F.col(by).eqNullSafe(F.col("_g")) & (F.col("_s") == F.col("_t")))
    place = F.col("_own") + F.col("_b")
    return met.where((place >= first) & ((place - first) % step == 0)).select(df.columns)


def medians(samples: DataFrame, by: str, column: str, tie: str, path: str) -> DataFrame:
    """AGG-09: (by, n, low, high, median) of each group's values that are neither null nor NaN, exact: from their places in one sorted table.

    Values are sorted by range over all groups, with tie among equal ones, so a group of any size is many tasks; only its middle rows meet. path keeps
    the sorted ranges.
    """
    from sigloom.operators.catalog import places

    x = F.col(column).cast("double")
    rows = samples.where(x.isNotNull() & ~F.isnan(x)).select(F.col(by).alias("_g"), x.alias("_x"), F.col(tie).alias("_t"))
    placed = places(rows, ["_g", "_x", "_t"], path)
    groups = placed.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("low"), F.max("_x").alias("high"), F.min("place").alias("_f"))
    at = F.col("place") - F.col("_f")
    middle = placed.join(groups.withColumnRenamed("_g", "_h"), F.col("_g").eqNullSafe(F.col("_h"))).where((at == div(F.col("n") - 1, 2)) | (at == div(F.col("n"), 2)))
    return middle.groupBy(F.col("_g").alias(by), "n", "low", "high").agg(F.avg("_x").alias("median"))


def gap_zeros(blocks: DataFrame, most: int) -> DataFrame:
    """SRC-23: what a gapless reader puts out: blocks with kind data, and the gaps between them with kind zeros, in pieces of at most most samples."""
    zeros = gaps(blocks).select("channel", F.col("gap_start").alias("block_start"), F.col("gap_n").alias("n"), F.lit("zeros").alias("kind"))
    every = blocks.select("channel", "block_start", "n", F.lit("data").alias("kind")).unionByName(zeros)
    pieces = every.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), div(F.col("n") - 1, most))))
    start = F.col("block_start") + F.col("k") * most
    return pieces.select("channel", start.alias("block_start"), F.least(F.lit(most).cast("long"), F.col("block_start") + F.col("n") - start).alias("n"), "kind")


def same_store(a: DataFrame, b: DataFrame) -> DataFrame:
    """SET-04, JOIN-07: rows that only one store holds, with the side; none when equal."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def align(a: DataFrame, b: DataFrame) -> DataFrame:
    """JOIN-02: samples of two channels at equal indexes."""
    x = a.select("sample_idx", F.col("re").alias("re_a"), F.col("im").alias("im_a"))
    return x.join(b.select("sample_idx", F.col("re").alias("re_b"), F.col("im").alias("im_b")), "sample_idx")


def attach_tags(blocks: DataFrame, tags: DataFrame, span: int = STRETCH) -> DataFrame:
    """JOIN-04: tags (channel, offset, key) with the block that holds them. Blocks go to each stretch they touch, so the join has an equality."""
    reach = blocks.withColumn("stretch", F.explode(F.sequence(div(F.col("block_start"), span), div(F.col("block_start") + F.col("n") - 1, span))))
    placed = tags.withColumn("stretch", div(F.col("offset"), span))
    on = (placed["channel"] == reach["channel"]) & (placed["stretch"] == reach["stretch"]) & (placed["offset"] >= reach["block_start"]) & (placed["offset"] < reach["block_start"] + reach["n"])
    return placed.join(reach, on).select(placed["channel"], "block_start", "offset", (F.col("offset") - F.col("block_start")).alias("at"), "key")


def channel_pairs(channels: DataFrame, mode: str) -> DataFrame:
    """JOIN-03: pairs of a channel list (position, channel): self, pairs, combo, permute. The list is a store's channels, a few rows."""
    a = channels.select(F.col("position").alias("i"), F.col("channel").alias("a"))
    b = channels.select(F.col("position").alias("j"), F.col("channel").alias("b"))
    on = {"self": F.col("i") >= 0, "pairs": (F.col("j") == F.col("i") + 1) & (F.col("i") % 2 == 0), "combo": F.col("i") < F.col("j"), "permute": F.col("i") != F.col("j")}[mode]
    return a.join(b, on).select("a", "b")
