"""Structured Streaming: growing sources, forward-only sinks, rasters and retention over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions.timebase import div
from sigloom.operators.blocks import STRETCH


def source(spark: SparkSession, path: str, schema, files_at_once: int = 16) -> DataFrame:
    """SRC-23: a Parquet folder or pattern that grows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def sink(stream: DataFrame, path: str, checkpoint: str, by: list[str] | None = None):
    """SNK-11, SNK-12: append what is there, exactly once, and end."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    q = (w.partitionBy(*by) if by else w).start()
    q.awaitTermination()
    return q


def forward_only(write: Callable[[DataFrame], None], held: Callable[[], int | None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that passes on samples after the last one held, as the writer refuses others."""

    def batch(df: DataFrame, _: int) -> None:
        last = held()
        write(df if last is None else df.where(F.col("sample_idx") > last))

    return batch


def raster_sums(stream: DataFrame, length: int, delay: str = "0 seconds") -> DataFrame:
    """AGG-03 over a stream (channel, sample_idx, ts, re): sums by raster, emitted once the watermark has passed its last sample."""
    return stream.withWatermark("ts", delay).groupBy("channel", div(F.col("sample_idx"), length).alias("raster"), F.window("ts", "1 day").alias("day")).agg(F.sum("re").alias("total"), F.count(F.lit(1)).alias("n"))


def retain(files: DataFrame, expire: Callable[[DataFrame], DataFrame], delete: Callable[[DataFrame], None], catalogue: Callable[[], DataFrame], checkpoint: str):
    """Ring buffer: each batch of file rows renews the catalogue, and what expire names is deleted."""
    q = files.writeStream.foreachBatch(lambda df, _: delete(expire(catalogue()))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def sliding_sums(stream: DataFrame, length: str, slide: str, delay: str = "0 seconds") -> DataFrame:
    """Sliding windows over a stream (channel, ts, re): sums by channel and overlapping window of event time."""
    return stream.withWatermark("ts", delay).groupBy("channel", F.window("ts", length, slide).alias("w")).agg(F.sum("re").alias("total"), F.count(F.lit(1)).alias("n"))


def sessions(stream: DataFrame, gap: str, delay: str = "0 seconds") -> DataFrame:
    """Session windows over a stream (channel, ts): a gap without samples closes a session."""
    return stream.withWatermark("ts", delay).groupBy("channel", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))


def blocks_of(stream: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Stateful session windows, exact on the sample index: (channel, block_start, n) of continuous blocks within stretches as they grow or close.

    The state of a channel's stretch is its last block, two numbers, so one channel is many groups and a group has one
    stretch's samples at most. Samples come in order from batch to batch; a block that grows on is told again with its new n, so the largest n of a
    block_start holds, and blocks.merge_blocks joins those that touch across stretches. Samples at or before the open block's end are left out, as
    forward-only writers refuse them.
    """
    import pandas as pd

    def run(key, parts, state):
        at, n = state.get if state.exists else (None, 0)
        part = pd.concat(list(parts))
        idx = part["sample_idx"].drop_duplicates().sort_values().to_numpy()
        if at is not None:
            idx = idx[idx >= at + n]
        out = []
        if len(idx):
            cut = [0, *((idx[1:] != idx[:-1] + 1).nonzero()[0] + 1).tolist(), len(idx)]
            runs = [(int(idx[a]), int(b - a)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            if at is not None and runs[0][0] == at + n:
                runs[0] = (int(at), int(n) + runs[0][1])
            out = runs
            state.update((int(runs[-1][0]), int(runs[-1][1])))
        yield pd.DataFrame({"channel": [key[0]] * len(out), "block_start": [r[0] for r in out], "n": [r[1] for r in out]})

    keyed = stream.select("channel", "sample_idx", div(F.col("sample_idx"), stretch).alias("stretch"))
    return keyed.groupBy("channel", "stretch").applyInPandasWithState(run, "channel string, block_start long, n long", "at long, n long", "update", "NoTimeout")


def tagged(samples: DataFrame, translators: dict) -> DataFrame:
    """Tag translators: each named function turns the rows of tags (offset, key, value) with its key into rows (offset, key, value); other tags pass."""
    known = samples.where(~F.col("key").isin(list(translators)))
    for name, f in translators.items():
        known = known.unionByName(f(samples.where(F.col("key") == name)).select(samples.columns))
    return known


def forward_tags(samples: DataFrame, tags: DataFrame) -> DataFrame:
    """SNK-11: blocks that time tags (pos, sample_idx) cut samples (pos) into: each sample's index follows from the last tag at or before it.

    Tags that go backwards, to before where the samples stand by the last good tag, are dropped; a tag that changes nothing does not cut. Tags are
    few (a row a re-tune): they are walked on the driver in order.
    """
    good: list[tuple[int, int]] = []
    for pos, idx in sorted((r["pos"], r["sample_idx"]) for r in tags.collect()):
        stands = good[-1][1] + pos - good[-1][0] if good else None
        if stands is None or idx > stands:
            good.append((pos, idx))
    spark = samples.sparkSession
    from sigloom.operators.metadata import asof

    table = spark.createDataFrame([(0, p, i - p) for p, i in good], "k int, pos long, shift long")
    placed = asof(samples.withColumn("k", F.lit(0)), table, "k", "pos", "shift")
    return placed.where("md_value is not null").withColumn("sample_idx", F.col("pos") + F.col("md_value")).drop("k", "md_idx", "md_value")


def mirror(files: DataFrame, root: str, target: str, checkpoint: str, copy: Callable | None = None, move: bool = False) -> int:
    """Mirror: what a stream of file rows (path, size, mtime) newly tells of is copied or moved to the same place under target; how many files.

    copy(files, root, target, move) does it, transfer by default; a batch that is run again copies again over what is there.
    """
    from sigloom.operators.catalog import transfer

    done: list[int] = []
    go = copy or transfer
    q = files.writeStream.foreachBatch(lambda df, _: done.append(go(df, root, target, move))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(done)
