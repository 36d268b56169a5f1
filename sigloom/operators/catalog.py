"""File catalogues: listing by time, and retention by count, age and size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions.timebase import file_key, file_kind
from sigloom.operators import retention


def list_files(spark, root: str, channel: str | None = None) -> DataFrame:
    """SRC-22: (path, name, grp, kind, key_ms, size, mtime) of a store's files by Spark's own recursive listing; file bodies aren't read. Empty files aren't listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select("path", name.alias("name"), F.element_at(F.split("path", "/"), -3).alias("grp"), file_kind(name).alias("kind"), file_key(name).alias("key_ms"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return out if channel is None else out.where(F.col("grp") == channel)


def in_order(files: DataFrame, reverse: bool = False) -> DataFrame:
    """SRT-01, SRT-02: properties first, then by time and path; last first with reverse. places() numbers files."""
    first = F.when(F.col("kind") == "properties", 0).otherwise(1) if "kind" in files.columns else F.lit(1)
    way = F.desc if reverse else F.asc
    return files.withColumn("_first", first).orderBy("_first", way("key_ms"), way("path")).drop("_first")


def of_kinds(files: DataFrame, data: bool = True, metadata: bool = True, properties: bool = True) -> DataFrame:
    """PRJ-05, PRJ-06, SET-02: files whose names are of the wanted kinds; names in progress are of none."""
    wanted = [k for k, on in (("data", data), ("metadata", metadata), ("properties", properties)) if on]
    return files.where(F.col("kind").isin(wanted))


def once(events: DataFrame) -> DataFrame:
    """SRT-09: of rows that tell of one path again, the first by time; what it was told with goes along."""
    fields = [c for c in events.columns if c != "path"]
    first = F.min_by(F.struct(*fields), F.struct(*[F.col(c) for c in fields])).alias("m")
    return events.groupBy("path").agg(first).select("path", "m.*").select(events.columns)


def in_time(events: DataFrame, first: int | None, last: int | None) -> DataFrame:
    """PRJ-10: events within the times, batch or stream; files without a time, as property files are, always pass."""
    out = events
    if first is not None:
        out = out.where(F.col("key_ms").isNull() | (F.col("key_ms") >= first))
    if last is not None:
        out = out.where(F.col("key_ms").isNull() | (F.col("key_ms") <= last))
    return out


def channel_of(path: Column, depth: int = 3) -> Column:
    """STR-03: the channel a path belongs to: the depth-th part from its end."""
    return F.element_at(F.split(path, "/"), -depth)


def group_of(path: Column) -> Column:
    """Retention's group of a file: its whole channel folder and the name before its time, so channels of one name in other folders stay apart."""
    return F.regexp_replace(path, r"[^/]+/([^/@]+)@[^/]*$", "$1")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Watch: (path, event) between two listings (path, size, mtime): created, deleted or modified, by polling."""
    a, b = (x.select(F.col("path"), F.struct("size", "mtime").alias(n)) for x, n in ((old, "a"), (new, "b")))
    what = F.when(F.col("a").isNull(), "created").when(F.col("b").isNull(), "deleted").when(~F.col("a").eqNullSafe(F.col("b")), "modified")
    return a.join(b, "path", "full").select("path", what.alias("event")).where("event is not null")


def _place(path: str):
    """The file system of a path, as Spark writes paths, and the path there."""
    import pyarrow.fs as pafs

    if path.startswith("file:"):
        return pafs.LocalFileSystem(), _bare(path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _bare(root: str) -> str:
    return root.removeprefix("file://").removeprefix("file:").rstrip("/")


def beneath(path: Column, root: str) -> Column:
    """The part of a path after root."""
    return F.element_at(F.split(path, r"\Q" + _bare(root) + r"/\E", 2), -1)


def _tidy(fs, folder: str) -> None:
    """Remove a folder that has become empty; only a local file system refuses by itself where it has not."""
    import contextlib
    import os

    import pyarrow.fs as pafs

    if isinstance(fs, pafs.LocalFileSystem):
        with contextlib.suppress(OSError):
            os.rmdir(folder)


def _linked(fs, at: str, to_fs, to: str) -> bool:
    """Whether at was linked at to, or is the same file already: on one local file system only."""
    import contextlib
    import os

    import pyarrow.fs as pafs

    if not (isinstance(fs, pafs.LocalFileSystem) and isinstance(to_fs, pafs.LocalFileSystem)):
        return False
    if os.path.exists(to) and os.path.samefile(at, to):
        return True
    folder, _, name = to.rpartition("/")
    tmp = f"{folder}/tmp.{name}"
    with contextlib.suppress(FileNotFoundError):
        os.remove(tmp)
    try:
        os.link(at, tmp)
    except OSError:
        return False
    os.replace(tmp, to)
    return True


def exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(files: DataFrame) -> int:
    """Delete files (path) on the executors; how many rows. A file that is already gone, as after a repeated task, counts too."""
    from collections.abc import Iterator

    import pandas as pd

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path in part["path"]:
                fs, at = _place(path)
                try:
                    fs.delete_file(at)
                except FileNotFoundError:
                    pass
                _tidy(fs, at.rpartition("/")[0])
            yield pd.DataFrame({"n": [len(part)]})

    return files.select("path").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def transfer(files: DataFrame, root: str, target: str, move: bool = False, link: bool = False) -> int:
    """SNK-13: copy, move or link files (path) under root to the same place under target; how many. Under a hidden name first, renamed when whole.

    Executors copy, each its own rows, through the file system of the paths; a repeated task overwrites what it left. Links are hard ones and
    fall back to copies where there can be none. Folders that a move leaves empty go, on local file systems. A file that a repeated task has moved
    before counts again.
    """
    from collections.abc import Iterator

    import pandas as pd
    import pyarrow.fs as pafs

    base = _bare(root)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path in part["path"]:
                fs, at = _place(path)
                to_fs, to = _place(target.rstrip("/") + "/" + at.partition(base + "/")[2])
                folder, _, name = to.rpartition("/")
                if move and fs.get_file_info(at).type == pafs.FileType.NotFound and to_fs.get_file_info(to).type == pafs.FileType.File:
                    continue
                to_fs.create_dir(folder, recursive=True)
                if link and _linked(fs, at, to_fs, to):
                    continue
                with fs.open_input_stream(at) as source, to_fs.open_output_stream(f"{folder}/tmp.{name}") as sink:
                    while block := source.read(1 << 22):
                        sink.write(block)
                to_fs.move(f"{folder}/tmp.{name}", to)
                if move:
                    fs.delete_file(at)
                    _tidy(fs, at.rpartition("/")[0])
            yield pd.DataFrame({"n": [len(part)]})

    return files.select("path").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def archive(source, target, channel: str, first: int, last: int, compression: str = "gzip") -> int:
    """SNK-14: the samples of an inclusive range of a channel from one store to another, compressed anew; the next index there.

    Folders that lie whole in the range are pruned to by their times and chunk rows of the ends are cut; the target's properties are the source's.
    """
    p = source._own(channel)
    target.create(channel, p["dtype"], (p["rate_num"], p["rate_den"]), p["subdir_s"], p["file_ms"], p["is_complex"], p["num_subchannels"])
    rows = source.read(channel, first, last)
    if p["num_subchannels"] > 1:
        rows = rows.select("sample_idx", F.posexplode("v").alias("subchannel", "v"))
    value = [F.col("v.re").alias("re"), F.col("v.im").alias("im")] if p["is_complex"] else [F.col("v").alias("re")]
    return target.append(rows.select("sample_idx", *(["subchannel"] if p["num_subchannels"] > 1 else []), *value), channel, compression)


def archive_metadata(source, target, first: int, last: int) -> None:
    """SNK-15: metadata rows of an inclusive range, and the last one before it, to another metadata store."""
    p = source.properties()
    target.create((p["rate_num"], p["rate_den"]), p["subdir_s"], p["file_s"], p["prefix"])
    target.write(source.read(first, last, fill=True).drop("channel"))


def time_slice(files: DataFrame, first: int, last: int) -> DataFrame:
    """PRJ-04: files by their times, both ends included."""
    return files.where(F.col("key_ms").between(first, last))


def time_slice_filled(files: DataFrame, first: int, last: int) -> DataFrame:
    """PRJ-04 for metadata: also each group's last file before first, whose values still hold then."""
    before = files.where(F.col("key_ms") < first).groupBy("grp").agg(F.max(F.struct("key_ms", "path", "size")).alias("m")).select("grp", "m.*")
    return time_slice(files, first, last).unionByName(before.select(files.columns))


def expired_by_count(files: DataFrame, count: int) -> DataFrame:
    """SRT-05: all but each group's newest count files."""
    return retention.by_count(files, count)


def expired_by_duration(files: DataFrame, ms: int) -> DataFrame:
    """SRT-06: files more than ms older than their group's newest: one small aggregate, joined back."""
    newest = files.groupBy("grp").agg(F.max("key_ms").alias("_m"))
    return files.join(newest, "grp").where(F.col("_m") - F.col("key_ms") > ms).select(files.columns)


def expired_by_size(files: DataFrame, size: int, trigger: str | None = None) -> DataFrame:
    """SRT-07: oldest files first until the rest is at most size bytes; each group's newest stays, but for the group that triggers it."""
    return retention.by_size(files, size, trigger)


def expired(files: DataFrame, count: int | None = None, ms: int | None = None, size: int | None = None) -> DataFrame:
    """SRT-08: by count, then duration, then size, each over what the ones before left."""
    left, gone = files, None
    for f, x in ((expired_by_count, count), (expired_by_duration, ms), (expired_by_size, size)):
        if x is not None:
            now = f(left, x)
            gone = now if gone is None else gone.unionByName(now)
            left = left.join(now.select("path"), "path", "left_anti").select(files.columns)
    return files.limit(0) if gone is None else gone


def status(files: DataFrame) -> DataFrame:
    """AGG-10: count, bytes and time span by group."""
    return files.groupBy("grp").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("total_bytes"), (F.max("key_ms") - F.min("key_ms")).alias("span_ms"))


def reconcile(buffer: DataFrame, disk: DataFrame) -> DataFrame:
    """JOIN-06, SET-03: paths with deleted (only in the buffer), created (only on disk) or kept."""
    gone = buffer.join(disk, "path", "left_anti").select("path", F.lit("deleted").alias("state"))
    new = disk.join(buffer, "path", "left_anti").select("path", F.lit("created").alias("state"))
    return gone.unionByName(new).unionByName(buffer.join(disk, "path", "left_semi").select("path", F.lit("kept").alias("state")))


def event_kind(src_match: Column, dest_match: Column) -> Column:
    """JOIN-05: a move of which one side matches is a creation or a deletion."""
    return F.when(src_match & dest_match, "moved").when(dest_match, "created").when(src_match, "deleted")


def disk_estimate(files: DataFrame, ratio: float) -> DataFrame:
    """AGG-15."""
    return files.agg(F.floor(F.sum("size") * F.lit(ratio)).cast("long").alias("bytes"), F.count(F.lit(1)).alias("n_files"))


def places(files: DataFrame, order: list[str], path: str) -> DataFrame:
    """SRT-01: files with their place from 1 in the whole order: sorted ranges are numbered apart, plus the rows of the ranges before (one row each).

    The ranges are written to path first, as their bounds are sampled and must be the same for numbers and offsets.
    """
    spark = files.sparkSession
    ranges = files.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), *order).withColumn("_part", F.spark_partition_id())
    ranges.write.parquet(path)
    held = spark.read.schema(ranges.schema).parquet(path)
    sizes = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_b"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return held.withColumn("_o", own).join(F.broadcast(offsets), "_part").withColumn("place", F.col("_o") + F.col("_b")).drop("_part", "_o", "_b")
