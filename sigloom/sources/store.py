"""The sample store: time-partitioned Parquet of chunk rows, one row a continuous block within a file's time.

A directory is named by the first folder time in it. It is one folder's, or, where an append spans more than DIRECTORIES folders, that of several
in a row: what an append costs in directories and files does not grow with the time it spans. Rows know their own folder by their file's time.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.functions.timebase import div, file_millis

#: Storage types with their Spark types and fill values.
DTYPES = {"s8": ("tinyint", -128), "s16": ("smallint", -32768), "s32": ("int", -(2**31)), "s64": ("bigint", -(2**63)), "u8": ("smallint", 0), "u16": ("int", 0), "u32": ("bigint", 0), "u64": ("decimal(20,0)", 0), "f32": ("float", float("nan")), "f64": ("double", float("nan"))}
#: Columns of a channel's properties row, which every later write must match.
PROPERTIES = ("channel", "dtype", "rate_num", "rate_den", "subdir_s", "file_ms", "is_complex", "num_subchannels")


#: The column of a subchannel; a channel without subchannels has one column, data.
SUBCHANNEL = "s{}"
#: About as many directories an append makes at most; folders share one beyond that.
DIRECTORIES = 128
#: Largest values of the types that Spark has no unsigned form of.
UNSIGNED = {"u8": 2**8 - 1, "u16": 2**16 - 1, "u32": 2**32 - 1, "u64": 2**64 - 1}


def checked_cast(value: Column, dtype: str) -> Column:
    """SNK-05: value in the storage type's Spark type; what does not fit raises: out of range, not whole in a whole type, or finite but not so in f32."""
    kind = DTYPES[dtype][0]
    bad = lambda why: F.raise_error(F.lit(f"a value {why} {dtype}")).cast(kind)
    if dtype in ("f32", "f64"):
        lost = (F.abs(value.cast("double")) < float("inf")) & (F.abs(value.cast("float").cast("double")) == float("inf"))
        return value.cast(kind) if dtype == "f64" else F.when(lost, bad("is out of range of")).otherwise(value.cast(kind))
    low, high = (0, UNSIGNED[dtype]) if dtype in UNSIGNED else (-(2 ** (int(dtype[1:]) - 1)), 2 ** (int(dtype[1:]) - 1) - 1)
    bound = lambda x: F.lit(str(x)).cast("decimal(20,0)") if dtype == "u64" else F.lit(x)
    inside = (value >= bound(low)) & (value <= bound(high))
    return F.when(value.isNull(), F.lit(None).cast(kind)).when(~inside, bad("is out of range of")).when(value != F.floor(value), bad("is not whole, as is all of")).otherwise(value.cast(kind))


def validate(dtype: str, rate_num: int, rate_den: int, subdir_s: int, file_ms: int, num_subchannels: int = 1, compression: int = 0) -> None:
    """SNK-01."""
    if dtype.removeprefix("c") not in DTYPES:
        raise ValueError(f"no storage type {dtype}")
    if rate_num <= 0 or rate_den <= 0:
        raise ValueError("a rate is positive")
    if subdir_s <= 0 or file_ms <= 0 or subdir_s * 1000 % file_ms:
        raise ValueError("files must divide a folder's time")
    if num_subchannels < 1 or not 0 <= compression <= 9:
        raise ValueError("subchannels or compression out of range")


def _folder(p, sample: int) -> int:
    """The time of the folder that holds a sample, by its channel's properties."""
    return sample * p["rate_den"] // p["rate_num"] // p["subdir_s"] * p["subdir_s"]


def _pack(folders: int) -> int:
    """How many folders share a directory: a power of two, 1 for up to DIRECTORIES folders."""
    return 1 << (-(-folders // DIRECTORIES) - 1).bit_length()


class Store:
    """One root: chunks partitioned by channel and folder times, properties of channels beside them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _channel_path(self, channel: str) -> str:
        return f"{self.root}/chunks/channel={self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(channel)}"

    def properties(self) -> DataFrame:
        """SRC-10: a row for each channel."""
        return self.spark.read.parquet(f"{self.root}/channels").dropDuplicates(["channel"])

    def _own(self, channel: str):
        p = self.properties().where(F.col("channel") == channel).first()
        if p is None:
            raise KeyError(channel)
        return p

    def file_of(self, channel: str, sample: int):
        """SRC-10: the row (file_ms, subdir, first_sample, last_sample, n_samples) of the file that holds a sample's time; an error if there is none."""
        p = self._own(channel)
        ms = sample * p["rate_den"] * 1000 // p["rate_num"] // p["file_ms"] * p["file_ms"]
        held = self.files(channel).where(F.col("file_ms") == ms).first()
        if held is None:
            raise FileNotFoundError(f"no file of {channel} holds sample {sample}")
        return held

    def files(self, channel: str) -> DataFrame:
        """A row for each file time, from index columns alone."""
        ends = F.col("block_start") + F.col("n") - 1
        return self.chunks(channel).groupBy("subdir", "file_ms").agg(F.min("block_start").alias("first_sample"), F.max(ends).alias("last_sample"), F.sum("n").alias("n_samples"))

    def last_write(self, channel: str) -> tuple | None:
        """SRC-11: (time, path) of the file with the last sample; None without any."""
        if self.bounds(channel) is None:
            return None
        at = F.struct((F.col("block_start") + F.col("n")).alias("end"), F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("path"))
        r = self.chunks(channel).agg(F.max(at).alias("m")).first()["m"]
        return r["time"], r["path"]

    def written(self, channel: str) -> dict:
        """SNK-09: samples held and missing, the next index, and the last file's folder, time and UTC."""
        r = self.chunks(channel).agg(F.sum("n"), F.min("block_start"), F.max(F.col("block_start") + F.col("n")), F.max(F.struct("file_ms", "subdir"))).first()
        if r[0] is None:
            return {"total_samples": 0, "gap_samples": 0, "next_sample": 0, "last_file_ms": None, "last_subdir": None, "last_utc": None}
        utc = datetime.fromtimestamp(0, timezone.utc) + timedelta(milliseconds=r[3]["file_ms"])
        return {"total_samples": r[0], "gap_samples": r[2] - r[1] - r[0], "next_sample": r[2], "last_file_ms": r[3]["file_ms"], "last_subdir": r[3]["subdir"], "last_utc": utc}

    def recover(self) -> list[str]:
        """SRC-27: rebuild the properties of channels that have chunks but no properties row, from any of their chunk rows; their names."""
        held = set(self.channels()) if self._exists(f"{self.root}/channels") else set()
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/chunks")
        folders = [x.getPath().toString() for x in p.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(p) if x.isDirectory()]
        found = []
        for folder in folders:
            own = self.spark.read.parquet(folder).select("properties.*").first()
            if own is not None and own["channel"] not in held:
                self.create(own["channel"], own["dtype"], (own["rate_num"], own["rate_den"]), own["subdir_s"], own["file_ms"], own["is_complex"], own["num_subchannels"])
                found.append(own["channel"])
        return sorted(found)

    def channels(self) -> list[str]:
        """SRC-02."""
        if not self._exists(f"{self.root}/channels"):
            raise FileNotFoundError(f"no channels under {self.root}")
        return [r[0] for r in self.properties().select("channel").orderBy("channel").collect()]

    def create(self, channel: str, dtype: str, rate: tuple[int, int], subdir_s: int, file_ms: int, is_complex: bool = False, num_subchannels: int = 1) -> None:
        """The first writer of a channel fixes its properties; a later one must bring the same."""
        validate(dtype, *rate, subdir_s, file_ms, num_subchannels)
        row = (channel, dtype, *rate, subdir_s, file_ms, is_complex, num_subchannels)
        if self._exists(f"{self.root}/channels"):
            held = self.properties().where(F.col("channel") == channel).collect()
            if held:
                if tuple(held[0][p] for p in PROPERTIES) != row:
                    raise ValueError("properties differ from the channel's")
                return
        schema = "channel string, dtype string, rate_num long, rate_den long, subdir_s long, file_ms long, is_complex boolean, num_subchannels int"
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.root}/channels")

    def append(self, samples: DataFrame, channel: str, compression: str = "snappy") -> int:
        """SNK-02..08, PRJ-01: samples (sample_idx, re[, im][, subchannel from 0]) after all that is held; the next index.

        Cut at file times into chunk rows and committed by Spark, pages with checksums; rows of a directory are in order within each task's file. Indexes must be distinct and not negative, whole
        for every subchannel, and values must fit the storage type; otherwise the write fails.
        """
        p = self._own(channel)
        low, high, subs = samples.agg(F.min("sample_idx"), F.max("sample_idx"), F.max("subchannel") if "subchannel" in samples.columns else F.lit(None)).first()
        last = self.bounds(channel, skip_bad=False)
        if low is None:
            return 0 if last is None else last[1] + 1
        if low < 0:
            raise ValueError("indexes are not negative")
        if last is not None and low <= last[1]:
            raise ValueError("samples go forward only")
        width = p["num_subchannels"]
        if (width > 1) != ("subchannel" in samples.columns) or (subs is not None and subs >= width):
            raise ValueError(f"the channel has {width} subchannels")
        fit = lambda c: checked_cast(F.col(c), p["dtype"].removeprefix("c"))
        value = F.struct(fit("re").alias("re"), fit("im").alias("im")) if p["is_complex"] else fit("re")
        placed = samples.select("sample_idx", value.alias("v"), *(["subchannel"] if width > 1 else []))
        if width > 1:
            rows = placed.groupBy("sample_idx").agg(F.array_sort(F.collect_list(F.struct("subchannel", "v"))).alias("s"))
            whole = F.transform("s", lambda x: x["subchannel"].cast("long")) == F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))
            placed = rows.select("sample_idx", F.when(whole, F.transform("s", lambda x: x["v"])).otherwise(F.raise_error("a sample lacks subchannels or has one twice")).alias("v"))
        placed = placed.withColumn("file_ms", file_millis(F.col("sample_idx"), p["rate_num"], p["rate_den"], p["file_ms"])).repartitionByRange("file_ms")
        w = Window.partitionBy("file_ms").orderBy("sample_idx")
        twice = F.when(F.lag("sample_idx").over(w) == F.col("sample_idx"), F.raise_error("indexes are distinct")).otherwise(F.col("sample_idx") - F.row_number().over(w))
        rows = placed.withColumn("i", twice.cast("long")).groupBy("file_ms", "i").agg(F.min("sample_idx").alias("block_start"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("sample_idx", "v"))).alias("r"))
        first, end = _folder(p, low), _folder(p, high)
        # of folders that share a directory the first is a multiple of their number, but at the append's start: directories stay apart and in order
        pack = _pack((end - first) // p["subdir_s"] + 1) * p["subdir_s"]
        place = F.greatest(div(F.col("file_ms"), 1000 * pack) * pack, F.lit(first).cast("long"))
        # a subchannel is a column of its own, so that one is read without the others
        part = lambda k: F.transform("r", lambda x: x["v"][k]).alias(SUBCHANNEL.format(k))
        data = [part(k) for k in range(width)] if width > 1 else [F.transform("r", lambda x: x["v"]).alias("data")]
        own = F.struct(*[F.lit(p[x]).alias(x) for x in PROPERTIES])
        out = rows.select(place.alias("subdir"), "file_ms", "block_start", "n", *data, own.alias("properties")).sortWithinPartitions("subdir", "file_ms", "block_start")
        out.write.mode("append").partitionBy("subdir").option("compression", compression).option("parquet.page.write-checksum.enabled", "true").parquet(self._channel_path(channel))
        return high + 1

    def write(self, values: DataFrame, channel: str, next_sample: int | None = None, **options) -> int:
        """SNK-02: values (pos from 0, re[, im][, subchannel]) as one block from next_sample, by default the next one free."""
        at = next_sample
        if at is None:
            last = self.bounds(channel, skip_bad=False)
            at = 0 if last is None else last[1] + 1
        return self.append(values.withColumn("sample_idx", F.col("pos") + F.lit(at)).drop("pos"), channel, **options)

    def write_blocks(self, values: DataFrame, channel: str, sample_idx: list[int], block_idx: list[int], **options) -> int:
        """SNK-03: values (pos from 0, ...) as several blocks: block k starts at position block_idx[k] and at sample sample_idx[k], an absolute index.

        As many samples as positions; the first position 0; both strictly increasing; blocks may not overlap; all positions within the values.
        """
        n = values.agg(F.max("pos")).first()[0]
        n = 0 if n is None else n + 1
        if not block_idx or len(sample_idx) != len(block_idx):
            raise ValueError("a block has one position and one sample")
        if block_idx[0] != 0:
            raise ValueError("the first block starts at position 0")
        steps = [(a - b, c - d) for a, b, c, d in zip(sample_idx[1:], sample_idx, block_idx[1:], block_idx, strict=False)]
        if any(c <= 0 or a <= 0 for a, c in steps):
            raise ValueError("samples and positions increase")
        if any(a < c for a, c in steps):
            raise ValueError("a block runs into the next one")
        if block_idx[-1] >= n:
            raise ValueError("a block starts after the values")
        from sigloom.operators.metadata import asof

        table = self.spark.createDataFrame([(0, p, s - p) for s, p in zip(sample_idx, block_idx, strict=True)], "k int, pos long, shift long")
        keyed = values.withColumn("k", F.lit(0))
        placed = asof(keyed, table, "k", "pos", "shift").withColumn("sample_idx", F.col("pos") + F.col("md_value"))
        return self.append(placed.drop("k", "pos", "md_idx", "md_value"), channel, **options)

    def chunks(self, channel: str, first: int | None = None, last: int | None = None) -> DataFrame:
        """SRC-03: chunk rows of a range, each with its folder's time. Bounds on directories and file times go with it, so partitions and row groups are pruned."""
        p = self._own(channel)
        out = self.spark.read.option("basePath", f"{self.root}/chunks").parquet(self._channel_path(channel))
        if first is not None and last is not None:
            at = lambda i: i * p["rate_den"] * 1000 // p["rate_num"]
            lo, hi = at(first) // p["file_ms"] * p["file_ms"], at(last)
            # samples go forward only, so a directory holds no folder after the next one's first: of those before the range only the last may reach into it
            lo_dir, hi_dir = _folder(p, first), _folder(p, last)
            lo_dir = max((t for t in self._times(channel) if t < lo_dir), default=lo_dir)
            out = out.where(F.col("subdir").between(lo_dir, hi_dir) & F.col("file_ms").between(lo, hi)).where((F.col("block_start") <= last) & (F.col("block_start") + F.col("n") > first))
        return out.withColumn("subdir", div(F.col("file_ms"), 1000 * p["subdir_s"]) * p["subdir_s"])

    def read(self, channel: str, first: int, last: int, subchannel: int | None = None) -> DataFrame:
        """Samples (sample_idx, v) of an inclusive range, cut from the chunks at both ends; PRJ-01: of one subchannel, or v an array of all."""
        if last < first:
            raise ValueError("the range ends before it starts")
        return self.samples(self.chunks(channel, first, last), channel, first, last, subchannel)

    def samples(self, chunks: DataFrame, channel: str, first: int, last: int, subchannel: int | None = None) -> DataFrame:
        """Samples (sample_idx, v) of chunk rows within a range; of a subchannel, only its column is read."""
        width = self._own(channel)["num_subchannels"]
        if subchannel is not None and not 0 <= subchannel < width:
            raise ValueError(f"the channel has {width} subchannels")
        a = F.greatest(F.lit(first) - F.col("block_start"), F.lit(0)).cast("int")
        b = F.least(F.col("n"), F.lit(last + 1) - F.col("block_start")).cast("int")
        names = ["data"] if width == 1 else [SUBCHANNEL.format(k) for k in ([subchannel] if subchannel is not None else range(width))]
        parts = [F.slice(n, a + 1, b - a) for n in names]
        data = parts[0] if len(parts) == 1 else F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, names, strict=True)]), lambda x: F.array(*[x[n] for n in names]))
        cut = chunks.select((F.col("block_start") + a).alias("s"), data.alias("d"))
        return cut.select("s", F.posexplode("d").alias("k", "v")).select((F.col("s") + F.col("k")).alias("sample_idx"), "v")

    def read_vector(self, channel: str, start: int, n: int, subchannel: int | None = None) -> DataFrame:
        """SRC-04, SRC-05: exactly n samples as one array of the smallest floating type, complex ones as structs; an error when any is missing."""
        from sigloom.operators.blocks import as_float

        got = as_float(self.read(channel, start, start + n - 1, subchannel), "v")
        row = got.agg(F.count(F.lit(1)).alias("k"), F.array_sort(F.collect_list(F.struct("sample_idx", "v"))).alias("a"))
        return row.select(F.when(F.col("k") == n, F.transform("a", lambda x: x["v"])).otherwise(F.raise_error(F.concat(F.lit(f"{n} samples asked for, held: "), F.col("k").cast("string")))).alias("vector"))

    def blocks(self, channel: str) -> DataFrame:
        """SRC-08: continuous blocks from index columns alone; data isn't read."""
        from sigloom.operators.blocks import merge_blocks

        return merge_blocks(self.chunks(channel).select("channel", "block_start", "n"))

    def bounds(self, channel: str, skip_bad: bool = True) -> tuple[int, int] | None:
        """SRC-09, SRT-03: the first and the last index held; None without any.

        Directories of a channel hold times apart, so they are probed from either end, twice as many at each step, until one gives an index: those
        between are not read. Files that cannot be read, or have gone since, are passed over (bad_files names them); without skip_bad they raise.
        """
        if not self._exists(self._channel_path(channel)):
            return None
        folders = self._folders(channel)
        first = self._probe(folders, F.min("block_start"), skip_bad)
        return None if first is None else (first, self._probe(folders[::-1], F.max(F.col("block_start") + F.col("n") - 1), skip_bad))

    def _folders(self, channel: str) -> list[str]:
        """A channel's directories by time: their names only."""
        times = self._times(channel)
        return [times[t] for t in sorted(times)]

    def _times(self, channel: str) -> dict[int, str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self._channel_path(channel))
        found = [x.getPath() for x in p.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(p) if x.isDirectory()]
        return {int(f.getName().removeprefix("subdir=")): f.toString() for f in found if f.getName().startswith("subdir=")}

    def _indexes(self, folders: list[str], skip_bad: bool) -> DataFrame:
        skip = "true" if skip_bad else "false"
        read = self.spark.read.schema("block_start long, n long").option("ignoreCorruptFiles", skip).option("ignoreMissingFiles", skip)
        return read.parquet(*folders)

    def _probe(self, folders: list[str], what: Column, skip_bad: bool) -> int | None:
        at, step = 0, 1
        while at < len(folders):
            got = self._indexes(folders[at : at + step], skip_bad).agg(what).first()[0]
            if got is not None:
                return got
            at, step = at + step, 2 * step
        return None

    def bad_files(self, channel: str) -> DataFrame:
        """SRC-09: (path, problem) of a channel's files that cannot be read, by their footers and the checked pages of their index columns; data isn't read."""
        from collections.abc import Iterator

        import pandas as pd

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import pyarrow.fs as pafs
            import pyarrow.parquet as pq

            from sigloom.operators.catalog import _place

            for part in parts:
                rows = []
                for folder in part["folder"]:
                    fs, at = _place(folder)
                    for f in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
                        if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")):
                            try:
                                with fs.open_input_file(f.path) as body:
                                    pq.ParquetFile(body, page_checksum_verification=True).read(columns=["block_start", "n"])
                            except (OSError, ValueError) as e:
                                rows.append((f.path, str(e).splitlines()[0]))
                yield pd.DataFrame(rows, columns=["path", "problem"], dtype=str)

        folders = self._folders(channel) if self._exists(self._channel_path(channel)) else []
        return self.spark.createDataFrame([(f,) for f in folders], "folder string").mapInPandas(run, "path string, problem string")
