"""Sparse metadata on the sample index: forward fill, ranges, flattening, writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.functions.timebase import div


#: Indexes of a stretch within which values are carried forward before the last one of each stretch is.
STRETCH = 1 << 20


def asof(samples: DataFrame, metadata: DataFrame, key: str, at: str, value: str, stretch: int = STRETCH) -> DataFrame:
    """JOIN-01, WIN-07: each sample with the last metadata value at or before it: a union and one window, no inequality join.

    The window runs in stretches of at, so one key is many groups; what a stretch starts with comes from a window over one row a stretch.
    """
    part = div(F.col(at).cast("long"), stretch).alias("_s")
    right = metadata.select(key, at, F.struct(F.col(at).alias("at"), F.col(value).alias("value")).alias("_m"), F.lit(0).alias("_side"), part)
    left = samples.select("*", F.lit(None).cast(right.schema["_m"].dataType).alias("_m"), F.lit(1).alias("_side"), part)
    both = left.unionByName(right, allowMissingColumns=True)
    lasts = both.groupBy(key, "_s").agg(F.max_by("_m", F.when(F.col("_m").isNotNull(), F.col(at))).alias("_e"))
    start = F.last("_e", ignorenulls=True).over(Window.partitionBy(key).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    carried = lasts.select(F.col(key).alias("_k"), F.col("_s").alias("_t"), start.alias("_c"))
    w = Window.partitionBy(key, "_s").orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_last", F.last("_m", ignorenulls=True).over(w)).where("_side = 1")
    out = out.join(carried, out[key].eqNullSafe(carried["_k"]) & (out["_s"].eqNullSafe(carried["_t"])))
    last = F.coalesce("_last", "_c")
    return out.select(*samples.columns, last["at"].alias("md_idx"), last["value"].alias("md_value"))


def read(metadata: DataFrame, first: int, last: int | None = None, fill: bool = False, columns: list[str] | None = None) -> DataFrame:
    """SRC-13, SRC-14: rows of an inclusive range; with fill also each channel's last row at or before first (at most first itself)."""
    last = first if last is None else last
    got = metadata.where(F.col("sample_idx").between(first, last))
    if fill:
        before = metadata.where(F.col("sample_idx") < first)
        fields = [c for c in metadata.columns if c != "channel"]
        latest = before.groupBy("channel").agg(F.max_by(F.struct(*fields), "sample_idx").alias("m")).select("channel", "m.*")
        held = got.where(F.col("sample_idx") == first).select("channel").distinct()
        got = got.unionByName(latest.join(held, "channel", "left_anti").select(metadata.columns))
    return got if columns is None else got.select("channel", "sample_idx", *columns)


def latest(metadata: DataFrame) -> DataFrame:
    """SRC-17: each channel's last row."""
    fields = [c for c in metadata.columns if c != "channel"]
    return metadata.groupBy("channel").agg(F.max_by(F.struct(*fields), "sample_idx").alias("m")).select("channel", "m.*")


def with_rate(metadata: DataFrame, channels: DataFrame, first: int) -> DataFrame:
    """SRC-21: rows with the channel's rate fields; a channel without any gets one row at first with those alone."""
    joined = channels.join(metadata, "channel", "left")
    return joined.withColumn("sample_idx", F.coalesce("sample_idx", F.lit(first)))


def flat_columns(schema: T.StructType, lead: str = "", path: tuple = ()) -> list[Column]:
    """MAP-01, SRC-15: leaves of nested fields, named parent/child."""
    out = []
    for f in schema.fields:
        here = (*path, f.name)
        name = f"{lead}/{f.name}" if lead else f.name
        if isinstance(f.dataType, T.StructType):
            out += flat_columns(f.dataType, name, here)
        else:
            out.append(F.col(".".join(f"`{p}`" for p in here)).alias(name))
    return out


def flatten(df: DataFrame) -> DataFrame:
    return df.select(*flat_columns(df.schema))


def columnar(df: DataFrame, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """SRC-16: one row, or one for each value of by, with an array for each flattened field, in order; nulls stay in place as NaN for doubles."""
    flat = flatten(df)
    rows = F.array_sort(F.collect_list(F.struct(F.col(order), *[F.col(f"`{c}`") for c in flat.columns if c != order and c not in by])))
    kinds = dict(flat.dtypes)

    def pick(c: str) -> Column:
        missing = F.lit(float("nan")) if kinds[c] in ("double", "float") else F.lit(None)
        return F.transform("r", lambda x: F.coalesce(x[c], missing)).alias(c)

    return flat.groupBy(*by).agg(rows.alias("r")).select(*by, *[pick(c) for c in flat.columns if c not in by])


def broadcast_write(samples: list[int], data: dict) -> list[dict]:
    """MAP-03, SNK-10: rows of a dict of fields: a list of as many items as samples is dealt out, anything else repeats; nested alike."""
    n = len(samples)

    def at(v, k: int):
        if isinstance(v, dict):
            return {f: at(x, k) for f, x in v.items()}
        return v[k] if isinstance(v, (list, tuple)) and len(v) == n else v

    return [{"sample_idx": s, **at(data, k)} for k, s in enumerate(samples)]


def refused(new: DataFrame, held: DataFrame) -> DataFrame:
    """SNK-10: keys of new rows that are held already; a writer raises when there is any."""
    return new.join(held.select("channel", "sample_idx"), ["channel", "sample_idx"], "left_semi")


def with_single(rows: DataFrame, fields: dict) -> DataFrame:
    """MAP-03: rows (sample_idx, fields by sample...) with further fields whose single value holds for every sample. A name that rows have is refused."""
    if clash := sorted(set(fields) & set(rows.columns)):
        raise ValueError(f"fields {clash} are given twice")
    return rows.withColumns({k: F.lit(v) for k, v in fields.items()})


def deep_update(a: dict, b: dict) -> dict:
    """MAP-02: b over a, nested dicts merged."""
    return a | {k: deep_update(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}


class MetadataStore:
    """SNK-10, SRC-12, SRC-19, SRC-20: sparse rows on the sample index, one table for each channel under <root>/<channel>/metadata, never overwritten."""

    PROPERTIES = "rate_num long, rate_den long, subdir_s long, file_s long, prefix string, fields array<string>"

    def __init__(self, spark, root: str, channel: str):
        self.spark, self.channel = spark, channel
        self.path = f"{root.rstrip('/')}/{channel}/metadata"

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def create(self, rate: tuple[int, int], subdir_s: int, file_s: int, prefix: str = "metadata") -> None:
        """The first writer fixes the properties; a later one must bring the same."""
        if rate[0] <= 0 or rate[1] <= 0 or file_s <= 0 or subdir_s <= 0 or subdir_s % file_s:
            raise ValueError("files must divide a folder's time, and rates are positive")
        row = (*rate, subdir_s, file_s, prefix)
        if self._exists(f"{self.path}/properties"):
            if tuple(self.properties()[:5]) != row:
                raise ValueError("properties differ from the channel's")
            return
        self.spark.createDataFrame([(*row, [])], self.PROPERTIES).coalesce(1).write.parquet(f"{self.path}/properties")

    def properties(self):
        if not self._exists(f"{self.path}/properties"):
            raise FileNotFoundError(f"no metadata under {self.path}")
        return self.spark.read.parquet(f"{self.path}/properties").first()

    def fields(self) -> list[str]:
        """SRC-19."""
        return sorted(c for c in self.read().columns if c not in ("channel", "sample_idx"))

    def _held(self) -> DataFrame | None:
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/rows") if self._exists(f"{self.path}/rows") else None

    def write(self, rows: DataFrame) -> None:
        """Rows (sample_idx, fields...) of new indexes; one that is held, negative or twice among them ends the write, which then leaves nothing."""
        p = self.properties()
        new = rows.select(F.lit(self.channel).alias("channel"), *[f"`{c}`" for c in rows.columns if c != "channel"])
        if new.where("sample_idx < 0").limit(1).count() or new.groupBy("sample_idx").count().where("count > 1").limit(1).count():
            raise ValueError("indexes are distinct and not negative")
        held = self._held()
        if held is not None and refused(new.select("channel", "sample_idx"), held).limit(1).count():
            raise ValueError("a sample has metadata already")
        at = div(F.col("sample_idx"), p["rate_num"]) * p["rate_den"] + div((F.col("sample_idx") % p["rate_num"]) * p["rate_den"], p["rate_num"])
        placed = new.withColumn("file_s", div(at, p["file_s"]) * p["file_s"])
        placed.repartitionByRange("file_s").write.mode("append").partitionBy("file_s").parquet(f"{self.path}/rows")

    def read(self, first: int | None = None, last: int | None = None, fill: bool = False) -> DataFrame:
        """All rows, or those of an inclusive range, with fill also the last one before it."""
        held = self._held()
        if held is None:
            raise FileNotFoundError(f"no rows under {self.path}")
        held = held.drop("file_s")
        return held if first is None else read(held, first, last, fill)

    def bounds(self) -> tuple[int, int]:
        """SRC-18."""
        r = self.read().agg(F.min("sample_idx"), F.max("sample_idx")).first()
        return r[0], r[1]
