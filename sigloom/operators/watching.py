"""Watching a store's files: whole listings, moves told by content, events to handlers, rounds that survive a restart, mirrors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.functions.timebase import file_key, file_kind
from sigloom.operators import catalog

#: Bytes read at a time, and bytes of either end that a short mark is made of.
BLOCK = 1 << 16
#: Shares that the files of one mark are numbered in, so that many equal files, as empty ones are, do not meet in one task.
SHARES = 256


def walk(spark: SparkSession, root: str, state: str) -> DataFrame:
    """SRC-22: (path, name, grp, kind, key_ms, size, mtime) of all files under root, empty ones too; only names are read.

    One level of folders after the other is listed by the executors, a folder a row, and written under state; folders never pass the driver.
    """

    def below(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs

        for part in parts:
            for path in part["path"]:
                fs, at = catalog._place(path)
                # what stands before a path within its file system
                head = "file:" if isinstance(fs, pafs.LocalFileSystem) else path[: path.rindex(at)]
                found = fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
                rows = [(head + f.path, f.type == pafs.FileType.Directory, f.size or 0, (f.mtime_ns or 0) // 1000) for f in found]
                out = pd.DataFrame(rows, columns=["path", "folder", "size", "mtime"]).astype({"folder": bool, "size": "int64", "mtime": "int64"})
                yield out.assign(mtime=out["mtime"].astype("datetime64[us]").dt.tz_localize("UTC"))

    level, depth, files = spark.createDataFrame([(root.rstrip("/"),)], "path string"), 0, None
    while True:
        dealt = level.repartition("path") if depth else level
        dealt.mapInPandas(below, "path string, folder boolean, size long, mtime timestamp").write.mode("overwrite").parquet(f"{state}/{depth}")
        held = spark.read.parquet(f"{state}/{depth}")
        some = held.where(~F.col("folder")).drop("folder")
        files = some if files is None else files.unionByName(some)
        level, depth = held.where("folder").select("path"), depth + 1
        if level.isEmpty():
            break
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.element_at(F.split("path", "/"), -3).alias("grp"), file_kind(name).alias("kind"), file_key(name).alias("key_ms"), "size", "mtime")


def marked(files: DataFrame, whole: bool = False) -> DataFrame:
    """files (path, ...) with mark: a SHA-256 of the first and last 64 KiB and the size, or of all bytes with whole; null where a file is gone."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(mark=[_mark(path, whole) for path in part["path"]])

    return files.mapInPandas(run, f"{kinds}, mark string")


def _mark(path: str, whole: bool) -> str | None:
    fs, at = catalog._place(path)
    try:
        with fs.open_input_file(at) as f:
            size = f.size()
            h = hashlib.sha256(str(size).encode())
            if whole or size <= 2 * BLOCK:
                while block := f.read(BLOCK):
                    h.update(block)
            else:
                h.update(f.read(BLOCK))
                f.seek(size - BLOCK)
                h.update(f.read(BLOCK))
            return h.hexdigest()
    except FileNotFoundError:
        return None


def _numbered(paths: DataFrame, by: list[str]) -> DataFrame:
    """paths with n, their number within by: first within shares of their hash, then after the shares before, of which a group has SHARES at most."""
    dealt = paths.withColumn("_share", F.pmod(F.xxhash64("path"), F.lit(SHARES)))
    sizes = dealt.groupBy(*by, "_share").agg(F.count(F.lit(1)).alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.partitionBy(*by).orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy(*by, "_share").orderBy("path"))
    return dealt.withColumn("_own", own).join(sizes.select(*by, "_share", before.alias("_b")), [*by, "_share"]).withColumn("n", F.col("_own") + F.col("_b")).drop("_share", "_own", "_b")


def events(old: DataFrame, new: DataFrame) -> DataFrame:
    """Watch: (event, path, dest) between two listings (path, size, mtime, mark): created, deleted, modified, or moved with where to.

    A file that is gone and one that is new are one moved file where size and mark agree: first those of one name, then the others, each in an
    order of their paths; a mark goes to one pair only. Files without a mark are never moved.
    """
    side = lambda x, n: x.select("path", F.struct("size", "mtime").alias(n), F.struct("size", "mark").alias(f"{n}_of"))
    both = side(old, "a").join(side(new, "b"), "path", "full")
    event = F.when(F.col("a").isNull(), "created").when(F.col("b").isNull(), "deleted").when(~F.col("a").eqNullSafe(F.col("b")), "modified")
    of = F.coalesce("a_of", "b_of")
    told = both.select("path", event.alias("event"), of["size"].alias("size"), of["mark"].alias("mark")).where("event is not null")
    out = [told.where("event = 'modified' or mark is null").select("event", "path", F.lit(None).cast("string").alias("dest"))]
    left = told.where("event <> 'modified' and mark is not null").withColumn("_name", F.element_at(F.split("path", "/"), -1))
    for by in (["mark", "size", "_name"], ["mark", "size"]):
        # the k-th that is gone and the k-th that is new are one file; each is at most one row of its k
        one = lambda e: F.max(F.when(F.col("event") == e, F.col("path")))
        met = _numbered(left, [*by, "event"]).groupBy(*by, "n").agg(one("deleted").alias("_src"), one("created").alias("_dest"))
        pair = F.col("_src").isNotNull() & F.col("_dest").isNotNull()
        out.append(met.where(pair).select(F.lit("moved").alias("event"), F.col("_src").alias("path"), F.col("_dest").alias("dest")))
        kind = F.when(F.col("_src").isNotNull(), "deleted").otherwise("created")
        left = met.where(~pair).select("mark", "size", kind.alias("event"), F.coalesce("_src", "_dest").alias("path"))
    out.append(left.select("event", "path", F.lit(None).cast("string").alias("dest")))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def wanted(told: DataFrame, first: int | None = None, last: int | None = None, data: bool = True, metadata: bool = True, properties: bool = True) -> DataFrame:
    """PRJ-10, JOIN-05: events of files of the wanted kinds and times. A move of which one side is wanted is a creation or a deletion."""
    kinds = [k for k, on in (("data", data), ("metadata", metadata), ("properties", properties)) if on]

    def fits(path):
        name = F.element_at(F.split(path, "/"), -1)
        key = file_key(name)
        inside = (key >= F.lit(first) if first is not None else F.lit(True)) & (key <= F.lit(last) if last is not None else F.lit(True))
        return F.coalesce(file_kind(name).isin(kinds) & (key.isNull() | inside), F.lit(False))

    src, dest = fits(F.col("path")), fits(F.col("dest"))
    event = F.when(F.col("event") == "moved", catalog.event_kind(src, dest)).when(src, F.col("event"))
    one = told.withColumn("_e", event).where("_e is not null")
    path = F.when((F.col("event") == "moved") & (F.col("_e") == "created"), F.col("dest")).otherwise(F.col("path"))
    return one.select(F.col("_e").alias("event"), path.alias("path"), F.when(F.col("_e") == "moved", F.col("dest")).alias("dest"))


def dispatch(told: DataFrame, handlers: dict[str, Callable[[DataFrame], None]]) -> None:
    """Event handlers: each named event's rows go to its handler as one DataFrame; events without a handler pass unheard, unknown names raise."""
    unknown = set(handlers) - {"created", "deleted", "modified", "moved"}
    if unknown:
        raise ValueError(f"no events: {sorted(unknown)}")
    for event, handle in handlers.items():
        handle(told.where(F.col("event") == event))


class Watcher:
    """Rounds of listing and comparing, kept in a folder that driver and executors share, so that a restart goes on where the last one ended.

    A round's listing is written before its events are told and the round is marked as done after they are heard: a handler that fails hears
    the same events again, and none is left out. Marks of files that have not changed are taken from the round before.
    """

    def __init__(self, spark: SparkSession, state: str, marks: bool = True, existing: bool = True):
        self.spark, self.state, self.marks, self.existing = spark, state.rstrip("/"), marks, existing

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.state}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def done(self) -> int:
        """The last round done, from 0; -1 before the first."""
        fs, p = self._fs("done")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(x) for x in names), default=-1)

    def _listing(self, k: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.state}/listing/{k}")

    def poll(self, files: DataFrame, handle: Callable[[DataFrame], None]) -> int:
        """One round over a listing (path, size, mtime, ...): handle hears its events; the number of the round.

        The first round's files are all created; with existing=False they are taken as known.
        """
        last = self.done()
        k = last + 1
        fs, whole = self._fs(f"listing/{k}/_SUCCESS")
        if not fs.exists(whole):
            rows = files.select("path", F.col("size").cast("long").alias("size"), F.col("mtime"))
            if not self.marks:
                rows = rows.withColumn("mark", F.lit(None).cast("string"))
            elif last < 0:
                rows = marked(rows)
            else:
                known = self._listing(last).where("mark is not null")
                same = ["path", "size", "mtime"]
                rows = rows.join(known, same, "left_semi").join(known, same).unionByName(marked(rows.join(known, same, "left_anti")))
            rows.write.mode("overwrite").parquet(f"{self.state}/listing/{k}")
        new = self._listing(k)
        old = self._listing(last) if last >= 0 else (new.limit(0) if self.existing else new)
        handle(events(old, new))
        fs, mark = self._fs(f"done/{k}")
        fs.mkdirs(mark)
        for name in (f"listing/{k - 2}", f"done/{k - 2}"):
            fs.delete(self._fs(name)[1], True)
        return k


def differing(files: DataFrame, root: str, held: DataFrame, target: str) -> DataFrame:
    """Mirror: files under root that held, a listing of target, lacks at the same place or has with other bytes. Only files of equal sizes are read."""
    own = files.withColumn("_at", catalog.beneath(F.col("path"), root))
    there = held.select(catalog.beneath(F.col("path"), target).alias("_at"), F.col("size").alias("_size"), F.col("path").alias("_there"))
    both = own.join(there, "_at", "left")
    alike = F.coalesce(F.col("_size") == F.col("size"), F.lit(False))
    a = marked(both.where(alike).select("path", "_there"), whole=True).withColumnRenamed("mark", "_a")
    b = marked(a.select(F.col("_there").alias("path"), F.col("path").alias("_own"), "_a"), whole=True)
    same = b.where(F.col("_a") == F.col("mark")).select(F.col("_own").alias("path"))
    return files.join(same, "path", "left_anti").select(files.columns)


def mirror(files: DataFrame, root: str, target: str, held: DataFrame | None = None, method: str = "copy", applying: bool = False) -> int:
    """Mirror files (a listing of root) to target by copy, move or link; how many were sent. What target holds alike, by held, is left.

    Properties and metadata are always copied, as metadata files are still written to; a move then takes all but each group's newest metadata file
    away. With applying, of the files that are there only properties and each group's newest metadata, which still apply, are sent.
    """
    if method not in ("copy", "move", "link"):
        raise ValueError("a mirror copies, moves or links")
    known = files.where("kind is not null")
    notes = known.where("kind = 'metadata'").withColumn("grp", catalog.group_of(F.col("path")))
    if applying:
        newest = notes.groupBy("grp").agg(F.max(F.struct("key_ms", "path")).alias("_m")).select(F.col("_m.path").alias("path"))
        known = known.where("kind = 'properties'").unionByName(known.where("kind = 'metadata'").join(newest, "path", "left_semi").select(files.columns))
    send = known if held is None else differing(known, root, held, target)
    n = catalog.transfer(send.where("kind <> 'data'"), root, target, link=method == "link")
    n += catalog.transfer(send.where("kind = 'data'"), root, target, move=method == "move", link=method == "link")
    if method == "move" and not applying:
        catalog.remove(catalog.expired_by_count(notes, 1))
    return n
