"""Several roots as one store: a channel's blocks, bounds and samples over all of them, where they agree, overlap or disagree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.functions.timebase import div
from sigloom.operators.blocks import STRETCH, merge_blocks
from sigloom.sources.store import PROPERTIES, Store


def sweep(blocks: DataFrame, roots: int, stretch: int = STRETCH) -> DataFrame:
    """Pieces (first, n, holders, winner, own) of blocks (root, block_start, n) of one channel between any two neighbouring ends of them.

    holders has the numbers of the roots that hold a piece, winner the last of these, own by root the block that it is of (null where there is none). An
    interval sweep: blocks are cut at stretches, so that a channel is many groups, and in each the starts and ends of every root are added
    up in order. Blocks of one root do not overlap. Only index columns are read; a piece is a row.
    """
    part = blocks.withColumn("s", F.explode(F.sequence(div(F.col("block_start"), stretch), div(F.col("block_start") + F.col("n") - 1, stretch))))
    low, high = F.greatest("block_start", F.col("s") * stretch), F.least(F.col("block_start") + F.col("n"), (F.col("s") + 1) * stretch)
    edges = part.select("s", "root", F.explode(F.array(F.struct(low.alias("at"), F.lit(1).alias("d"), "block_start"), F.struct(high.alias("at"), F.lit(-1).alias("d"), F.lit(None).cast("long").alias("block_start")))).alias("e"))
    mine = lambda k, c: F.when(F.col("root") == k, F.col(c))
    sums = [f for k in range(roots) for f in (F.sum(mine(k, "e.d")).alias(f"d{k}"), F.max(mine(k, "e.block_start")).alias(f"b{k}"))]
    at = edges.groupBy("s", F.col("e.at").alias("first")).agg(*sums)
    w = Window.partitionBy("s").orderBy("first")
    held = lambda k: F.coalesce(F.sum(f"d{k}").over(w), F.lit(0)) > 0
    own = F.array(*[F.when(held(k), F.max(f"b{k}").over(w)) for k in range(roots)])
    pieces = at.select("first", (F.lead("first").over(w) - F.col("first")).alias("n"), own.alias("own"))
    holders = F.filter(F.sequence(F.lit(0), F.lit(roots - 1)), lambda k: F.get("own", k).isNotNull())
    return pieces.select("first", "n", holders.alias("holders"), "own").where("n is not null and size(holders) > 0").withColumn("winner", F.array_max("holders"))


class Roots:
    """SRC-01, SRC-20, SRC-26, SET-01: a reader over roots in order. Where several hold a sample, a strict reader refuses the channel before
    any sample is read; else the last root's sample counts."""

    def __init__(self, spark: SparkSession, roots: list[str], strict: bool = True):
        self.spark, self.strict = spark, strict
        self.stores = [Store(spark, r) for r in roots]
        if not roots:
            raise ValueError("there is no root")
        for store in self.stores:
            if self._is_channel(store.root):
                raise ValueError(f"{store.root} is a channel, not a root")
        self._held = [set(s.channels()) if s._exists(f"{s.root}/channels") else set() for s in self.stores]
        if not any(self._held):
            raise FileNotFoundError(f"no channels under {', '.join(roots)}")

    def _is_channel(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.exists(p) and any(x.getPath().getName().startswith("subdir=") for x in fs.listStatus(p))

    def channels(self) -> list[str]:
        return sorted(set().union(*self._held))

    def _of(self, channel: str) -> list[tuple[int, Store]]:
        own = [(k, s) for k, s in enumerate(self.stores) if channel in self._held[k]]
        if not own:
            raise KeyError(channel)
        return own

    def properties(self, channel: str):
        """SRC-26: the channel's properties, which all roots must share."""
        rows = [(s.root, s._own(channel)) for _, s in self._of(channel)]
        for root, row in rows[1:]:
            if differ := [p for p in PROPERTIES if row[p] != rows[0][1][p]]:
                raise ValueError(f"{root} has another {', '.join(differ)} of {channel} than {rows[0][0]}")
        return rows[0][1]

    def metadata(self, channel: str):
        """SRC-20: the channel's metadata store, of the first root that has one."""
        from sigloom.operators.metadata import MetadataStore

        for _, s in self._of(channel):
            found = MetadataStore(self.spark, s.root, channel)
            if found._exists(f"{found.path}/properties"):
                return found
        raise FileNotFoundError(f"no root has metadata of {channel}")

    def _index(self, channel: str, first: int | None = None, last: int | None = None) -> DataFrame:
        self.properties(channel)
        each = [s.chunks(channel, first, last).select(F.lit(k).alias("root"), "block_start", "n") for k, s in self._of(channel) if s._exists(s._channel_path(channel))]
        return reduce(DataFrame.unionByName, each)

    def bounds(self, channel: str) -> tuple[int, int] | None:
        """SRC-09 over all roots."""
        r = self._index(channel).agg(F.min("block_start"), F.max(F.col("block_start") + F.col("n") - 1)).first()
        return None if r[0] is None else (r[0], r[1])

    def pieces(self, channel: str, first: int | None = None, last: int | None = None) -> DataFrame:
        return sweep(self._index(channel, first, last), len(self.stores))

    def held(self, channel: str) -> DataFrame:
        """(holders, block_start, n): maximal stretches that the same roots hold."""
        named = self.pieces(channel).select(F.array_join(F.transform("holders", lambda k: k.cast("string")), ",").alias("channel"), F.col("first").alias("block_start"), "n")
        return merge_blocks(named).withColumnRenamed("channel", "holders")

    def check(self, channel: str, first: int | None = None, last: int | None = None) -> None:
        """SRC-26: an error that names where two roots hold the same samples; no data is read for it."""
        twice = self.pieces(channel, first, last).where(F.size("holders") > 1).agg(F.min(F.struct("first", "n", "holders"))).first()[0]
        if twice is not None:
            raise ValueError(f"roots {', '.join(self.stores[k].root for k in twice['holders'])} both hold {channel} from {twice['first']} on")

    def blocks(self, channel: str) -> DataFrame:
        """SRC-08 over all roots: (channel, block_start, n), each sample once."""
        if self.strict:
            self.check(channel)
        return merge_blocks(self.pieces(channel).select(F.lit(channel).alias("channel"), F.col("first").alias("block_start"), "n"))

    def read(self, channel: str, first: int, last: int, subchannel: int | None = None) -> DataFrame:
        """SRC-03 over all roots: samples (sample_idx, v, root) of an inclusive range.

        What a later root hides of a chunk goes to it by the chunk's start, as a few bounds; data stays where it is unless such bounds are many.
        """
        if last < first:
            raise ValueError("the range ends before it starts")
        if self.strict:
            self.check(channel, first, last)
        pieces = self.pieces(channel, first, last).where(F.size("holders") > 1)
        parts = []
        for k, store in self._of(channel):
            if not store._exists(store._channel_path(channel)):
                continue
            chunks = store.chunks(channel, first, last)
            got = store.samples(chunks, channel, first, last, subchannel)
            if not self.strict and k < len(self.stores) - 1:
                hidden = pieces.where(F.get("own", F.lit(k)).isNotNull() & (F.col("winner") > k)).groupBy(F.get("own", F.lit(k)).alias("of")).agg(F.collect_list(F.struct("first", "n")).alias("hidden"))
                both = chunks.join(hidden, chunks["block_start"] == hidden["of"], "left")
                whole = store.samples(both.where("hidden is null"), channel, first, last, subchannel)
                got = whole.unionByName(self._seen(store, both.where("hidden is not null"), channel, first, last, subchannel))
            parts.append(got.withColumn("root", F.lit(k)))
        return reduce(DataFrame.unionByName, parts)

    def _seen(self, store: Store, chunks: DataFrame, channel: str, first: int, last: int, subchannel: int | None) -> DataFrame:
        """Samples of chunks with hidden parts, as chunks of what is left between these."""
        ends = F.array_sort(F.concat(F.transform("hidden", lambda h: F.struct(h["first"].alias("a"), (h["first"] + h["n"]).alias("b"))), F.array(F.struct((F.col("block_start") + F.col("n")).alias("a"), F.lit(None).cast("long").alias("b")))))
        before = lambda x, k: F.when(k == 0, F.col("block_start")).otherwise(F.get(x, k - 1)["b"])
        left = F.filter(F.flatten(F.transform(F.array(ends), lambda x: F.transform(x, lambda e, k: F.struct(before(x, k).alias("from"), e["a"].alias("to"))))), lambda g: g["to"] > g["from"])
        names = [c for c in chunks.columns if c == "data" or (c[0] == "s" and c[1:].isdigit())]
        rows = chunks.withColumn("left", F.explode(left))
        part: dict[str, Column] = {c: F.slice(c, (F.col("left.from") - F.col("block_start") + 1).cast("int"), (F.col("left.to") - F.col("left.from")).cast("int")) for c in names}
        cut = rows.select(F.col("left.from").alias("block_start"), (F.col("left.to") - F.col("left.from")).alias("n"), *[x.alias(c) for c, x in part.items()])
        return store.samples(cut, channel, first, last, subchannel)
