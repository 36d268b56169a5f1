"""Audit of how the sources of each language diverge in their terms: a heavy-light split over pairs of sources.

The distance of two sources is a sum over all kept terms of a function of their two smoothed shares, rounded at each term, so it cannot be
had from totals. A term that a share of the sources or more have (heavy) goes into dense tiles, sources by terms, and every pair of
sources is compared there. A term that fewer have (light) counts at first as if no source had it; what its few postings change is
added: for one source that has it, by how many light terms it has how often; for two that share it, by the pairs of its postings.
All of it is whole numbers, so the parts add up to exactly the sum over all terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.llm.common import keep, partitions, text_or_empty

#: Shares count in units of one in this many.
UNIT = 1_000_000_000
#: A term is kept in a language if so many of its documents have it.
LEAST_DOCS = 3
#: Terms that a task counts before it passes its counts on.
MOST_TERMS = 200_000
#: A term is heavy where at least one in HEAVY of a tile's sources has it.
HEAVY = 4
#: Sources of a block on average at most; terms of a tile on average, and tiles of a language at least; terms of a dense step.
BLOCK, TILE, LEAST_TILES, STEP = 256, 8192, 16, 512
#: What parts terms, as a blank; A-Z lower-cased; all other bytes, those of letters beyond ASCII too, as they are.
_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text: its runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_TERMS).split()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of batches (lang, source, text), summed over as many documents as memory is given for."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for a in range(0, len(terms), 10_000):
                part = terms[a : a + 10_000]
                k = len(part)
                columns = [[lang] * k, [source] * k, pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns[:2]), *columns[2:]], ["lang", "source", "term", "n", "docs"])

    for b in batches:
        keys = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
        for key, text in zip(keys, b.column(2).cast(pa.binary()), strict=True):
            n, docs = held.setdefault(key, (Counter(), Counter()))
            found = terms_of(text.as_py())
            size -= len(n)
            n.update(found)
            docs.update(set(found))
            size += len(n)
            if size > MOST_TERMS:
                yield from out()
                held.clear()
                size = 0
    yield from out()


def shares(n: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(UNIT * (n + 1) / (total + kept)) of counts n."""
    if len(n) and (int(n.max()) + 1) * UNIT >= 1 << 63:
        return np.array([1 + UNIT * (int(x) + 1) // (total + kept) for x in n], np.int64)
    return 1 + UNIT * (n.astype(np.int64) + 1) // (total + kept)


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


class PairSums:
    """Sums over a tile's terms, for each ordered pair (a, b) of sources, of apart(p of a, p of b), less what it is for a term that neither has."""

    def __init__(self, totals: list[int], kept: int):
        self.totals, self.kept, self.n = totals, kept, len(totals)
        self.none = np.array([1 + UNIT // (t + kept) for t in totals], np.int64)
        self.base = apart(self.none[:, None], self.none[None, :])
        self.sums = np.zeros((self.n, self.n), np.int64)
        #: Light terms: how often each source has how many occurrences, by source.
        self.light: list[Counter] = [Counter() for _ in totals]

    def add(self, sources: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> None:
        """Terms as postings: sizes[k] of them belong to the k-th term; sources are places in totals."""
        p = np.empty(len(counts), np.int64)
        for s in np.unique(sources):
            mine = sources == s
            p[mine] = shares(counts[mine], self.totals[s], self.kept)
        starts = np.cumsum(sizes) - sizes
        heavy = sizes * HEAVY >= self.n
        for a in range(0, len(at := np.flatnonzero(heavy)), STEP):
            self._dense(sources, p, starts[at[a : a + STEP]], sizes[at[a : a + STEP]])
        for size in np.unique(sizes[~heavy]):
            at = starts[~heavy & (sizes == size)]
            where = at[:, None] + np.arange(size)
            self._shared(sources[where], p[where])
            for s, c in zip(sources[where].ravel().tolist(), p[where].ravel().tolist(), strict=True):
                self.light[s][c] += 1

    def _dense(self, sources: np.ndarray, p: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        tile = np.repeat(self.none[:, None], len(starts), axis=1)
        term = np.repeat(np.arange(len(starts)), sizes)
        where = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(term))
        tile[sources[where], term] = p[where]
        for a in range(self.n):
            self.sums[a] += apart(tile[a][None, :], tile).sum(axis=1) - len(starts) * self.base[a]

    def _shared(self, sources: np.ndarray, p: np.ndarray) -> None:
        """Light terms of as many postings each: what two of them change beyond what each changes alone."""
        for i in range(sources.shape[1]):
            for j in range(sources.shape[1]):
                if i != j:
                    a, b, pa_, pb = sources[:, i], sources[:, j], p[:, i], p[:, j]
                    more = apart(pa_, pb) - apart(pa_, self.none[b]) - apart(self.none[a], pb) + self.base[a, b]
                    np.add.at(self.sums, (a, b), more)

    def total(self, terms: int) -> np.ndarray:
        """The sums, and terms times what a term gives that neither source has."""
        out = self.sums + terms * self.base
        for s, held in enumerate(self.light):
            if held:
                p, n = np.array(list(held), np.int64), np.array(list(held.values()), np.int64)
                out[s] += ((apart(p[:, None], self.none[None, :]) - self.base[s]) * n[:, None]).sum(axis=0)
                out[:, s] += ((apart(self.none[None, :], p[:, None]) - self.base[:, s]) * n[:, None]).sum(axis=0)
        return out


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums by pair of sources, of rows (lang, a, b, tile, term, sources, counts, total, kept) in the order of their tiles, a tile's sources
    (with their totals and no term) before its terms. Pairs of one block (a = b) or of two; in two blocks only pairs across them."""
    key, made, first, second, rows, names = None, None, [], [], [], []

    def flush() -> None:
        if rows:
            sizes = np.array([len(s) for s, _ in rows])
            made.add(np.array([names[x] for s, _ in rows for x in s], np.int64), np.array([x for _, n in rows for x in n], np.int64), sizes)
            rows.clear()

    def done() -> Iterator[pa.RecordBatch]:
        if key is None or not first:
            return
        if made is None:
            start()
        flush()
        sums = made.total(key[4] if key[3] == 0 else 0) if made else None
        own = {s for s, _ in first}
        all_ = [s for s, _ in first + second]
        for i, s in enumerate(all_):
            others = [j for j in range(len(all_)) if j != i and (not second or (s in own) != (all_[j] in own))]
            if others:
                values = [int(sums[i, j]) for j in others] if made else [0] * len(others)
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(others)), pa.array([s] * len(others)), pa.array([all_[j] for j in others]), pa.array(values, pa.int64())], ["lang", "source", "item", "value"])

    def start() -> None:
        nonlocal made, names
        both = first + second
        names = {s: k for k, (s, _) in enumerate(both)}
        made = PairSums([t for _, t in both], key[4]) if key[4] else None

    for b in batches:
        for lang, x, y, tile, block, sources, counts, total, kept in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key is None or key[:4] != (lang, x, y, tile):
                yield from done()
                key, made, first, second = (lang, x, y, tile, kept), None, [], []
                rows.clear()
            if block is not None:
                (first if block == x else second).append((sources[0], total))
                continue
            if made is None:
                start()
            rows.append((sources, counts))
            if len(rows) >= 4 * STEP:
                flush()
    yield from done()


def postings(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, n, sources, counts) of the kept terms: one shuffle, of counts that each task has summed."""
    spark = df.sparkSession
    counted = df.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"), text_or_empty(text_col).alias("text"))
    counted = counted.mapInArrow(_counts, "lang string, source string, term string, n long, docs long").repartition(partitions(spark), "lang", "term")
    each = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    all_ = each.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", F.col("n").alias("count"))).alias("p"))
    return all_.where(F.col("docs") >= least_docs).select("lang", "term", "n", F.col("p.source").alias("sources"), F.col("p.count").alias("counts"))


def group_totals(df: DataFrame, kept: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, total, kept, lang_total) of every group that occurs: its occurrences of kept terms, the language's kept terms and theirs."""
    seen = df.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source")).distinct()
    each = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("p")).groupBy("lang", F.col("p.sources").alias("source")).agg(F.sum("p.counts").alias("total"))
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("lang_total"))
    all_ = seen.join(each, ["lang", "source"], "left").join(of_lang, "lang", "left")
    return all_.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "kept", "lang_total")])


def source_pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each two sources of a language.

    Sources go into blocks; a tile is two blocks (or one) and a share of a language's terms, so no task holds more than
    two blocks' sums, and a hot language is many tiles. Terms go where one of their sources is.
    """
    spark = kept.sparkSession
    most = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")).agg(F.max("n"), F.max("kept")).first()
    blocks = max(1, -(-(most[0] or 0) // BLOCK))
    tiles = max(LEAST_TILES, -(-(most[1] or 0) // TILE))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    key = ["lang", "a", "b", "tile"]
    named = groups.withColumn("block", block("source")).withColumn("other", every).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    heads = named.select("lang", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "tile", "block", F.array("source").alias("sources"), F.expr("cast(null as array<bigint>)").alias("counts"), "total", "kept")
    placed = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(tiles)).cast("int").alias("tile"), F.arrays_zip("sources", "counts").alias("p"))
    if blocks == 1:
        spread = placed.select("lang", F.lit(0).alias("a"), F.lit(0).alias("b"), "tile", "p")
    else:
        touched = F.array_distinct(F.transform("p", lambda x: block(x["sources"])))
        two = placed.withColumn("x", F.explode(touched)).withColumn("y", every).select("lang", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "tile", "p", "x", touched.alias("touched"))
        # a tile of two blocks gets a term once, though both have it
        once = two.where(~((F.col("x") == F.col("b")) & (F.col("a") != F.col("b")) & F.array_contains("touched", F.col("a"))))
        spread = once.select("lang", "a", "b", "tile", F.filter("p", lambda x: block(x["sources"]).isin(F.col("a"), F.col("b"))).alias("p"))
    none = F.lit(None)
    terms = spread.select(*key, none.cast("int").alias("block"), F.col("p.sources").alias("sources"), F.col("p.counts").alias("counts"), none.cast("long").alias("total"), none.cast("long").alias("kept"))
    dealt = heads.unionAll(terms).repartition(partitions(spark), *key).sortWithinPartitions(*key, F.col("block").isNull())
    parts = dealt.mapInArrow(_tiles, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def over_used(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms that a group has, and has more of than its language."""
    each = kept.select("lang", "term", "n", F.explode(F.arrays_zip("sources", "counts")).alias("p")).select("lang", "term", "n", F.col("p.sources").alias("source"), F.col("p.counts").alias("count"))
    share = lambda n, total: f"1 + (cast({n} + 1 as decimal(20,0)) * {UNIT}BD) div cast({total} + kept as decimal(20,0))"
    both = each.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), F.expr(share("count", "total")).alias("p"), F.expr(share("n", "lang_total")).alias("q"))
    return both.where("p > q").select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))


def audit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", terms: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: for each group of documents (lang, source) how far its terms are from each other source's of
    the language (part pair, all of them), and the terms that it over-uses most (part term, ranks to terms).

    Null text, lang and source count as ''. A language's kept terms are those that LEAST_DOCS of its documents have. A group without terms
    has its rows too; a language without kept terms gives pairs of value 0 and no terms. Repeated rows count each. Ranks go by value,
    then by item in the order of its UTF-8 bytes. Other columns are not read. An empty table gives no rows. Texts are read once and stay where they are.
    """
    spark = df.sparkSession
    kept, _ = keep(spark, postings(df, text_col, lang_col, source_col), "postings")
    groups, _ = keep(spark, group_totals(df, kept, lang_col, source_col), "groups")
    order = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    part = lambda rows, name: rows.withColumn("rank", order).select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(source_pairs(kept, groups), "pair").unionAll(part(over_used(kept, groups), "term").where(F.col("rank") <= terms))


ORACLE = r"""
with d as (select row_number() over () as k, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
w as (select k, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
kept as (select lang, term, count(*) as n from w group by lang, term having count(distinct k) >= 3),
langs as (select lang, count(*) as v, sum(n) as total from kept group by lang),
groups as (select distinct lang, source from d),
held as (select lang, source, term, count(*) as c from w semi join kept using (lang, term) group by all),
sums as (select lang, source, coalesce(v, 0) as v, coalesce(langs.total, 0) as lang_total, coalesce(sum(c), 0) as total from groups left join langs using (lang) left join held using (lang, source) group by all),
p as (
    select lang, source, term, coalesce(c, 0) as c, 1 + (1000000000::hugeint * (coalesce(c, 0) + 1)) // (total + v) as p, 1 + (1000000000::hugeint * (n + 1)) // (lang_total + v) as q
    from sums join kept using (lang) left join held using (lang, source, term)
),
pairs as (
    select lang, a.source, b.source as item, cast(sum((a.p - b.p) * (a.p - b.p) // b.p) as bigint) as value
    from p a join p b using (lang, term) where a.source <> b.source group by all
),
every as (
    select lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from groups a join groups b using (lang)
    left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source where a.source <> b.source
    union all
    select lang, source, 'term', term, cast((p - q) * (p - q) // q as bigint) from p where c > 0 and p > q
)
select lang, source, part, item, value, cast(rank as integer) as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from every) where part = 'pair' or rank <= 200
"""
