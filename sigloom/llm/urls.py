"""URL filters: fixed rules, and a Bloom filter cascade that is exact over a known universe of keys."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import forget, keep, partitions

#: Host, path prefix, verdict.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Most bits of all filters that go to every task; larger cascades travel to the rows by parts of the key space.
MOST_BITS = 1 << 28
#: Keys of a part of the key space, each of which has a cascade of its own.
PART_KEYS = 1 << 20
#: Parts that rows of one part of the key space are salted into, where they are dealt out by part.
SALT = 16
BITS_A_KEY, HASHES = 8, 4
#: Levels at which a cascade has to be done; each lets one key in forty through.
MOST_LEVELS = 64


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), upper, lower)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    name, what = None, None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        what = F.when(fits, verdict) if what is None else what.when(fits, verdict)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if name is None else (name, what)


def part_of(key: str, parts: int) -> int:
    """The part of the key space a key is in; the same number as _part gives in the cluster."""
    h = xxhash.xxh64_intdigest(key.encode(), seed=42)
    return (h - (1 << 64) if h >> 63 else h) % parts


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts).cast("long")).cast("int")


def _positions(keys: list[str], level: int, bits: int, hashes: int = HASHES) -> np.ndarray:
    h = [xxhash.xxh3_128_intdigest(k.encode(), seed=level) for k in keys]
    a = np.array([x & 0xFFFFFFFFFFFFFFFF for x in h], np.uint64)
    b = np.array([x >> 64 | 1 for x in h], np.uint64)
    return np.stack([(a + np.uint64(i) * b) % np.uint64(bits) for i in range(hashes)]) if keys else np.zeros((hashes, 0), np.uint64)


def _passes(f: np.ndarray, keys: list[str], level: int) -> np.ndarray:
    p = _positions(keys, level, len(f) * 8)
    return ((f[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def listed(filters: list[np.ndarray], keys: list[str]) -> np.ndarray:
    """Whether keys are listed, by the filters of their part, exact for the universe's keys: how many levels a key passes tells.

    Even levels hold listed keys, odd ones the unlisted keys that the level before lets through.
    """
    out = np.zeros(len(keys), bool)
    open_ = np.arange(len(keys))
    for level, f in enumerate(filters):
        inside = _passes(f, [keys[i] for i in open_], level)
        out[open_] = inside if level % 2 == 0 else ~inside
        open_ = open_[inside]
    if len(filters) and len(open_):
        out[open_] = len(filters) % 2 == 1
    return out


def _beside(filters: DataFrame, rows: DataFrame, parts: int, salt: int) -> DataFrame:
    """rows (part, key, row) dealt out by part, salted, each group after the filters (part, level, bits) it needs; no join, and a group is a stream."""
    empty = rows.schema["row"].dataType
    heads = filters.select("part", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("salt"), "level", "bits", F.lit(None).cast("string").alias("key"), F.lit(None).cast(empty).alias("row"))
    spread = (F.xxhash64(F.monotonically_increasing_id()) % salt).cast("int")
    body = rows.select("part", F.abs(spread).alias("salt"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("binary").alias("bits"), "key", "row")
    n = min(partitions(rows.sparkSession), parts * salt)
    return heads.unionAll(body).repartition(n, "part", "salt").sortWithinPartitions("part", "salt", F.asc_nulls_last("level")).select("part", "salt", "bits", "key", "row")


def _judged(verdict: Callable[[list[np.ndarray], list[str]], np.ndarray]) -> Callable:
    """A function over batches of _beside: key, row and what verdict says of the key by its part's filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at = None
        for b in batches:
            where = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            bits = b.column(2)
            edges = [k for k in range(len(where)) if k == 0 or where[k] != where[k - 1]] + [len(where)]
            for first, end in zip(edges[:-1], edges[1:], strict=True):
                if where[first] != at:
                    held, at = [], where[first]
                body = first
                while body < end and bits[body].is_valid:
                    held.append(np.frombuffer(bits[body].as_py(), np.uint8))
                    body += 1
                if body < end:
                    keys = b.column(3).slice(body, end - body)
                    once = list(dict.fromkeys(keys.to_pylist()))
                    known = dict(zip(once, verdict(held, once).tolist(), strict=True))
                    yield pa.RecordBatch.from_arrays([keys, b.column(4).slice(body, end - body), pa.array([known[k] for k in keys.to_pylist()], pa.bool_())], ["key", "row", "listed"])

    return run


class Cascade:
    """table: rows (part, level, bits) in the shared folder. bits: of all of them."""

    def __init__(self, table: DataFrame, parts: int, bits: int, paths: list[str]):
        self.table, self.parts, self.bits, self.paths = table, parts, bits, paths

    def local(self) -> dict[int, list[np.ndarray]]:
        """The filters of each part; for at most MOST_BITS."""
        out: dict[int, list[np.ndarray]] = {}
        for r in self.table.orderBy("part", "level").collect():
            out.setdefault(r["part"], []).append(np.frombuffer(r["bits"], np.uint8))
        return out

    def listed(self, keys: list[str]) -> np.ndarray:
        return listed_by(self.local(), self.parts, keys)


def listed_by(filters: dict[int, list[np.ndarray]], parts: int, keys: list[str]) -> np.ndarray:
    out = np.zeros(len(keys), bool)
    by: dict[int, list[int]] = {}
    for i, k in enumerate(keys):
        by.setdefault(part_of(k, parts), []).append(i)
    for p, at in by.items():
        out[at] = listed(filters.get(p, []), [keys[i] for i in at])
    return out


def _level(wanted: DataFrame, sizes: dict[int, int], level: int) -> DataFrame:
    """(part, level, bits): one filter for each part, made where the part's keys are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, f = None, None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([level], pa.int32()), pa.array([f.tobytes()], pa.binary())], ["part", "level", "bits"])

        for b in batches:
            part = b.column(0).to_numpy(zero_copy_only=False)
            for p in dict.fromkeys(part.tolist()):
                if p != at:
                    if at is not None:
                        yield made()
                    at, f = p, np.zeros(8 * math.ceil(max(64, sizes[p] * BITS_A_KEY) / 64), np.uint8)
                keys = b.column(1).filter(pa.array(part == p)).to_pylist()
                spot = np.unique(_positions(keys, level, len(f) * 8))
                np.bitwise_or.at(f, (spot >> np.uint64(3)).astype(np.int64), np.uint8(1) << (spot & np.uint64(7)).astype(np.uint8))
        if at is not None:
            yield made()

    n = min(partitions(wanted.sparkSession), max(1, len(sizes)))
    return wanted.repartition(n, "part").sortWithinPartitions("part").mapInArrow(run, "part int, level int, bits binary")


def build(universe: DataFrame, part_keys: int = PART_KEYS) -> Cascade:
    """A cascade for universe (key string, listed boolean; keys distinct and not null), in parts of about part_keys keys each."""
    spark = universe.sparkSession
    parts = max(1, math.ceil(universe.count() / part_keys))
    rows = universe.select(_part(F.col("key"), parts).alias("part"), "key", "listed")
    wanted, wanted_path = keep(spark, rows.where("listed").select("part", "key"), "listed")
    other, other_path = keep(spark, rows.where("not listed").select("part", "key"), "unlisted")
    table, paths, bits = None, [], 0
    for level in range(MOST_LEVELS + 1):
        sizes = {r["part"]: r["count"] for r in wanted.groupBy("part").count().collect()}
        if level and not sizes:
            break
        if level == MOST_LEVELS:
            raise RuntimeError("the cascade does not end: the universe holds a key twice")
        bits += sum(max(64, n * BITS_A_KEY) for n in sizes.values())
        now, path = keep(spark, _level(wanted, sizes, level), "filters")
        paths.append(path)
        table = now if table is None else table.unionAll(now)
        through = _judged(lambda held, keys, level=level: _passes(held[0], keys, level) if held else np.zeros(len(keys), bool))
        asked = other.select("part", "key", F.lit(0).alias("row"))
        false, path = keep(spark, _beside(now, asked, parts, 1).mapInArrow(through, "key string, row int, listed boolean").where("listed").select(_part(F.col("key"), parts).alias("part"), "key"), "false")
        forget(spark, other_path)
        wanted, other, wanted_path, other_path = false, wanted, path, wanted_path
    forget(spark, wanted_path, other_path)
    return Cascade(table, parts, bits, paths)


def listed_hosts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The universe of host keys (key, listed). Listed: hosts that serve a page over plain http; a hot host is pre-aggregated in each task."""
    host, _ = host_and_path(F.col(url_col))
    plain = F.lower(F.coalesce(F.col(url_col), F.lit(""))).startswith("http://")
    return pages.select(host.alias("key"), plain.alias("plain")).groupBy("key").agg(F.max("plain").alias("listed"))


def judge(pages: DataFrame, universe: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, most_bits: int = MOST_BITS, part_keys: int = PART_KEYS) -> DataFrame:
    """id, host, path, rule, verdict of every row. Null urls and those without :// have an empty host and path, which is a key too.

    No rule: block if the host is listed. The cascade is exact because the universe has every host of the pages. Up to most_bits its
    filters go to every task; a larger cascade's go to the rows, which are dealt out by part of the key space, a hot host's salted.
    Repeated rows, null ids and ties are judged each by its url alone; an empty table gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    universe, path = keep(spark, universe, "universe")
    cascade = build(universe, part_keys)
    forget(spark, path)
    host, rest = host_and_path(F.col(url_col))
    rows = pages.select(host.alias("key"), F.struct(F.col(id_col).alias("id"), rest.alias("path")).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    if cascade.bits <= most_bits:
        filters, parts = cascade.local(), cascade.parts
        forget(spark, *cascade.paths)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys = b.column(0).to_pylist()
                once = list(dict.fromkeys(keys))
                known = dict(zip(once, listed_by(filters, parts, once).tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([known[k] for k in keys], pa.bool_())], ["key", "row", "listed"])

        rows = rows.mapInArrow(run, f"key string, row {kind}, listed boolean")
    else:
        dealt = _beside(cascade.table, rows.select(_part(F.col("key"), cascade.parts).alias("part"), "key", "row"), cascade.parts, SALT)
        rows = dealt.mapInArrow(_judged(listed), f"key string, row {kind}, listed boolean")
    rows = rows.select(F.col("row.id").alias(id_col), F.col("key").alias("host"), F.col("row.path").alias("path"), "listed")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.select(id_col, "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def oracle(rules=RULES) -> str:
    """DuckDB SQL for judge() with listed_hosts(): the same verdicts by a window instead of filters."""
    fits = [(h + p, v, f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')") for h, p, v in sorted(rules, key=lambda r: -len(r[0]) - len(r[1]))]
    case = lambda i: "case " + " ".join(f"when {x[2]} then '{x[i]}'" for x in fits) + " end"
    return rf"""
with r as (select page_id, coalesce(url, '') as u, case when contains(coalesce(url, ''), '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, starts_with(lower(u), 'http://') as plain, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
q as (select *, max(plain) over (partition by host) as listed from p)
select page_id, host, path, {case(0)} as rule, coalesce({case(1)}, case when listed then 'block' else 'allow' end) as verdict from q
"""


__all__ = ["Cascade", "RULES", "build", "host_and_path", "judge", "listed_hosts", "oracle", "rule_of"]
