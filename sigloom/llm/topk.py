"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

A vector is a sparse row of (term, weight): its places and the integers there that are not 0. Candidates are dealt into shards;
a shard keeps, for each term, the postings (candidate, weight) of its tiles. Queries come in packs: for each term in turn their
weights times those of the term's postings are added into a dense array of scores, one for each candidate of a tile and query of a pack.
A partition selection leaves each query's best of a tile, and the best of all shards are merged by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.llm.common import keep

#: Candidates of a shard on average, at most; shards at least; candidates of a tile; queries of a pack on average.
SHARD, SHARDS, TILE, PACK = 1 << 16, 64, 4096, 64
_LONG = 1 << 63
_ITEM = "struct<row:bigint,id:bigint,terms:array<int>,weights:array<bigint>>"


def integers(vector: str, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component x as double; null where the vector or a component is null or not finite."""
    x = F.col(vector)
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != F.lit(float("inf"))))
    return F.when(whole, F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("bigint")))


def sparse_rows(df: DataFrame, id_col: str, vector: str, scale: float) -> DataFrame:
    """(row, id, terms, weights); row tells rows apart that repeat an id. Rows that take no part are left out."""
    ints = df.select(F.col(id_col).cast("long").alias("id"), integers(vector, scale).alias("v")).where("v is not null")
    term = F.filter(F.sequence(F.lit(0), F.size("v") - 1), lambda k: F.get("v", k) != 0)
    terms = F.when(F.size("v") > 0, term).otherwise(F.expr("cast(array() as array<int>)"))
    rows = ints.select(F.monotonically_increasing_id().alias("row"), "id", terms.alias("terms"), "v")
    return rows.select("row", "id", "terms", F.transform("terms", lambda k: F.get("v", k)).alias("weights"))


class _Rows:
    """Sparse rows as flat arrays: row n holds terms[at[n]:at[n + 1]]."""

    def __init__(self, items: pa.StructArray):
        lists = items.field("terms")
        self.row, self.id = items.field("row").to_numpy(), items.field("id").to_numpy(zero_copy_only=False)
        self.known = items.field("id").is_valid().to_numpy(zero_copy_only=False)
        self.at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
        self.terms = lists.flatten().to_numpy()
        self.weights = items.field("weights").flatten().to_numpy()
        self.of = np.repeat(np.arange(len(items)), np.diff(self.at))

    def most(self) -> int:
        return int(max(self.weights.max(initial=0), -int(self.weights.min(initial=0))))


class Shard:
    """Candidates of a shard by id (null ids last), in tiles of postings by term."""

    def __init__(self, items: pa.StructArray):
        c = _Rows(items)
        order = np.lexsort((c.row, np.where(c.known, c.id, 0), ~c.known))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.row = c.row[order]
        self.id = [int(c.id[k]) if c.known[k] else None for k in order]
        self.most, self.width = c.most(), int(np.diff(c.at).max(initial=0))
        at = place[c.of]
        by = np.lexsort((at, c.terms, at // TILE))
        at, terms, weights = at[by], c.terms[by], c.weights[by]
        tile = at // TILE
        edge = np.flatnonzero(np.diff(tile, prepend=-1) | np.diff(terms, prepend=-1))
        self.postings: list[dict[int, tuple]] = [{} for _ in range(-(-len(order) // TILE))]
        for a, b in zip(edge, [*edge[1:], len(at)], strict=True):
            self.postings[tile[a]][int(terms[a])] = (at[a:b] - tile[a] * TILE, weights[a:b])

    def best(self, q: _Rows, k: int) -> Iterator[tuple[int, list[int], list[tuple[int, int]]]]:
        """For each query of a pack: its place in the pack, scores and places of its k best candidates, ties to the first in order."""
        n, bound = len(q.row), self.most * q.most() * max(1, min(self.width, int(np.diff(q.at).max(initial=0))))
        kind = np.int32 if bound < 1 << 31 else np.int64 if bound < _LONG else object
        by_term = np.lexsort((q.of, q.terms))
        edge = np.flatnonzero(np.diff(q.terms[by_term], prepend=-1))
        terms = [(int(q.terms[by_term[a]]), by_term[a:b]) for a, b in zip(edge, [*edge[1:], len(by_term)], strict=True)]
        found: list[list[tuple]] = [[] for _ in range(n)]
        for tile, postings in enumerate(self.postings):
            first = tile * TILE
            size = min(TILE, len(self.row) - first)
            scores = np.zeros((size, n), kind)
            for term, who in terms:
                if term in postings:
                    at, weight = postings[term]
                    mine = np.zeros(n, kind)
                    mine[q.of[who]] = q.weights[who]
                    add = weight.astype(kind)[:, None] * mine[None, :]
                    if len(at) == size:
                        scores += add
                    else:
                        scores[at] += add
            # one more than k, as the query's own row may be among them
            least = np.partition(scores, size - k - 1, axis=0)[size - k - 1] if size > k + 1 else scores.min(axis=0)
            for j in range(n):
                at = np.flatnonzero(scores[:, j] >= least[j])
                at = at[self.row[first + at] != q.row[j]]
                got = scores[at, j]
                at = at[np.argsort(-got, kind="stable")[:k]]
                found[j].append((scores[at, j], first + at))
        for j in range(n):
            got, at = (np.concatenate([f[x] for f in found[j]]) for x in (0, 1))
            pick = np.argsort(-got, kind="stable")[:k]
            yield j, [int(x) for x in got[pick]], [int(x) for x in at[pick]]


def _searched(k: int):
    names = ["query", "query_id", "scores", "ids"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, now, held = None, None, []
        for b in batches:
            numbers, asking = b.column(0).to_pylist(), b.column(1).to_pylist()
            for n, (number, query) in enumerate(zip(numbers, asking, strict=True)):
                if number != now:
                    shard, now, held = None, number, []
                items = b.column(2).slice(n, 1).flatten()
                if not query:
                    held.append(items)
                    continue
                if shard is None:
                    shard = Shard(pa.concat_arrays(held)) if held else False
                    held = []
                if shard:
                    q = _Rows(items)
                    out = []
                    for j, scores, at in shard.best(q, k):
                        if scores and max(scores[0], -scores[-1]) >= _LONG:
                            raise OverflowError("a score does not fit 64 bits")
                        out.append((int(q.row[j]), int(q.id[j]), scores, [shard.id[x] for x in at]))
                    yield pa.RecordBatch.from_arrays([pa.array([r[x] for r in out], kinds[x]) for x in range(4)], names)

    return run


def top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best inner products of each query over every row but its own, all if there are fewer.

    Components become floor(scale * x). Rows whose vector is null, or holds a null, NaN or infinity, take no part. is_query
    says over the columns row, id, terms and weights which rows ask; a null answer or id asks nothing. Ties go to the smaller id, null ids last. Rows
    that repeat an id are a query and a candidate each. Vectors of unequal lengths meet where both have components; an empty one scores 0
    with all. Scores are exact; one beyond 64 bits ends the job, and components are cut to 64 bits. Other columns are not read. An empty table gives no rows.

    Each shard of at most some SHARD candidates is one task's index; packs of queries, few rows, go to every shard. All pairs of the stated query
    set with all rows are scored, in blocks; none is a row of any plan. What is merged is k rows a query and shard, ranked in each task first.
    """
    spark = df.sparkSession
    rows, _ = keep(spark, sparse_rows(df, id_col, vector, scale), "vectors")
    asking = rows.where(F.coalesce(is_query, F.lit(False)) & F.col("id").isNotNull())
    n, m = rows.count(), asking.count()
    shards, packs = max(SHARDS, -(-n // SHARD)), max(1, -(-m // PACK))
    item = F.struct("row", "id", "terms", "weights")
    candidates = rows.select(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("query"), F.array(item).alias("items"))
    packed = asking.groupBy(F.pmod(F.xxhash64("row"), F.lit(packs)).alias("pack")).agg(F.collect_list(item).alias("items"))
    everywhere = packed.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("query"), "items")
    dealt = candidates.unionAll(everywhere).withColumn("items", F.col("items").cast(f"array<{_ITEM}>"))
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "query")
    found = dealt.mapInArrow(_searched(k), "query long, query_id long, scores array<bigint>, ids array<bigint>")
    each = found.select("query", "query_id", F.explode(F.arrays_zip("scores", "ids")).alias("c")).select("query", "query_id", F.col("c.ids").alias("vec_id"), F.col("c.scores").alias("score"))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return each.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as w from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.w, c.w) as bigint) as score
    from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 20
"""
