"""Exact n-gram Jaccard join for connected near-duplicates, in a metric space of shingle sets.

Jaccard distance is a metric, so is the size of the symmetric difference; sets with similarity 3/4 or more differ in at most
a seventh of their sizes' sum. Sets that can link share one of their first n - ceil(3n/4) + 1 shingles in any common
order (here: frequent shingles last). Such a shared shingle is a neighbourhood. Its least and its largest set are its pivots;
every other set's exact distance to them comes first, and what links to a pivot is in its component without any pair being
made. Neighbourhoods that still hold several components are split into windows by size (the distance to the empty
set), boundary sets go to both windows, and each region is joined recursively: Voronoi cells of more pivots, with
the sets within the triangle inequality's window replicated, down to blocks. Distances there are between parity sketches, a
metric that never exceeds the symmetric difference, so nothing is lost; the pairs left are verified on the sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.llm.common import forget, keep, one_each, only, partitions, sent, slim, text_or_empty
from sigloom.llm.words import mix, window_hashes, word_hashes

#: Frequent shingles that come last in the common order: a broadcast of at most so many 64-bit numbers. Any list gives the same result.
MOST_HOT, HOT_BUFFER, HOT_IN_BUFFER, HOT = 1 << 20, 3_000_000, 2, 4
#: Sets of a region that are compared in blocks without more pivots, and pivots of a larger one.
LEAF, PIVOTS = 256, 8
SHINGLE = 5
#: Further pivots of each neighbourhood that the first two leave in several components.
MORE_PIVOTS = 6
#: Neighbourhoods of at most so many sets are one task's group, and split into windows there.
WHOLE = 1024
#: Sets of a region that are compared one by one.
FEW = 12
#: Sets of a neighbourhood that are held against each other for a partner; of larger ones all stay.
COMPARED = 64
#: Most numbers of sets that stand for several sets; of 10^10 sets about three do.
MOST_SHARED = 100_000
#: Least neighbourhoods of a set that tell which one reports a pair.
LOW = 16


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text, A-Z lower-cased."""
    return np.unique(window_hashes(word_hashes(text.encode().lower().split()), size))


def linked(overlap: int, a: int, b: int) -> bool:
    return 100 * overlap >= 75 * (a + b - overlap)


def sketch(values: np.ndarray) -> bytes:
    """Parity sketch: bit h mod 2^k is the parity of the shingles there. Its Hamming distance to another is at most the symmetric difference."""
    bits = max(256, 2 << (len(values) - 1).bit_length())
    ones = np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(ones.astype(np.uint8)).tobytes()


def fold(s: bytes, size: int) -> np.ndarray:
    x = np.frombuffer(s, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def identity(values: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """128 bits that tell a set: the number it goes by, of that many bits, and one that tells sets apart which share the first."""
    h = xxhash.xxh3_128_intdigest(values.tobytes())
    return ((h & (1 << 64) - 1) >> 64 - bits) - (1 << 63), (h >> 64) - (1 << 63)


class Names:
    """Numbers of sets. Sets whose first 64 bits meet are in shared; both halves name those."""

    def __init__(self, bits: int = 64, shared: frozenset[int] = frozenset()):
        self.bits, self.shared = bits, shared

    def __call__(self, values: np.ndarray) -> int:
        node, other = identity(values, self.bits)
        return node ^ other if node in self.shared else node


def _mark(text_col: str) -> Column:
    """What tells a row from others with its id, or with none: a hash of its text."""
    return F.xxhash64(text_or_empty(text_col))


def _profile(docs: DataFrame, id_col: str, text_col: str, bits: int) -> DataFrame:
    """Rows of documents (id, mark of the text, n, identity as node and other, sketch) and of locally frequent shingles (hot, times)."""
    kind = dict(docs.dtypes)[id_col]

    def frequent(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        h, n = h[n >= HOT_IN_BUFFER], n[n >= HOT_IN_BUFFER]
        k = len(h)
        return pa.RecordBatch.from_arrays([pa.nulls(k, id_type[0]), *[pa.nulls(k, pa.int64())] * 4, pa.nulls(k, pa.binary()), pa.array(h.view(np.int64)), pa.array(n)], names)

    names = [id_col, "_mark", "n", "node", "other", "sketch", "hot", "times"]
    id_type: list[pa.DataType] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("jaccard")
        held, size, seen = [], 0, set()
        for b in batches:
            id_type[:] = [b.column(0).type]
            n, name, sk = [], [], []
            for text in b.column(2).to_pylist():
                v = shingles(text)
                n.append(len(v))
                name.append(identity(v, bits) if len(v) else (None, None))
                fresh = len(v) > 0 and name[-1] not in seen
                sk.append(sketch(v) if fresh else None)
                if fresh:
                    seen.add(name[-1])
                    held.append(v)
                    size += len(v)
            if len(seen) > 200_000:
                seen.clear()
            k = len(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), *(pa.array([x[i] for x in name], pa.int64()) for i in (0, 1)), pa.array(sk, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names)
            if size >= HOT_BUFFER:
                yield frequent(held)
                held, size = [], 0
        if held:
            yield frequent(held)
        del held, seen
        slim()

    return docs.select(id_col, _mark(text_col).alias("_mark"), text_or_empty(text_col).alias("_t")).mapInArrow(run, f"`{id_col}` {kind}, _mark long, n long, node long, other long, sketch binary, hot long, times long")


def _signatures(docs: DataFrame, text_col: str, names: Names, hot: np.ndarray, rank: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, sig, node) as packed binaries: the first shingles of each distinct set in the common order. Copies met in one task count once.

    The low 8 bits of a sig give way to its place, in 256ths of the set; they choose candidates only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("jaccard")
        seen: set[int] = set()
        for b in batches:
            sigs, nodes, sizes = [], [], []
            for text in b.column(0).to_pylist():
                v = shingles(text)
                n = len(v)
                if not n or (node := names(v)) in seen:
                    continue
                seen.add(node)
                if len(hot):
                    at = np.searchsorted(hot, v)
                    at[at == len(hot)] = 0
                    late = np.where(hot[at] == v, rank[at], 0)
                    if late.any():
                        v = v[np.lexsort((v, late))]
                v = v[: n - (75 * n + 99) // 100 + 1]
                sigs.append(v & ~np.uint64(255) | (np.arange(len(v)) * 256 // n).astype(np.uint64))
                nodes.append(np.full(len(v), node, np.int64))
                sizes.append(np.full(len(v), n, np.uint32))
            if len(seen) > 200_000:
                seen.clear()
            if not sigs:
                continue
            s, d, m = np.concatenate(sigs), np.concatenate(nodes), np.concatenate(sizes)
            to = (s >> np.uint64(33)) % np.uint64(buckets)
            order = np.argsort(to, kind="stable")
            to, s, d, m = to[order], s[order], d[order], m[order]
            which, first = np.unique(to, return_index=True)
            last = [*first[1:].tolist(), len(to)]
            blobs = []
            for x, y in zip(first.tolist(), last, strict=True):
                start = np.flatnonzero(np.r_[True, d[x + 1 : y] != d[x : y - 1]])
                count = np.diff(np.r_[start, y - x]).astype("<u4")
                blobs.append(np.uint32(len(start)).tobytes() + d[x:y][start].tobytes() + m[x:y][start].tobytes() + count.tobytes() + s[x:y].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "blob"])
        slim()

    return docs.select(text_or_empty(text_col).alias("_t")).mapInArrow(run, "bucket int, blob binary")


def _unpack(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sigs, nodes, sizes = [], [], []
    for x in blobs:
        k = int(np.frombuffer(x, "<u4", 1)[0])
        node, size, count = np.frombuffer(x, "<i8", k, 4), np.frombuffer(x, "<u4", k, 4 + 8 * k), np.frombuffer(x, "<u4", k, 4 + 12 * k)
        nodes.append(np.repeat(node, count))
        sizes.append(np.repeat(size, count))
        sigs.append(np.frombuffer(x, "<u8", -1, 4 + 16 * k))
    return np.concatenate(sigs), np.concatenate(nodes), np.concatenate(sizes).astype(np.int64)


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Whether each sorted row differs from the one before."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = False
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def neighbourhoods(sig: np.ndarray, node: np.ndarray, n: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(neighbourhood, node, n, most) of the rows that may link within their neighbourhood.

    Where the shared shingle is the first of a pair in the common order, what both hold is at most what is left of each from there
    on; a link holds 3/7 of the sizes' sum. So a set links, there, with sets of at most most = 7/3 of what is left, less its
    own size. A shingle's sets are split by size where none below reaches one above, and sets without a partner go.
    """
    most = 7 * n * (256 - place) // 768 - n
    order = np.lexsort((-most, node, n, sig))
    sig, node, n, most = sig[order], node[order], n[order], most[order]
    once = _changes(sig, node)
    sig, node, n, most = sig[once], node[once], n[once], most[once]
    new = _changes(sig)
    apart = (np.cumsum(new) - 1) * (int(most.max(initial=0)) - int(most.min(initial=0)) + 1)
    furthest = np.maximum.accumulate(most + apart) - apart
    new[1:] |= furthest[:-1] < n[1:]
    group = np.cumsum(new) - 1
    size = np.bincount(group)[group]
    found = size > COMPARED
    for d in range(1, COMPARED):
        a = np.flatnonzero((size[:-d] > d) & (group[:-d] == group[d:]) & (n[d:] <= most[:-d]))
        if not (size > d).any():
            break
        a = a[n[a] <= most[a + d]]
        found[a] = found[a + d] = True
    name = mix(sig * np.uint64(0x9E3779B97F4A7C15) + n[np.flatnonzero(new)][group].astype(np.uint64))
    return name[found], node[found], n[found], most[found]


def _neighbourhoods(signatures: DataFrame, parts: int) -> DataFrame:
    """Shared signatures: rows (a, b) that pair a set with a pivot, and rows (sig, a, n) of neighbourhoods of three sets or more."""

    def solve(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        s, d, n = _unpack(blobs)
        s, d, n, most = neighbourhoods(s >> np.uint64(8), d, n, (s & np.uint64(255)).astype(np.int64))
        if not len(s):
            return
        order = np.lexsort((d, s))
        s, d, n, most = s[order], d[order], n[order], most[order]
        first = np.flatnonzero(_changes(s))
        size = np.diff(np.r_[first, len(s)])
        pairs = []
        for at in (first, first + size - 1):
            pivot = np.repeat(at, size)
            ok = (d != d[pivot]) & (n <= most[pivot]) & (n[pivot] <= most)
            pairs.append(np.stack([np.maximum(d, d[pivot])[ok], np.minimum(d, d[pivot])[ok]], 1))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        more = np.repeat(size, size) > 2
        none = lambda k, kind: pa.nulls(k, kind)
        k = int(more.sum())
        yield pa.RecordBatch.from_arrays([none(len(pairs), pa.int64()), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), none(len(pairs), pa.int32())], ["sig", "a", "b", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(s[more].view(np.int64)), pa.array(d[more]), none(k, pa.int64()), pa.array(n[more].astype(np.int32))], ["sig", "a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if bucket != at and held:
                    yield from solve(held)
                    held = []
                at = bucket
                held.append(blob)
        if held:
            yield from solve(held)
        del held
        slim()

    return signatures.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "sig long, a long, b long, n int")


def _close(na: int, nb: int, sa: bytes, sb: bytes) -> bool:
    """Whether two sets may link, by sizes and sketches; never false for a link."""
    if 4 * min(na, nb) < 3 * max(na, nb):
        return False
    if len(sa) != len(sb):
        size = min(len(sa), len(sb))
        sa, sb = fold(sa, size).tobytes(), fold(sb, size).tobytes()
    return 7 * (int.from_bytes(sa) ^ int.from_bytes(sb)).bit_count() <= na + nb


def _may_link(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """Pairs (a, b) that sizes and sketches leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, na, nb, sa, sb = (x.to_pylist() for x in b.columns)
            ok = [k for k in range(len(a)) if _close(na[k], nb[k], sa[k], sb[k])]
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in ok], pa.int64()), pa.array([c[k] for k in ok], pa.int64())], ["a", "b"])

    ia, ib = (info.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    near = pairs.join(ia, "a").join(ib, "b").where("4 * least(na, nb) >= 3 * greatest(na, nb)")
    return near.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, docs: DataFrame, info: DataFrame, names: Names, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """The pairs that link and their scratch table, by their exact sets; only the texts that stand for a set in some pair are read into sets again."""
    spark = pairs.sparkSession
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    needed, needed_path = keep(spark, needed.join(info.select("node", "doc"), "node").select(F.col("doc.id").alias("_doc"), F.col("doc.mark").alias("_of"), F.col("node").alias("_node")), "needed")
    needed = sent(needed)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(node, v.tobytes()) for node, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if names(v := shingles(t)) == node]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], ["node", "items"])

    texts = docs.select(F.col(id_col).alias("_id"), _mark(text_col).alias("_mark"), text_or_empty(text_col).alias("_t"))
    held = texts.join(needed, texts["_id"].eqNullSafe(needed["_doc"]) & (texts["_mark"] == needed["_of"])).select("_node", "_t").mapInArrow(sets, "node long, items binary")
    held, path = keep(spark, held.dropDuplicates(["node"]), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, xs, ys = (x.to_pylist() for x in b.columns)
            ok = []
            for k in range(len(a)):
                x, y = np.frombuffer(xs[k], np.uint64), np.frombuffer(ys[k], np.uint64)
                if linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
                    ok.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in ok], pa.int64()), pa.array([c[k] for k in ok], pa.int64())], ["a", "b"])

    ia, ib = (held.select(F.col("node").alias(x), F.col("items").alias(f"i{x}")) for x in "ab")
    out = keep(spark, pairs.join(ia, "a").join(ib, "b").select("a", "b", "ia", "ib").mapInArrow(run, "a long, b long"), "links")
    forget(spark, path, needed_path)
    return out


def components(links: DataFrame) -> tuple[DataFrame, str]:
    """(node, root) of every node of the links (a, b), and its scratch table: alternating large and small stars until nothing changes. Nothing but two counts comes to the driver."""
    spark = links.sparkSession
    now, last, old = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct(), None, None
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        best = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(best, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(best.select("hi", F.col("m").alias("lo"))).distinct()
        now, path = keep(spark, small, "stars")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if old:
            forget(spark, old)
        if tuple(state) == last:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")), path
        last, old = tuple(state), path


def region_pairs(n: np.ndarray, comp: np.ndarray, sketches: list[bytes]) -> np.ndarray:
    """Index pairs of different components in a region that may link: recursive Voronoi cells with triangle-inequality windows, then blocks."""
    size = min(map(len, sketches))
    bits = np.stack([fold(s, size) for s in sketches])
    radius = int(2 * n.max() // 7)
    found: list[np.ndarray] = []

    def blocks(at: np.ndarray) -> None:
        for x in range(0, len(at), 64):
            i = at[x : x + 64]
            for y in range(x, len(at), 4096):
                j = at[y : y + 4096]
                apart = np.bitwise_count(bits[i][:, None] ^ bits[j][None]).sum(axis=2, dtype=np.int64)
                both = n[i][:, None] + n[j][None]
                low, high = np.minimum(n[i][:, None], n[j][None]), np.maximum(n[i][:, None], n[j][None])
                p, q = np.nonzero((7 * apart <= both) & (4 * low >= 3 * high) & (comp[i][:, None] != comp[j][None]))
                found.append(np.stack([i[p], j[q]], 1))

    def join(at: np.ndarray) -> None:
        if len(np.unique(comp[at])) < 2:
            return
        if len(at) <= LEAF:
            return blocks(at)
        pivots = at[np.linspace(0, len(at) - 1, PIVOTS).astype(int)]
        away = np.stack([np.bitwise_count(bits[at] ^ bits[p]).sum(axis=1, dtype=np.int64) for p in pivots], 1)
        near = away.min(axis=1)
        cells = [at[away[:, k] <= near + 2 * radius] for k in range(PIVOTS)]
        homes = away.argmin(axis=1)
        if max(len(c) for k, c in enumerate(cells) if (homes == k).any()) > 0.7 * len(at):
            return blocks(at)
        for k, cell in enumerate(cells):
            if (homes == k).any():
                join(cell)

    join(np.arange(len(n)))
    return np.unique(np.sort(np.concatenate(found), axis=1), axis=0) if found else np.zeros((0, 2), np.int64)


def _distinct_neighbourhoods(members: DataFrame) -> DataFrame:
    """Rows (sig, node, n) without the neighbourhoods that lie in another: a passage makes one for each of its shingles.

    Of those with the same sets, told by their number and two 64-bit sums, the least sig stays. Of the rest, one goes whose sets all
    stand in one lesser sig too: their first one, or the last or last but one before it. Going down from sig to sig ends at one that stays,
    so every two sets that meet still do.
    """
    by_node = Window.partitionBy("node").orderBy("sig")
    marks = F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")
    before = {"f": F.min("sig").over(by_node), "p": F.lag("sig", 1).over(by_node), "q": F.lag("sig", 2).over(by_node)}
    placed = members.select("sig", "node", *[F.when(x < F.col("sig"), x).alias(k) for k, x in before.items()])
    inside = [(F.count(k) == F.count(F.lit(1))) & (F.min(k) == F.max(k)) for k in before]
    first = placed.groupBy("sig").agg(*marks, F.coalesce(inside[0], F.lit(False)).alias("a"), F.coalesce(inside[1], F.lit(False)).alias("b"), F.coalesce(inside[2], F.lit(False)).alias("c"))
    first = first.where("not (a or b or c)").groupBy("k", "x", "y").agg(F.min("sig").alias("s"))
    return members.join(first.select("s"), members["sig"] == first["s"], "left_semi")


def _more_pivots(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) of each set in a neighbourhood of several components with the pivots there that another component holds.

    Pivots come first in MORE_PIVOTS fixed orders of all sets, so overlapping neighbourhoods choose the same ones: rows are
    linear in the neighbourhoods' members, and what links to a common pivot needs no pair of its own.
    """
    placed = members.join(roots, "node", "left").select("sig", "node", "n", F.coalesce("root", "node").alias("comp"))
    firsts = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), F.col("node").alias("b"), F.col("comp").alias("c"), F.col("n").alias("n"))) for k in range(MORE_PIVOTS)]
    mixed = placed.groupBy("sig").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.array(*firsts).alias("p")).where("x <> y").select(F.col("sig").alias("s"), "p")
    may = lambda q: (q["c"] != F.col("comp")) & (4 * F.least(q["n"], "n") >= 3 * F.greatest(q["n"], "n"))
    pairs = placed.join(mixed, placed["sig"] == mixed["s"]).select("node", F.explode(F.filter("p", may)).alias("q"))
    return pairs.select(F.greatest("node", "q.b").alias("a"), F.least("node", "q.b").alias("b")).distinct()


def _region_join(members: DataFrame, info: DataFrame, roots: DataFrame, parts: int, scratch: list[str]) -> DataFrame:
    """Candidate pairs (a, b) between different components that share a neighbourhood (sig, node)."""
    placed = members.join(roots, "node", "left").select("sig", "node", "n", F.coalesce("root", "node").alias("comp"))
    mixed = placed.groupBy("sig").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("k")).where("x <> y").select(F.col("sig").alias("s"), "k")
    rest, path = keep(info.sparkSession, placed.join(mixed, placed["sig"] == mixed["s"]).drop("s"), "mixed")
    scratch.append(path)
    # a pair that meets in many neighbourhoods is reported by one: the least that both sets' least ones share, or any where none is shared
    low = rest.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("sig")), 1, LOW).alias("low"))
    rest = rest.join(info.select("node", "sketch").join(low, "node"), "node")
    # a window holds sizes within a factor of 4/3; a set goes to its own window and to the one below, where smaller partners are
    window = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3)) + 1e-9).cast("int")
    rest = rest.withColumn("own", window)
    rest = rest.withColumn("w", F.explode(F.when(F.col("k") <= WHOLE, F.array(F.lit(-2))).otherwise(F.array("own", F.col("own") - 1))))

    def solve(rows: list[tuple], sig: int, w: int) -> Iterator[pa.RecordBatch]:
        found = []
        by_own: dict[int, list[tuple]] = {}
        for r in rows:
            by_own.setdefault(r[5], []).append(r)
        for at in by_own if w == -2 else (w,):
            here = by_own.get(at, []) + by_own.get(at + 1, [])
            if len({r[1] for r in here}) > 1:
                found += [(here[i], here[j]) for i, j in _region(here)]
        pairs = {(a[0], b[0]) for a, b in found if min(set(a[4]) & set(b[4]), default=sig) == sig}
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs, strict=True)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for b in batches:
            for sig, w, *row in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (sig, w) != at:
                    if at:
                        yield from solve(held, *at)
                    held, at = [], (sig, w)
                held.append(row)
        if at:
            yield from solve(held, *at)

    return rest.select("sig", "w", "node", "comp", "n", "sketch", "low", "own").repartition(parts, "sig", "w").sortWithinPartitions("sig", "w").mapInArrow(run, "a long, b long")


def _region(rows: list[tuple]) -> list[tuple[int, int]]:
    """Index pairs of a region's rows (node, comp, n, sketch, ...): a few sets one by one, more by pivots."""
    if len(rows) > FEW:
        n, comp = (np.array([r[k] for r in rows], np.int64) for k in (2, 1))
        return region_pairs(n, comp, [r[3] for r in rows]).tolist()
    return [(i, j) for j in range(len(rows)) for i in range(j) if rows[i][1] != rows[j][1] and _close(rows[i][2], rows[j][2], rows[i][3], rows[j][3])]


def _rows(docs: DataFrame, id_col: str, text_col: str, id_bits: int = 64) -> DataFrame:
    """_id, _mark, n, node and first of every row: first (none, id, mark) is its component's first row, by id with null ids last, then by mark; null for the empty set."""
    spark = docs.sparkSession
    parts = partitions(spark)
    profile, _ = keep(spark, _profile(docs, id_col, text_col, id_bits), "profile")
    rows = profile.where("hot is null").select(F.col(id_col).alias("_id"), "_mark", "n", "node", "other", "sketch")
    shared = rows.where("node is not null").groupBy("node").agg(F.min("other").alias("a"), F.max("other").alias("b")).where("a <> b").select("node").take(MOST_SHARED + 1)
    if len(shared) > MOST_SHARED:
        raise RuntimeError("too many sets share the first half of their identities")
    names = Names(id_bits, frozenset(r["node"] for r in shared))
    if shared:
        rows = rows.withColumn("node", F.when(F.col("node").isin(sorted(names.shared)), F.col("node").bitwiseXOR(F.col("other"))).otherwise(F.col("node")))
    hot = profile.where("hot is not null").groupBy("hot").agg(F.sum("times").alias("times")).where(F.col("times") >= HOT).orderBy(F.desc("times"), "hot").limit(MOST_HOT).toPandas()
    keys = hot["hot"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    info, _ = keep(spark, rows.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_mark").alias("mark"))).alias("doc"), F.max("n").alias("n"), F.max("sketch").alias("sketch")), "sets")
    signatures = _signatures(docs, text_col, names, keys[order], np.arange(len(keys), 0, -1)[order], 4 * parts)
    near, near_path = keep(spark, _neighbourhoods(signatures, parts), "neighbours")
    members, members_path = keep(spark, _distinct_neighbourhoods(near.where("b is null").select("sig", F.col("a").alias("node"), "n")), "members")
    known, known_path, roots, roots_path = None, None, None, None
    scratch: list[str] = []
    steps = (lambda: near.where("b is not null").select("a", "b").distinct(), lambda: _more_pivots(members, roots), lambda: _region_join(members, info, roots, parts, scratch).distinct())
    for step in steps:
        more, more_path = keep(spark, _may_link(step(), info), "pairs")
        if known is None or more.limit(1).count():
            links, links_path = _verify(more, docs, info, names, id_col, text_col)
            if known is not None:
                both, both_path = keep(spark, known.union(links), "links")
                forget(spark, links_path, known_path)
                links, links_path = both, both_path
            known, known_path, last = links, links_path, roots_path
            roots, roots_path = components(known)
            if last:
                forget(spark, last)
        forget(spark, more_path)
    forget(spark, near_path, members_path, known_path, *scratch)
    by_root = info.join(roots, "node", "left").select("node", "doc", F.coalesce("root", "node").alias("root"))
    first = by_root.groupBy("root").agg(F.min("doc").alias("first"))
    first = by_root.join(first, "root").select(F.col("node").alias("_node"), "first")
    return rows.join(first, rows["node"] == first["_node"], "left").select("_id", "_mark", "n", "node", "first")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bits: int = 64) -> DataFrame:
    """id, n_shingles, component_id (the smallest id reachable by links) of every row.

    Null, empty and wordless texts have the empty set and are their own component. Rows with one set, repeated rows among them, are
    one component. A null id never names a component that has another. Other columns are not read.
    """
    out = _rows(docs, id_col, text_col, id_bits)
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("first.id", "_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first row of each component, by id with null ids last: one of each group, and of rows that repeat its id and text one.

    Rows are told by id and text, so what shares an id, or has none, is decided on apart. Rows of the empty set stay; of those
    that repeat an id one does.
    """
    spark = docs.sparkSession
    found, _ = keep(spark, _rows(docs, id_col, text_col), "components")
    other = ~(F.col("_id").eqNullSafe(F.col("first.id")) & (F.col("_mark") == F.col("first.mark")))
    gone = sent(found.where(F.col("first").isNotNull() & other).select(F.col("_id").alias("_gone"), F.col("_mark").alias("_of")).distinct())
    repeated = found.groupBy("_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").limit(1).count()
    out = docs.join(gone, docs[id_col].eqNullSafe(gone["_gone"]) & (_mark(text_col) == gone["_of"]), "left_anti")
    if not repeated:
        return out
    wordless = ~text_or_empty(text_col).rlike(r"[^\x20\x09-\x0D]")
    nameless = F.col(id_col).isNull() & wordless
    # texts without a word are one text
    return one_each(out.where(~nameless), id_col, F.when(wordless, "").otherwise(F.col(text_col))).union(out.where(nameless))
