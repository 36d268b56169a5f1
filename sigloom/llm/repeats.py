"""Removal of byte strings that repeat across documents, by anchors and an enhanced suffix array.

Any two equal strings of LEAST bytes hold equal anchors at equal places: the GRAM-byte strings whose hash is least among those of some
LEAST-byte window. An anchor's context is what lies within LEAST - GRAM bytes of it; every window with that anchor
lies there. Anchors are dealt out by hash with a hash of the context. Where the whole context is also in a smaller document, all its
windows are repeats. What remains, anchors that meet different contexts, has its contexts' bytes sorted into a suffix array with
longest common prefixes; a stack scan walks its common-prefix intervals, those whose occurrences have diverse left
extensions are maximal repeats, and each with all its occurrences marks those in documents above the smallest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import keep, partitions, text_or_empty
from sigloom.llm.words import mix

LEAST, GRAM = 50, 24
SIDE, WINDOWS = LEAST - GRAM, LEAST - GRAM + 1
#: Bytes of text that are hashed at once, and anchors that a task gathers before it deals them out.
SLICE, GATHER = 1 << 20, 6_000_000
#: Distinct contexts of an anchor from which it is dealt out by what stands beside it, and contexts that are sorted at once.
HOT_CONTEXTS, SORT_CONTEXTS = 2000, 20_000
_BYTE = np.random.default_rng(50).integers(1, 1 << 63, 257, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) over each run of width items."""
    size = 1
    n = len(x) - width + 1
    while size * 2 <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[:n], x[width - size : width - size + n])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place, hash, context hash) of the anchors of texts of LEAST bytes or more."""
    gap = np.full(LEAST, 256, np.uint16)
    pieces, start, at = [gap], [], LEAST
    for t in texts:
        start.append(at)
        pieces += [np.frombuffer(t, np.uint8).astype(np.uint16), gap]
        at += len(t) + LEAST
    codes = np.concatenate([*pieces, gap])
    g = _BYTE[codes]
    for size in (1, 2):
        g = g[:-size] * _A + (g[size:] ^ (g[size:] >> np.uint64(31)))
    g4 = g
    g = g4[:-4] * _B + (g4[4:] ^ (g4[4:] >> np.uint64(29)))
    g8 = mix(g)
    n = len(g8) - 16
    h = mix(g8[:n] * _A + g8[8 : n + 8] * _B + g8[16 : n + 16] * _C)
    outside = np.cumsum(np.r_[0, codes == 256])
    low = (h >> np.uint64(32)).astype(np.uint32)
    least = _slide(low, WINDOWS, np.minimum)
    m = len(least)
    least[outside[LEAST : m + LEAST] != outside[:m]] = 0  # windows that leave a text choose nothing
    most = _slide(np.r_[np.zeros(WINDOWS - 1, np.uint32), least, np.zeros(WINDOWS - 1, np.uint32)], WINDOWS, np.maximum)
    place = np.flatnonzero((most[: len(low)] == low) & (low > 0))
    place = place[outside[place + GRAM] == outside[place]]
    context = np.zeros(len(place), np.uint64)
    for k in range(9):
        context = (context ^ (context >> np.uint64(31))) * _C + g8[place - SIDE + 8 * k]
    context = mix(context * _A + mix(g4[place - SIDE + 72]))
    start_ = np.array(start)
    which = np.searchsorted(start_, place, "right") - 1
    return which, place - start_[which], h[place], context


_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(h: np.ndarray, c: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> bytes:
    """40 bits of the anchor's hash, 64 of the context's, and the places' differences compressed; rows are in order of (doc, pos)."""
    step = np.diff(doc, prepend=doc[0]).astype("<i8")
    gap = np.where(step == 0, np.diff(pos, prepend=0), pos).astype("<u4")
    places = _PACK.compress(b"".join(x.view(np.uint8).reshape(len(h), -1).T.tobytes() for x in (step, gap)))
    top = np.stack([h.view(np.uint8).reshape(-1, 8)[:, :5]]).tobytes() + c.astype("<u8").tobytes()
    return b"".join([np.array([len(h), doc[0]], "<i8").tobytes(), top, places])


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, first = np.frombuffer(blob, "<i8", 2).tolist()
    wide = lambda raw, k: np.pad(np.frombuffer(raw, np.uint8).reshape(n, k), ((0, 0), (0, 8 - k))).view("<u8").ravel()
    h, c = wide(blob[16 : 16 + 5 * n], 5), np.frombuffer(blob[16 + 5 * n : 16 + 13 * n], "<u8")
    raw = np.frombuffer(_UNPACK.decompress(blob[16 + 13 * n :], max_output_size=12 * n), np.uint8)
    step = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<i8").ravel()
    gap = np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view("<u4").ravel().astype(np.int64)
    doc = first + np.cumsum(step)
    new = np.flatnonzero(np.r_[True, step[1:] != 0])
    total = np.cumsum(gap)
    before = np.repeat(total[new] - gap[new], np.diff(np.r_[new, n]))
    return h, c, doc, total - before


def _dealt(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, blob) of all anchors; docs is (doc, text). A task packs what it gathered for a bucket at once."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        doc, pos, h, c = (np.concatenate(x) for x in zip(*held, strict=True))
        to = (h >> np.uint64(40)) % np.uint64(buckets)
        order = np.lexsort((pos, doc, to))
        doc, pos, h, c, to = doc[order], pos[order], h[order], c[order], to[order]
        which, first = np.unique(to, return_index=True)
        ends = [*first[1:].tolist(), len(to)]
        blobs = [_pack(h[a:b], c[a:b], doc[a:b], pos[a:b]) for a, b in zip(first.tolist(), ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            ids, texts, gathered = [], [], 0
            for doc, text in [*zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), (None, None)]:
                if text is not None:
                    ids.append(doc)
                    texts.append(text.encode())
                    gathered += len(texts[-1])
                if texts and (text is None or gathered >= SLICE):
                    which, pos, h, c = anchors(texts)
                    held.append((np.array(ids, np.int64)[which], pos, h, c))
                    size += len(pos)
                    ids, texts, gathered = [], [], 0
            if size >= GATHER:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    return docs.where(F.col("doc").isNotNull() & (F.octet_length("text") >= LEAST)).mapInArrow(run, "bucket int, blob binary")


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Whether each sorted row differs from the one before."""
    out = np.ones(len(keys[0]), bool)
    if len(out) > 1:
        out[1:] = False
        for k in keys:
            out[1:] |= k[1:] != k[:-1]
    return out


def _marks(dealt: DataFrame, parts: int) -> DataFrame:
    """Rows (doc, kind, blob): kind 0, places of anchors whose contexts stand in a smaller document; 1 and 2, hashes and places to look at closer."""

    def solve(bucket: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        h, c, doc, pos = (np.concatenate(x) for x in zip(*map(_unpack, blobs), strict=True))
        order = np.lexsort((pos, doc, c, h))
        h, c, doc, pos = h[order], c[order], doc[order], pos[order]
        new_h = _starts(h)
        new_c = new_h | _starts(c)
        h_no, c_no = np.cumsum(new_h) - 1, np.cumsum(new_c) - 1
        first_h = np.flatnonzero(new_h)
        smallest = np.minimum.reduceat(doc, first_h)[h_no]
        largest = np.maximum.reduceat(doc, first_h)[h_no]
        contexts = np.add.reduceat(new_c.astype(np.int64), first_h)[h_no]
        covered = doc > doc[np.flatnonzero(new_c)][c_no]
        closer = ~covered & (contexts > 1) & (smallest != largest)
        kind = np.where(covered, 0, np.where(contexts > HOT_CONTEXTS, 2, 1))
        at = np.flatnonzero(covered | closer)
        if not len(at):
            return
        at = at[np.lexsort((pos[at], kind[at], doc[at]))]
        full = (h[at] + np.uint64(bucket * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)
        place = pos[at].astype("<u4")
        begin = np.flatnonzero(_starts(doc[at], kind[at]))
        ends = [*begin[1:].tolist(), len(at)]
        kinds, docs_ = kind[at][begin], doc[at][begin]
        out = [place[a:b].tobytes() if k == 0 else place[a:b].tobytes() + full[a:b].tobytes() for a, b, k in zip(begin.tolist(), ends, kinds.tolist(), strict=True)]
        for a in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(docs_[a : a + 10_000]), pa.array(kinds[a : a + 10_000].astype(np.int32)), pa.array(out[a : a + 10_000], pa.binary())], ["doc", "kind", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if bucket != at and held:
                    yield from solve(at, held)
                    held = []
                at = bucket
                held.append(blob)
        if held:
            yield from solve(at, held)

    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "doc long, kind int, blob binary")


def suffix_array(texts: list[bytes], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Enhanced suffix array of the suffixes that share their first least bytes with another: (text number, place, common prefix with the one before), in order."""
    size = np.array([len(t) for t in texts])
    wide = int(size.max(initial=least))
    codes = np.frombuffer(b"".join(texts) + b"\0" * wide, np.uint8)
    start = np.cumsum(size) - size
    count = np.maximum(size - least + 1, 0)
    text = np.repeat(np.arange(len(texts)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    g = _BYTE[codes.astype(np.int64)]
    value, done, power = np.zeros(len(codes) - least + 1, np.uint64), 0, 1
    while done < least:  # a hash of the first least bytes, from powers of two
        if least & power:
            value = value * _C + mix(g[done : done + len(value)])
            done += power
        g = mix(g[:-power] * _A + g[power:]) if len(g) > power else g
        power *= 2
    value = value[start[text] + place]
    order = np.argsort(value, kind="stable")
    same = np.r_[False, value[order][1:] == value[order][:-1]]
    twice = np.zeros(len(order), bool)
    twice[order[same]] = True
    twice[order[np.flatnonzero(same) - 1]] = True
    text, place = text[twice], place[twice]
    if not len(text):
        return text, place, np.zeros(0, np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(codes, wide)[start[text] + place].copy()
    room = size[text] - place
    rows[np.arange(wide)[None] >= room[:, None]] = 0
    order = np.argsort(rows.view(f"S{wide}").ravel(), kind="stable")
    rows, room = rows[order], room[order]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
    common = np.minimum(common, np.minimum(room[1:], room[:-1]))
    return text[order], place[order], np.r_[0, common]


def intervals(common: np.ndarray, doc: np.ndarray, left: np.ndarray, least: int = LEAST) -> Iterator[tuple[int, int, int, int]]:
    """Common-prefix intervals (first, last, depth, smallest document) of depth least or more that are maximal repeats: not all left characters are one.

    One scan with a stack of open intervals. left is the byte before a suffix; -1, none known, differs from everything.
    """
    stack: list[list[int]] = []
    depths, docs, lefts = common.tolist(), doc.tolist(), left.tolist()
    for i in range(1, len(docs) + 1):
        depth = depths[i] if i < len(docs) else 0
        depth = depth if depth >= least else 0
        if not depth and not stack:
            continue
        first, small, before = i - 1, docs[i - 1], lefts[i - 1]
        while stack and stack[-1][0] > depth:
            top = stack.pop()
            small = min(small, top[2])
            before = before if before == top[3] else -1
            first = top[1]
            if before < 0:
                yield first, i - 1, top[0], small
        if depth:
            if stack and stack[-1][0] == depth:
                stack[-1][2] = min(stack[-1][2], small)
                stack[-1][3] = stack[-1][3] if stack[-1][3] == before else -1
            else:
                stack.append([depth, first, small, before])


def maximal_repeats(texts: list[bytes], docs: np.ndarray, least: int = LEAST) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(length, smallest document, text numbers, places): each maximal repeat of least bytes or more with all its occurrences."""
    text, place, common = suffix_array(texts, least)
    left = np.array([texts[t][p - 1] if p else -1 for t, p in zip(text.tolist(), place.tolist(), strict=True)], np.int64)
    for a, b, depth, small in intervals(common, docs[text], left, least):
        yield depth, small, text[a : b + 1], place[a : b + 1]


def _repeats_in(rows: list[tuple[int, int, bytes]], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, length) that maximal repeats within the contexts (doc, start, bytes) remove."""
    doc, start = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    out: list[tuple] = []
    for depth, small, text, place in maximal_repeats([r[2] for r in rows], doc, least):
        gone = doc[text] > small
        if gone.any():
            t = text[gone]
            out.append((doc[t], start[t] + place[gone], np.full(len(t), depth)))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    d, s, n = (np.concatenate(x) for x in zip(*out, strict=True))
    return d, s, n


def _contexts(docs: DataFrame, marks: DataFrame, parts: int) -> DataFrame:
    """(key, doc, start, context) of the anchors to look at closer, dealt out by anchor. A match holds the anchor and half the bytes
    beside it on one side, so contexts of a frequent anchor go by those halves, to two places, instead."""
    wanted = marks.where("kind > 0").groupBy(F.col("doc").alias("d")).agg(F.collect_list(F.struct("kind", "blob")).alias("at"))
    both = docs.join(wanted.hint("shuffle_hash"), docs["doc"] == wanted["d"]).select("doc", "text", "at")
    half = SIDE // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, doc, start, context = [], [], [], []
            for d, text, at in zip(*(x.to_pylist() for x in b.columns), strict=True):
                t = text.encode()
                for x in at:
                    n = len(x["blob"]) // 12
                    for p, h in zip(np.frombuffer(x["blob"], "<u4", n).tolist(), np.frombuffer(x["blob"], "<i8", n, 4 * n).tolist(), strict=True):
                        a = max(0, p - SIDE)
                        sides = [b""] if x["kind"] == 1 else [b"l" + t[max(0, p - half) : p], b"r" + t[p + GRAM : p + GRAM + half]]
                        for s in sides:
                            key.append(xxhash.xxh3_64_intdigest(s, seed=h & (1 << 64) - 1) - (1 << 63) if s else h)
                            doc.append(d)
                            start.append(a)
                            context.append(t[a : p + LEAST])
            for a in range(0, len(key), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 20_000], k) for x, k in ((key, pa.int64()), (doc, pa.int64()), (start, pa.int32()), (context, pa.binary()))], ["key", "doc", "start", "context"])

    return both.mapInArrow(run, "key long, doc long, start int, context binary").repartition(parts, "key").sortWithinPartitions("key")


def _closer(contexts: DataFrame) -> DataFrame:
    """(doc, kind 3, blob of starts and lengths) that the contexts' maximal repeats remove."""

    def solve(rows: list) -> Iterator[pa.RecordBatch]:
        doc, start, size = _repeats_in(rows)
        if len(doc):
            order = np.argsort(doc, kind="stable")
            doc, start, size = doc[order], start[order].astype("<u4"), size[order].astype("<u4")
            begin = np.flatnonzero(_starts(doc))
            ends = [*begin[1:].tolist(), len(doc)]
            blobs = [np.unique(np.stack([start[a:b], size[a:b]], 1), axis=0).tobytes() for a, b in zip(begin.tolist(), ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[begin]), pa.array(np.full(len(begin), 3, np.int32)), pa.array(blobs, pa.binary())], ["doc", "kind", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for b in batches:
            for key, *row in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if key != at and len(held) >= SORT_CONTEXTS:
                    yield from solve(held)
                    held = []
                at = key
                held.append(row)
        if held:
            yield from solve(held)

    return contexts.mapInArrow(run, "doc long, kind int, blob binary")


def _cover(n: int, marks: list) -> np.ndarray:
    """Whether each of n bytes is removed."""
    edge = np.zeros(n + 1, np.int64)
    for m in marks or []:
        if m["kind"] == 0:
            p = np.frombuffer(m["blob"], "<u4").astype(np.int64)
            a, b = np.maximum(p - SIDE, 0), np.minimum(p + LEAST, n)
        else:
            a, size = np.frombuffer(m["blob"], "<u4").reshape(-1, 2).astype(np.int64).T
            b = a + size
        np.add.at(edge, a, 1)
        np.add.at(edge, b, -1)
    return np.cumsum(edge)[:n] > 0


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes with with_text) of every row.

    A byte goes when a LEAST-byte string that covers it also starts in a row with a smaller id. Null texts count as empty, shorter ones
    stay whole; a row with a null id stays whole and takes nothing from others. Ids name texts: rows that repeat an id
    repeat its text. Other columns are not read.
    """
    spark = df.sparkSession
    parts = partitions(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc"), text_or_empty(text_col).alias("text"))
    marks, _ = keep(spark, _marks(_dealt(docs, parts), parts), "marks")
    dealt = docs.where("doc is not null").repartition(parts, "doc")
    closer = _closer(_contexts(dealt, marks, parts))
    found = marks.where("kind = 0").union(closer).groupBy(F.col("doc").alias("d")).agg(F.collect_list(F.struct("kind", "blob")).alias("marks"))
    rows = dealt.join(found.hint("shuffle_hash"), dealt["doc"] == found["d"], "left").select("doc", "text", "marks").unionAll(docs.where("doc is null").select("doc", "text", F.lit(None).cast("array<struct<kind:int,blob:binary>>")))
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, at in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                t = text.encode()
                gone = _cover(len(t), at) if at else np.zeros(len(t), bool)
                kept = np.frombuffer(t, np.uint8)[~gone].tobytes() if at else t
                out.append((len(t), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if at else 0, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)][: 4 + with_text]], names)

    return rows.mapInArrow(run, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
