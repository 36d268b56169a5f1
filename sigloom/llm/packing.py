"""Best-fit packing of token sequences with a bounded number of open bins."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.bpe import SPLIT_PATTERN, byte_alphabet, encoder, vocabulary_spec
from sigloom.llm.common import keep, partitions, text_or_empty

#: Open bins a task holds at once.
OPEN_BINS = 2048
#: Tasks of the first round whose unfilled bins meet in one task of the second, and the share of its capacity that a bin then has free.
TASKS, SPARE = 64, 1 / 128


class BestFit:
    """Online best fit. Bit f of self.levels is set while some open bin has f free places; the lowest set bit at or above a need is the best fit."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS, first_id: int = 0):
        self.capacity, self.open_bins, self.next_id = capacity, open_bins, first_id
        self.levels, self.bins, self.n_open = 0, {}, 0
        #: Bins that have closed, until the caller takes them.
        self.closed: list[int] = []

    def place(self, need: int) -> tuple[int, int]:
        """The bin and the offset for need places; the fullest bin closes when there would be too many."""
        fits = self.levels >> need
        if fits:
            free = need + (fits & -fits).bit_length() - 1
            at = self._take(free)
        else:
            at, free = self.next_id, self.capacity
            self.next_id += 1
        left = free - need
        if left:
            self.bins.setdefault(left, []).append(at)
            self.levels |= 1 << left
            self.n_open += 1
            if self.n_open > self.open_bins:
                self.closed.append(self._take((self.levels & -self.levels).bit_length() - 1))
        else:
            self.closed.append(at)
        return at, self.capacity - free

    def _take(self, free: int) -> int:
        held = self.bins[free]
        at = held.pop()
        if not held:
            self.levels &= ~(1 << free)
        self.n_open -= 1
        return at

    def unfilled(self) -> Iterator[tuple[int, int]]:
        """Open bins and their free places."""
        for free in range(self.capacity + 1):
            if self.levels >> free & 1:
                yield from ((at, free) for at in self.bins[free])


class Ranked:
    """Ids of whole texts by the library of the vocabulary's ranks; equal to the tokenizers library's.

    Texts with a special token's string, and those whose runs are too long for the library's splitter, go through the automaton.
    """

    def __init__(self, path: str):
        import tiktoken

        spec, alphabet = vocabulary_spec(path), byte_alphabet()
        self.path = path
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        if made != sorted(set(made)):
            raise ValueError("the vocabulary's merges are not in the order of its ids")
        ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items()}
        self.encoding = tiktoken.Encoding("ranked", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not any(s in text for s in self.special):
            try:
                return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except ValueError:
                pass
        return encoder(self.path, 20_000, 20_000, 1_000_000).encode(text)


_RANKED: dict[str, Ranked] = {}


def ranked(path: str) -> Ranked:
    """One encoder per worker process and vocabulary."""
    if path not in _RANKED:
        _RANKED.clear()
        _RANKED[path] = Ranked(path)
    return _RANKED[path]


def pack(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, open_bins: int = OPEN_BINS) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most capacity tokens.

    Each text (null: empty) is encoded and end_id is added. Only documents above capacity are cut: whole pieces
    of capacity tokens, before them one with the rest. Each task packs what it reads into bins of its own, online, with
    at most open_bins open. Pieces of bins that it leaves with over SPARE of their places free are packed anew, longest first: TASKS
    tasks' pieces together, sorted by Spark and read as a stream, so again open_bins bound the memory. Only those rows, no texts, are
    shuffled; a repeated task gives the same rows. Repeated rows are packed each; a null id is kept. Empty input gives no rows.
    """
    spark = df.sparkSession
    kind = dict(df.dtypes)[id_col]
    names = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "_group"]
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    id_type: list[pa.DataType] = []

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [id_type[0], pa.int32(), *[pa.int64()] * 6]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], x) for k, x in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = ranked(vocabulary), TaskContext.get().partitionId()
        fit = BestFit(capacity, open_bins, task << 40)
        end = end_id.to_bytes(4, "little")
        held: dict[int, list[tuple]] = {}
        for b in batches:
            id_type[:] = [b.column(0).type]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = enc.encode(text) + end
                n = len(ids) // 4
                start, piece = 0, 0
                while start < n:
                    size = (n - start) % capacity or capacity
                    at, offset = fit.place(size)
                    held.setdefault(at, []).append((doc, piece, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), at, offset, None))
                    start, piece = start + size, piece + 1
            done, fit.closed = fit.closed, []
            if done:
                yield batch([r for at in done for r in held.pop(at)])
        rest: list[tuple] = []
        for at, free in fit.unfilled():
            again = task // TASKS if free > SPARE * capacity else None
            rest += [(*r[:-1], again) for r in held.pop(at)]
            if len(rest) > 10_000:
                yield batch(rest)
                rest = []
        if rest:
            yield batch(rest)

    def anew(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, now = None, None
        for b in batches:
            places = []
            for group, need in zip(b.column(7).to_pylist(), b.column(3).to_pylist(), strict=True):
                if group != now:
                    fit, now = BestFit(capacity, open_bins, (1 << 62) + (group << 40)), group
                places.append(fit.place(need))
                fit.closed.clear()
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *(pa.array([p[k] for p in places], pa.int64()) for k in (0, 1))], names[:7])

    first = df.select(id_col, text_or_empty(text_col).alias("_text")).mapInArrow(run, f"{schema}, _group long")
    rows, _ = keep(spark, first, "pieces")
    unfilled = rows.where("_group is not null").repartition(partitions(spark), "_group").sortWithinPartitions("_group", F.desc("length"), "sequence_id", "offset")
    return rows.where("_group is null").drop("_group").unionAll(unfilled.mapInArrow(anew, schema))
