"""Byte-pair encoding and decoding with a deterministic automaton over token arcs.

The automaton starts with one state that loops on every byte. Each merge (u, v) -> uv, in rank order, adds a
*merge gadget*: the state that u leads to is copied without its v arc, u is led to the copy, and wherever u
starts an arc that continues with v, an arc uv leads to where v led. The result accepts, for every byte string,
exactly one arc sequence: its encoding. All u arcs lead to one state, so a state tree and one arc bit set per
token describe the automaton; a gadget clears an interval of bits (the copies below the new state, numbered in
preorder) and copies a bit set. Bit sets are copied only when bits are cleared, so tokens share most of them.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sigloom.llm.common import remembers, text_or_empty

#: Fixed value: the public pre-splitting pattern of byte-level BPE.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts up to this code point are split by SPLIT_PATTERN; above it Unicode versions of regex libraries differ, so the tokenizer's own splitter is asked.
COMMON_UNICODE = "ԯ"
#: Chunks and words a worker remembers, in two generations each, and the longest ones in characters that it does.
CACHE_CHUNKS, CACHE_WORDS, CACHE_CHARS = 1_200_000, 600_000, 64
#: Characters of texts that are encoded at once, a longer text alone.
GROUP_CHARS = 8_000_000
#: Words of up to so many bytes are encoded many at once.
LOCKSTEP_BYTES = 48


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in character of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def vocabulary_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class MergeAutomaton:
    """labels[t]: bytes of arc t; row[t]: the state it leads to; arcs[kind[t]]: bit set of the states it leaves."""

    def __init__(self, path: str):
        spec = vocabulary_spec(path)
        model, alphabet = spec["model"], byte_alphabet()
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        vocab = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        self.vocab = vocab
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.labels = [b""] * size
        for t, i in vocab.items():
            self.labels[i] = t
        for t, i in self.special.items():
            self.labels[i] = t.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs = [tuple(bytes(alphabet[c] for c in side) for side in m) for m in pairs]
        self._compile([(vocab[u], vocab[v], vocab[u + v]) for u, v in pairs], [vocab[bytes([b])] for b in range(256)])
        self.length = [len(x) for x in self.labels]
        self._trie(vocab)
        self.longest_from: dict[bytes, int] = {}
        for t in vocab:
            self.longest_from[t[:2]] = max(self.longest_from.get(t[:2], 1), len(t))
        self.shorter = [-1] * size
        for t, i in vocab.items():
            self.shorter[i] = next((vocab[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in vocab), -1)

    def _trie(self, vocab: dict[bytes, int]) -> None:
        """Prefixes of the arc labels: node * 256 + byte in sorted steps leads to node step_to; node_token is the arc spelt there, or -1."""
        nodes, steps, tokens = {b"": 0}, [], {0: -1}
        for t in sorted(vocab, key=len):
            for n in range(1, len(t) + 1):
                if t[:n] not in nodes:
                    nodes[t[:n]] = len(nodes)
                    steps.append((nodes[t[: n - 1]] * 256 + t[n - 1], nodes[t[:n]]))
            tokens[nodes[t]] = vocab[t]
        steps.sort()
        self.steps, self.step_to = (np.array(x, np.int64) for x in zip(*steps, strict=True))
        self.node_token = np.full(len(nodes), -1, np.int64)
        self.node_token[list(tokens)] = list(tokens.values())

    def encode_many(self, words: list[bytes]) -> list[bytes]:
        """Encode distinct words in lockstep; each prefix of a word has one accepted arc sequence, so one state. Ids as little-endian 32-bit."""
        out: list = [None] * len(words)
        short = [k for k, w in enumerate(words) if 0 < len(w) <= LOCKSTEP_BYTES]
        for k in set(range(len(words))).difference(short):
            out[k] = np.array(self.encode(words[k]), "<u4").tobytes()
        short.sort(key=lambda k: len(words[k]))
        row, size, kind = (np.array(x, np.int64) for x in (self.row, self.length, self.kind))
        for a in range(0, len(short), 20_000):
            keys = short[a : a + 20_000]
            n, m = len(keys), len(words[keys[-1]])
            text = np.frombuffer(b"".join(words[k].ljust(m, b"\0") for k in keys), np.uint8).reshape(n, m)
            length = np.array([len(words[k]) for k in keys])
            state, came = np.full((n, m + 1), -1, np.int64), np.full((n, m + 1), -1, np.int64)
            state[:, 0] = 0
            for i in range(m):
                who = np.flatnonzero((length > i) & (state[:, i] >= 0))
                node, at = np.zeros(len(who), np.int64), i
                while len(who):
                    key = node * 256 + text[who, at]
                    found = np.searchsorted(self.steps, key)
                    found[found == len(self.steps)] = 0
                    ok = self.steps[found] == key
                    who, node = who[ok], self.step_to[found[ok]]
                    at += 1
                    arc = self.node_token[node]
                    here = np.flatnonzero(arc >= 0)
                    t, s = arc[here], state[who[here], i]
                    here = here[(self.arcs[kind[t], s >> 3] >> (s & 7).astype(np.uint8)) & 1 > 0]
                    came[who[here], at] = arc[here]
                    state[who[here], at] = row[arc[here]]
                    on = length[who] > at
                    who, node = who[on], node[on]
            at, who, got, order = length.copy(), np.arange(n), [], []
            while len(who):
                arc = came[who, at[who]]
                got.append(arc)
                order.append(who)
                at[who] -= size[arc]
                who = who[at[who] > 0]
            who, arcs = np.concatenate(order[::-1]), np.concatenate(got[::-1])
            by = np.argsort(who, kind="stable")
            ids = arcs[by].astype("<u4").tobytes()
            ends = np.cumsum(np.bincount(who, minlength=n)) * 4
            first = 0
            for k, end in zip(keys, ends.tolist(), strict=True):
                out[k] = ids[first:end]
                first = end
        return out

    def _compile(self, merges: list[tuple[int, int, int]], single: list[int]) -> None:
        size = 1 + max(max(single), max((m[2] for m in merges), default=0))
        leads, parent = [0] * size, [0] * (len(merges) + 1)
        for k, (u, v, uv) in enumerate(merges, 1):
            old = leads[u]
            target = leads[v]
            parent[k], leads[u], leads[uv] = old, k, target
        final = {0, *leads}
        below: list[list[int]] = [[] for _ in parent]
        for k in range(1, len(parent)):
            below[parent[k]].append(k)
        first, last, at, stack = [0] * len(parent), [0] * len(parent), 0, [(0, False)]
        while stack:
            s, done = stack.pop()
            if done:
                last[s] = at
                continue
            first[s] = at
            at += s in final
            stack.append((s, True))
            stack.extend((c, False) for c in below[s])
        width = (at + 7) // 8
        sets = [bytes(width)] * size
        for t in single:
            sets[t] = b"\xff" * width
        for k, (u, v, uv) in enumerate(merges, 1):
            if first[k] < last[k]:
                bits = np.frombuffer(sets[v], np.uint8).copy()
                self._clear(bits, first[k], last[k])
                sets[v] = bits.tobytes()
            sets[uv] = sets[u]
        self.states = at
        self.row = [first[s] for s in leads]
        kinds = {x: k for k, x in enumerate(dict.fromkeys(sets))}
        self.kind = [kinds[x] for x in sets]
        self.arcs = np.frombuffer(b"".join(kinds), np.uint8).reshape(len(kinds), width)

    @staticmethod
    def _clear(bits: np.ndarray, lo: int, hi: int) -> None:
        a, b = lo >> 3, hi >> 3
        if a == b:
            bits[a] &= 255 ^ (((1 << (hi - lo)) - 1) << (lo & 7))
            return
        bits[a] &= (1 << (lo & 7)) - 1
        bits[a + 1 : b] = 0
        if hi & 7:
            bits[b] &= 256 - (1 << (hi & 7))

    def _longest(self, word: bytes, at: int) -> int:
        vocab = self.vocab
        for n in range(self.longest_from.get(word[at : at + 2], 1), 0, -1):
            t = vocab.get(word[at : at + n])
            if t is not None:
                return t
        raise ValueError("a byte without an arc")

    def encode(self, word: bytes) -> list[int]:
        """The one accepted arc sequence that spells word: longest arcs first, dead ends remembered by position."""
        arcs, kind, row, length, shorter, n = self.arcs, self.kind, self.row, self.length, self.shorter, len(word)
        out: list[int] = []
        came: list[int] = []
        dead: set[int] = set()
        at, state = 0, 0
        t = self._longest(word, 0) if n else -1
        while at < n:
            while t >= 0 and (not int(arcs[kind[t], state >> 3]) >> (state & 7) & 1 or at + length[t] in dead):
                t = shorter[t]
            if t >= 0:
                out.append(t)
                came.append(state)
                at += length[t]
                state = row[t]
                if at < n:
                    t = self._longest(word, at)
            else:
                dead.add(at)
                t, state = out.pop(), came.pop()
                at -= length[t]
                t = shorter[t]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))


class Remembered:
    """A bounded memory in two generations: what is asked for is young; when the young fill half of it, they become old and the old ones are forgotten."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, asked: set) -> set:
        """What of asked is not remembered; the rest is young afterwards."""
        fresh = asked.difference(self.young)
        again = fresh.intersection(self.old)
        self.young.update((x, self.old[x]) for x in again)
        return fresh - again

    def age(self) -> None:
        if 2 * len(self.young) > self.most:
            self.old = {k: v for k, v in self.young.items() if len(k) <= CACHE_CHARS}
            self.young = {}


class Encoder:
    """Whole texts. A text is cut before each blank that a non-space follows, which is always a word's start, so that chunks can be remembered."""

    def __init__(self, path: str, chunks: int = CACHE_CHUNKS, words: int = CACHE_WORDS, group: int = GROUP_CHARS):
        from tokenizers import Tokenizer

        self.group_chars = group

        self.automaton = MergeAutomaton(path)
        self.split = regex.compile(SPLIT_PATTERN).findall
        spec = vocabulary_spec(path)
        bare = spec | {"added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}, "post_processor": None}
        self.own_split = Tokenizer.from_str(json.dumps(bare)).pre_tokenizer.pre_tokenize_str
        del spec, bare
        self.alphabet = byte_alphabet()
        special = [re.escape(x) for x in sorted(self.automaton.special, key=len, reverse=True)]
        self.special = re.compile("(" + "|".join(special) + ")") if special else None
        self.odd_blank = re.compile(r" (?:\s|$)").search
        self.cut = re.compile(r" (?=\S)").split
        self.tails = Remembered(chunks)
        self.words = Remembered(words)

    def _pieces(self, lead: str, chunk: str) -> list[bytes]:
        if chunk.isascii() or max(chunk) <= COMMON_UNICODE:
            if chunk.isalpha():
                return [(lead + chunk).encode()]
            if chunk[:-1].isalpha() and chunk[-1] in ".,;:!?":
                return [(lead + chunk[:-1]).encode(), chunk[-1].encode()]
            return [w.encode() for w in self.split(lead + chunk)]
        return [bytes(map(self.alphabet.__getitem__, w)) for w, _ in self.own_split(lead + chunk)]

    def _parts(self, text: str) -> list[str]:
        """Chunks; all but the first have lost the blank they start with."""
        return self.cut(text) if self.odd_blank(text) else text.split(" ")

    def _learn(self, lead: str, chunks: set[str], held: dict[str, bytes]) -> None:
        """Add the encodings of chunks to held."""
        pieces = {c: self._pieces(lead, c) for c in chunks}
        asked: set[bytes] = set()
        for ws in pieces.values():
            asked.update(ws)
        order = list(self.words.missing(asked))
        words = self.words.young
        words.update(zip(order, self.automaton.encode_many(order), strict=True))
        for c, ws in pieces.items():
            held[c] = words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws])
        self.words.age()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; the strings of special tokens become their ids."""
        out: list[bytes] = []
        first, held = 0, 0
        for k, text in enumerate(texts):
            if held and held + len(text) > self.group_chars:
                out += self._group(texts[first:k])
                first, held = k, 0
            held += len(text)
        return out + self._group(texts[first:])

    def _group(self, texts: list[str]) -> list[bytes]:
        plain: list[str] = []
        plan: list[list] = []
        for text in texts:
            if self.special is not None and any(s in text for s in self.automaton.special):
                plan.append([self.automaton.special.get(p, p) for p in self.special.split(text)])
            else:
                plan.append([text])
            plain.extend(p for p in plan[-1] if isinstance(p, str))
        got = iter(self._plain(plain))
        return [b"".join([next(got) if isinstance(p, str) else p.to_bytes(4, "little") for p in ps]) for ps in plan]

    def _plain(self, texts: list[str]) -> list[bytes]:
        parts = [self._parts(x) for x in texts]
        heads = {p[0] for p in parts}
        tails: set[str] = set()
        for p in parts:
            tails.update(p[1:])
        first: dict[str, bytes] = {}
        self._learn("", heads, first)
        if fresh := self.tails.missing(tails):
            self._learn(" ", fresh, self.tails.young)
        rest = self.tails.young
        out = [first[p[0]] + b"".join(map(rest.__getitem__, p[1:])) for p in parts]
        self.tails.age()
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, ids: bytes) -> str:
        return self.automaton.decode(np.frombuffer(ids, "<u4").tolist()).decode("utf-8", "replace")


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, *bounds: int) -> Encoder:
    """One automaton per worker process, vocabulary and bounds of its memory."""
    if (path, *bounds) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, *bounds] = Encoder(path, *bounds)
        remembers("bpe", _ENCODERS.clear)
    return _ENCODERS[path, *bounds]


def encode_decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode each whole text, decode it again, and return digests (and the ids with with_ids).

    A null text counts as empty: no tokens, and the digests of nothing. Repeated rows are encoded each; other
    columns are not read. A narrow transformation: no shuffle, rows stay where they were read.
    """
    ids_type = ", ids binary" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            ids = enc.encode_batch(b.column(1).to_pylist())
            cols = [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(enc.decode(x).encode()).hexdigest() for x in ids], pa.string())]
            if with_ids:
                cols.append(pa.array(ids, pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(cols)])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_or_empty(text_col).alias(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{ids_type}")
