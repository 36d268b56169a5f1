"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1; an n-gram's vector binds (multiplies) its letters' vectors, each rotated
by its place; a text's vector bundles (sums) those of its n-grams, a language's prototype those of its texts.
A text's language is that of the prototype with the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import text_or_empty

DIMENSIONS, GRAM = 512, 3
#: Most texts that prototypes are learned from; they are those whose ids hash lowest.
SAMPLE = 20_000
#: n-gram vectors a worker remembers.
MOST_GRAMS = 60_000
UNKNOWN = "und"


class Profiles:
    """Vectors of n-grams, made as they are met. A letter's vector depends on its code point alone."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM):
        self.dimensions, self.gram = dimensions, gram
        self.letters: dict[int, np.ndarray] = {}
        self._forget()

    def _forget(self) -> None:
        self.place: dict[int, int] = {}
        self.vectors = np.zeros((1024, self.dimensions), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = np.random.default_rng([2011, code]).choice(np.array([-1, 1], np.int8), self.dimensions)
        return self.letters[code]

    def _vector(self, gram: int) -> np.ndarray:
        out = np.ones(self.dimensions, np.int8)
        for k in range(self.gram):
            out *= np.roll(self.letter(gram >> 21 * k & 0x1FFFFF), k)
        return out

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct n-grams of the lower-cased letters, runs of anything else being one blank, and their counts; None without a letter."""
        words = "".join(c if c.isalpha() else " " for c in text) if not text.isascii() else text.translate(_ASCII)
        words = words.lower().split()
        if not words:
            return None
        codes = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.int64)
        grams = np.zeros(max(0, len(codes) - self.gram + 1), np.int64)
        for k in range(self.gram):
            grams |= codes[k : len(codes) - self.gram + 1 + k] << 21 * k
        return np.unique(grams, return_counts=True)

    def bundle(self, text: str) -> np.ndarray | None:
        got = self.grams(text)
        if got is None:
            return None
        grams, counts = got
        total = np.zeros(self.dimensions)
        for a in range(0, len(grams), 4096):
            at = self._places(grams[a : a + 4096].tolist())
            total += counts[a : a + 4096].astype(np.float32) @ self.vectors[at].astype(np.float32)
        return total

    def _places(self, grams: list[int]) -> list[int]:
        if len(self.place) + len(grams) > MOST_GRAMS:
            self._forget()
        for g in grams:
            if g not in self.place:
                n = len(self.place)
                if n == len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
                self.vectors[n] = self._vector(g)
                self.place[g] = n
        return [self.place[g] for g in grams]


_ASCII = {c: " " for c in range(128) if not chr(c).isalpha()}


def in_fold(df: DataFrame, id_col: str = "doc_id", fold: int = 1, folds: int = 3):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Prototypes from at most sample rows of df with a language and an id. Tasks bundle what they read; only sums move."""
    rows = df.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    chosen = rows.select(F.col(id_col).alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = rows.join(F.broadcast(chosen), rows[id_col] == chosen["_id"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = Profiles(), {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = own.bundle(text)
                if v is not None:
                    sums[lang] = sums.get(lang, 0) + v
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([s.astype(np.int64).tolist() for s in sums.values()], pa.list_(pa.int64()))], ["lang", "v"])

    sums = rows.select(F.col(lang_col).cast("string").alias("lang"), text_or_empty(text_col)).mapInArrow(run, "lang string, v array<long>")
    sums = sums.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return {r["lang"]: np.array([x["x"] for x in r["v"]], float) for r in sums.orderBy("lang").collect()}


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred and score (the cosine moved to 0..1) of every whole text; `und` and 0 for null and letterless ones.

    Ties go to the first language in code point order; without prototypes all are `und`. Only the text is an input.
    """
    names = sorted(prototypes)
    matrix = np.array([prototypes[x] / max(np.linalg.norm(prototypes[x]), 1e-9) for x in names]).reshape(len(names), DIMENSIONS)
    kind = dict(df.dtypes)[id_col]
    state: list[Profiles] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = state[0] if state else Profiles()
        for b in batches:
            langs, scores = [], []
            for text in b.column(2).to_pylist():
                v = own.bundle(text) if names else None
                cosine = matrix @ v / max(np.linalg.norm(v), 1e-9) if v is not None else None
                langs.append(UNKNOWN if cosine is None else names[int(cosine.argmax())])
                scores.append(0.0 if cosine is None else float(min(1.0, max(0.0, (1 + cosine.max()) / 2))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [id_col, "held_out", "lang_pred", "score"])

    return df.select(id_col, in_fold(df, id_col).alias("held_out"), text_or_empty(text_col).alias("_t")).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")
