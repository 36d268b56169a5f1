"""Quality rules: text statistics, and a decision list that sequential covering learns from labelled ones."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import text_or_empty
from sigloom.llm.words import window_hashes, word_hashes

#: Most labelled documents that the rules are learned from; they are those whose ids hash lowest.
SAMPLE = 20_000
#: Most rules of the list, and most thresholds of a rule: what a person can still read. Documents beyond them stay.
RULES, LITERALS = 32, 4
#: Least share of rejected among the sample's documents that a rule covers, and least documents that it covers.
PRECISION, COVER = 0.95, 10
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_stops", "n_distinct")
#: Ratios that rules test, per 1000 and whole, so that Spark and the learner agree: name, numerator, denominator.
RATIOS = (
    ("chars_a_word", "word_chars", "n_words"),
    ("symbols", "n_symbols", "word_chars"),
    ("dup_lines", "n_dup_lines", "n_lines"),
    ("repeats", "n_repeat_words", "n_words"),
    ("upper", "n_upper", "word_chars"),
    ("digits", "n_digits", "word_chars"),
    ("stops", "n_stops", "n_words"),
    ("distinct", "n_distinct", "n_words"),
    ("words_a_line", "n_words", "n_lines"),
)


def statistics(text: str) -> tuple[int, ...]:
    """COUNTS of one whole text."""
    words = text.encode().split()
    n = len(words)
    repeat = 0
    if n >= 5:
        h = window_hashes(word_hashes(words))
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        if twice.any():
            cover = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + 5, -1)
            repeat = int((np.cumsum(cover)[:n] > 0).sum())
    lines = Counter(x for x in text.split("\n") if x.strip(" \t\n\v\f\r"))
    n_lines = lines.total()
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    ascii_only = text.encode("ascii", "ignore")
    upper = len(ascii_only) - len(ascii_only.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(ascii_only) - len(ascii_only.translate(None, b"0123456789"))
    stops = len(ascii_only) - len(ascii_only.translate(None, b".,;:!?"))
    return n, chars, sum(map(text.count, "#*$%&|<>")), n_lines - len(lines), repeat, n_lines, upper, digits, stops, len(set(words))


def with_statistics(df: DataFrame, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """columns of df (all by default) and COUNTS; a null text has no words. A narrow transformation by Arrow batches."""
    columns = df.columns if columns is None else columns
    if clash := set(COUNTS) & set(columns):
        raise ValueError(f"columns {sorted(clash)} would clash")
    schema = df.select(columns).schema
    for name in COUNTS:
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(x) for x in b.column(b.num_columns - 1).to_pylist()]
            counts = np.array(rows, np.int64).reshape(len(rows), len(COUNTS))
            cols = [b.column(k) for k in range(b.num_columns - 1)] + [pa.array(counts[:, k]) for k in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in schema])

    return df.select(*columns, text_or_empty(text_col).alias("_whole")).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def keep_good(docs: DataFrame, rules: list, text_col: str = "text") -> DataFrame:
    """The rows of docs that judge keeps, with all their columns as they are, whatever their names."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    kept = judge(packed, rules, columns=["row"]).where("kept")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def ratio(name: str) -> Column:
    if name in COUNTS:
        return F.col(name)
    _, a, b = next(r for r in RATIOS if r[0] == name)
    return F.when(F.col(b) > 0, F.expr(f"(1000 * {a}) div {b}")).otherwise(0)


def _ratios(counts: np.ndarray) -> dict[str, np.ndarray]:
    by = dict(zip(COUNTS, counts.T, strict=True))
    return {"n_words": by["n_words"]} | {name: np.where(by[b] > 0, 1000 * by[a] // np.maximum(by[b], 1), 0) for name, a, b in RATIOS}


def learn(counts: np.ndarray, bad: np.ndarray) -> list[list[tuple[str, str, int]]]:
    """Sequential covering: grow a conjunction by FOIL gain on two thirds, prune it on the rest, take out what it covers, go on.

    A rule is a list of (ratio, "<=" or ">=", threshold), and says reject. It is kept when, on all rows, at least COVER
    rows and a share of PRECISION are bad; its thresholds then take in the bad rows that lie next. What no rule covers stays.
    """
    x, rules = _ratios(counts), []
    n = len(bad)
    grow_part = np.random.default_rng(7).permutation(n) % 3 > 0 if n else np.zeros(0, bool)
    left = np.ones(n, bool)
    cuts = {k: np.unique(np.concatenate([np.quantile(v[m], np.linspace(0, 1, 33), method="lower") for m in (bad, ~bad) if m.any()])) if n else [] for k, v in x.items()}
    holds = lambda lit: x[lit[0]] <= lit[2] if lit[1] == "<=" else x[lit[0]] >= lit[2]

    def covered(rule: list) -> np.ndarray:
        got = np.ones(n, bool)
        for lit in rule:
            got &= holds(lit)
        return got

    def stretched(rule: list) -> list:
        """Each threshold moved out to the last bad row before the first good one that it would take in."""
        for k, (name, sign, t) in enumerate(rule):
            here = left & covered(rule[:k] + rule[k + 1 :])
            v, t = (x[name], t) if sign == "<=" else (-x[name], -t)
            good = v[here & ~bad & (v > t)].min(initial=np.iinfo(np.int64).max)
            t = int(v[here & bad & (v < good)].max(initial=t))
            rule = [*rule[:k], (name, sign, t if sign == "<=" else -t), *rule[k + 1 :]]
        return rule

    while (left & bad).sum() >= COVER and len(rules) < RULES:
        rule, now = [], left & grow_part
        for _ in range(LITERALS):
            p0, n0 = (now & bad).sum(), (now & ~bad).sum()
            if not p0 or not n0:
                break
            best, best_gain = None, 0.0
            for name, at in cuts.items():
                for t in at:
                    for sign in ("<=", ">="):
                        got = now & holds((name, sign, t))
                        p, q = (got & bad).sum(), (got & ~bad).sum()
                        gain = p * (np.log2(p / (p + q)) - np.log2(p0 / (p0 + n0))) if p else 0.0
                        if gain > best_gain:
                            best, best_gain = (name, sign, int(t)), gain
            if best is None:
                break
            rule.append(best)
            now &= holds(best)
        rest = left & ~grow_part
        worth = []
        for k in range(1, len(rule) + 1):
            got = rest & covered(rule[:k])
            p, q = (got & bad).sum(), (got & ~bad).sum()
            worth.append(((p - q) / (p + q) if p + q else -1.0, -k))
        if not worth:
            break
        rule = stretched(rule[: -max(worth)[1]])
        got = left & covered(rule)
        p, q = (got & bad).sum(), (got & ~bad).sum()
        if p + q < COVER or p < PRECISION * (p + q):
            break
        rules.append(rule)
        left &= ~got
    return rules


def verdict(rules: list[list[tuple[str, str, int]]]) -> Column:
    """The decision list as one ordered conditional expression: false where a rule rejects."""
    out = None
    for rule in rules:
        when = F.lit(True)
        for name, sign, t in rule:
            when = when & (ratio(name) <= t if sign == "<=" else ratio(name) >= t)
        out = F.when(when, False) if out is None else out.when(when, False)
    return F.lit(True) if out is None else out.otherwise(True)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", sample: int = SAMPLE) -> list[list[tuple[str, str, int]]]:
    """Rules from the quality labels of at most sample documents; their statistics (numbers, no texts) come to the driver."""
    known = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min("quality").alias("_quality"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    some = docs.join(F.broadcast(known), docs[id_col] == known["_id"]).select("_quality", text_or_empty().alias("text"))
    rows = with_statistics(some, "text", ["_quality"]).toPandas()
    counts = rows[list(COUNTS)].to_numpy(np.int64).reshape(len(rows), len(COUNTS))
    open_ = (counts[:, 0] >= 10) & (100 * counts[:, 4] <= 20 * counts[:, 0])
    order = np.lexsort(counts[open_].T)
    return learn(counts[open_][order], rows["_quality"].to_numpy()[open_][order] == 0)


def judge(docs: DataFrame, rules: list, id_col: str = "doc_id", columns: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """columns (the id by default), COUNTS, base_failed and kept of every row.

    A null, empty or wordless text has no words and fails the base rules. Rows that repeat are judged alike, each; an empty table gives
    no rows. A text's verdict depends on its counts alone, so ties cannot arise. columns named like a result are an error.
    """
    columns = columns or [id_col]
    if clash := {*COUNTS, "base_failed", "kept"} & set(columns):
        raise ValueError(f"columns {sorted(clash)} would clash")
    out = with_statistics(docs, text_col, columns)
    return out.withColumn("base_failed", base_failed()).withColumn("kept", F.when(base_failed(), False).otherwise(verdict(rules)))
