"""Exact top-k and the divergence audit against brute force and their SQL, on awkward rows."""

import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.llm import divergence, queries, topk

VECTORS = "vec_id long, embedding array<float>, row long, id string, items string, query string, rank string"
DOCS = "doc_id long, text string, lang string, source string, n long, term string, kept string, total string, value string"


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def best(rows, k=20):
    """Every query against every other row, plainly."""
    held = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(held):
        if i is None or i % 20:
            continue
        scores = [(-sum(a * b for a, b in zip(q, w, strict=False)), j is None, j or 0, j) for m, (j, w) in enumerate(held) if m != n]
        out += [(i, rank, j, -s) for rank, (s, _, _, j) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(size=8) * (rng.random(8) < 0.6)]) for k in range(400)]
    # ties: a third of all rows is one vector
    rows += [(k, [0.5] * 8) for k in range(400, 600)]
    rows += [(1000, None), (1020, [0.1, None]), (1040, [float("nan")]), (1060, [float("inf")]), (1080, []), (1100, [1.0, 2.0]), (1120, [1e3] * 20), (None, [0.5] * 8), (None, [-0.5] * 8), (40, [0.25] * 8), (40, [0.25] * 8)]
    return [(*r, 1, "a", "b", "c", "d") for r in rows]


def test_topk(spark, vectors):
    df = spark.createDataFrame(vectors, VECTORS).repartition(5)
    assert got(topk.top_k(df, F.col("id") % 20 == 0)) == best(vectors)


def test_topk_few(spark, vectors):
    assert got(topk.top_k(spark.createDataFrame(vectors[:7], VECTORS), F.col("id") % 20 == 0)) == best(vectors[:7])
    assert got(topk.top_k(spark.createDataFrame(vectors[:1], VECTORS), F.col("id") % 20 == 0)) == []
    assert got(topk.top_k(spark.createDataFrame([], VECTORS), F.col("id") % 20 == 0)) == []


def test_topk_in_small_tiles(spark, monkeypatch):
    """Several tiles a shard, in one process: each query's best over all of them."""
    import pyarrow as pa

    monkeypatch.setattr(topk, "TILE", 7)
    rng = np.random.default_rng(1)
    dense = rng.integers(-3, 4, (60, 5))
    items = pa.array([{"row": k, "id": k, "terms": [int(t) for t in np.flatnonzero(v)], "weights": [int(x) for x in v[v != 0]]} for k, v in enumerate(dense)], pa.struct([("row", pa.int64()), ("id", pa.int64()), ("terms", pa.list_(pa.int32())), ("weights", pa.list_(pa.int64()))]))
    shard = topk.Shard(items)
    for j, scores, at in shard.best(topk._Rows(items), 9):
        want = sorted(((-int(dense[j] @ dense[i]), i) for i in range(60) if i != j))[:9]
        assert [(-s, shard.id[a]) for s, a in zip(scores, at, strict=True)] == want


def test_topk_large_weights(spark):
    """Sums beyond 32 bits and products beyond 53 are exact."""
    rows = [(20, [2.0**20, 1.0]), (1, [2.0**20, 3.0]), (2, [2.0**20, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(topk.top_k(df, F.col("id") % 20 == 0)) == [(20, 1, 1, 2**52 + 64 * 192), (20, 2, 2, 2**52 + 64 * 128)]


def audited(rows):
    """Every pair of sources over every kept term, plainly, in Python's integers."""
    n, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        n[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in docs:
        kept = [t for t, k in docs[lang].items() if k >= 3]
        sources = [s for x, s in n if x == lang]
        counts = {s: {t: n[lang, s][t] for t in kept} for s in sources}
        counts[None] = {t: sum(counts[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in counts.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], p[None][t]), t) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            for part, items in (("pair", pairs), ("term", sorted(terms, key=lambda x: (-x[0], x[1].encode()))[:200])):
                out += [(lang, s, part, item, v, rank) for rank, (v, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode())), 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def docs():
    rng = np.random.default_rng(9)
    words = ["the", "The", "naïve", "İstanbul", "日本語", "z" * 400, "_", "42", "x1y", "O'Neill", "ÉCOLE", "a\x00b"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(150)]
    rows = []
    for k in range(260):
        source = None if k % 50 == 0 else "hot" if k % 3 == 0 else f"s{k % 37}"
        rows.append((k, " ".join(rng.choice(words, rng.integers(0, 60), p=(w := 1 / np.arange(1, len(words) + 1)) / w.sum())), ["en", "de", None][k % 3 if k % 7 else 0], source))
    rows += [(900, None, "en", "silent"), (901, "", "en", ""), (902, "unique words only here", "xx", "a"), (903, None, "xx", "b"), (904, "\n\t ", None, None), (0, *rows[0][1:]), (905, "long " * 50_000, "en", "hot")]
    return [(*r, 1, "a", "b", "c", "d") for r in rows]


def test_audit(spark, docs):
    assert got(divergence.audit(spark.createDataFrame(docs, DOCS).repartition(3))) == audited(docs)


def test_audit_in_blocks(spark, docs, monkeypatch):
    """Blocks of few sources: pairs across blocks, each term in every tile that a source of it touches."""
    monkeypatch.setattr(divergence, "BLOCK", 5)
    monkeypatch.setattr(divergence, "LEAST_TILES", 2)
    assert got(divergence.audit(spark.createDataFrame(docs, DOCS))) == audited(docs)


def test_audit_empty(spark):
    assert got(divergence.audit(spark.createDataFrame([], DOCS))) == []


def test_counts_beyond_64_bits():
    big = 10**11
    assert divergence.shares(np.array([big, 0]), 3 * big, 7).tolist() == [1 + 10**9 * (big + 1) // (3 * big + 7), 1]


@pytest.mark.parametrize("name, table", [("op11_exact_topk", "embeddings"), ("op12_conversation_repair", "conversations"), ("op13_source_divergence", "documents")])
def test_sql(spark, name, table):
    con = duckdb.connect()
    con.sql(f"create view {table} as select * from '/root/testdata/sf0.001/{table}.parquet'")
    want = con.sql(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.columns == want.columns
    assert got(df) == sorted(want.fetchall(), key=str)
