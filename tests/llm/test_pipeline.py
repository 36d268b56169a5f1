"""The pipeline's stages, each held against what its operator says of the stage's own input."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from sigloom.llm import quality
from tests.llm.test_operators import brute_components

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs.toPandas()
    q, e, j, s, p = (kept[n] for n, _ in corpus_pipeline.STAGES)
    for t in q.text:
        c = quality.statistics(t)
        assert c[0] >= 10 and 100 * c[4] <= 20 * c[0]
    norm = Counter(re.sub(r"[\x20\x09-\x0D]+", " ", t) for t in q.text)
    assert Counter(re.sub(r"[\x20\x09-\x0D]+", " ", t) for t in e.text) == Counter(dict.fromkeys(norm, 1))
    assert set(j.doc_id) <= set(e.doc_id) and set(s.doc_id) == set(j.doc_id)
    assert not s.text.str.contains("AKIA[A-Z0-9]{16}", regex=True).any()
    assert set(p.doc_id) == set(s.doc_id) and p.groupby("sequence_id").length.sum().max() <= 2048


def _fixture():
    """(id, text, kind): clean texts, such with many symbols, repeats, copies, near copies, secrets, awkward rows."""
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(("al", "bo", "ce", "di", "fu")) + rng.choice(("ran", "set", "kin", "lot")) + rng.choice(("a", "e", "i", "o")) * rng.randint(0, 2) for _ in range(n))
    out = [(k, prose(80 + k), "clean") for k in range(60)]
    out += [(100 + k, " ".join(f"{w}{rng.randint(0, 9999)} # $ %" for w in prose(18 + k % 18).split()), "junk") for k in range(40)]
    out += [(200, out[3][1], "copy"), (201, out[3][1].replace(" ", "  "), "copy"), (202, out[7][1] + " one tail", "near"), (203, "an early word " + out[7][1] + " one tail", "near")]
    out += [(204, prose(60) + " AKIA" + "Q7" * 8 + " " + prose(20), "secret"), (205, prose(60) + " password=hunter2x end " + prose(20), "secret"), (206, prose(60) + " kJ8x2Qm4Zp9Lr7Tn3Vb6Wd1 " + prose(20), "secret")]
    out += [(207, None, "empty"), (208, "", "empty"), (209, "few words", "short"), (210, "up and down it goes again " * 12, "repeats"), (211, prose(9000), "long"), (212, "été 日本 " + prose(70), "clean")]
    return out


def _masked(text):
    spans = [m.span() for m in re.finditer(r"AKIA[A-Z0-9]{16,}|(?i:password)=[A-Za-z0-9]{6,}|kJ8x2Qm4Zp9Lr7Tn3Vb6Wd1", text)]
    for a, b in reversed(spans):
        text = text[:a] + "[SECRET]" + text[b:]
    return text


def _brute(rows):
    good = []
    for k, t, kind in rows:
        words = (t or "").split()
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        hit = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
        if len(words) >= 10 and 100 * len(hit) <= 20 * len(words) and kind != "junk":
            good.append((k, t))
    first = {}
    for k, t in sorted(good):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (k, t))
    left = sorted(first.values())
    _, roots = brute_components([t for _, t in left])
    return [(k, _masked(t)) for i, (k, t) in enumerate(left) if roots[i] == i]


def test_run_against_brute_force(spark, tmp_path):
    rows = _fixture()
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, spans string, n_words string, row string, _t string"
    spark.createDataFrame([(k, t, "en", "s", len(t or ""), "k", "p", "w", "r", "x") for k, t, _ in rows], schema).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, int(kind != "junk"), 0) for k, _, kind in rows if kind in ("clean", "junk")]
    spark.createDataFrame([*labels, (None, 0, 0), (207, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name in ("quality_rules", "exact_dedup", "ngram_jaccard_join", "secret_scan"):
        docs = stages[name](spark, docs, str(tmp_path))
        assert docs.columns == spark.read.parquet(f"{tmp_path}/documents.parquet").columns
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    want = _brute(rows)
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == want
    assert {(r.kept, r.spans, r.n_words, r.row, r._t) for r in docs.collect()} == {("k", "p", "w", "r", "x")}
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append(r)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted(got) == [k for k, _ in want]
    for k, t in want:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        pieces = sorted(got[k], key=lambda r: r.piece)
        assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1]]
        assert sum(r.length for r in pieces) == len(ids) and all(r.length == 2048 for r in pieces[1:])
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in pieces)
    total = sum(r.length for x in got.values() for r in x)
    assert len({r.sequence_id for x in got.values() for r in x}) <= -(-total // 2048) + 1


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int, kept boolean").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
