"""Operators against brute force, on awkward rows: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sigloom.llm import bpe, exact, jaccard, language, packing, quality, repeats, secrets, urls, warc

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
BASE = "the quick brown fox jumps over the lazy dog while seven wizards quietly box five dozen liquor jugs near an old stone bridge today "
LONG = " ".join(f"w{i * 7919 % 10007}" for i in range(20000))
TEXTS = [
    BASE, BASE.replace("today", "tonight"), BASE, None, "", "  \n\t ", "a", "one two three four", "one  two three\tfour", LONG, LONG + " tail", LONG[5:],
    "x" * 3000, "x" * 2990 + "y", "ünïcödé " * 40, "日本語のテキスト" * 30, "<|endoftext|> a  b\n\n c \x1c\x85 d", "password = \"hunter2hunter\" ok", "AKIA" + "A1" * 8, "id deadbeef" * 3 + "0123456789abcdef01234567",
    "secret=token: abcdefgh Token:  'zzzzzz' ſecret=abcdefg", "key kJ8x2Qm4Zp9Lr7Tn3Vb6Wd1 end", "# * $ % & | < >\n" * 5, "same line here\nsame line here\nother\n\n\n", "up up up up up up up up up up up up", BASE * 3, "z " * 60 + BASE,
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n string, node string, spans string, doc string"


@pytest.fixture(scope="module")
def rows():
    out = [(k, t, "en" if k % 2 else None, "s", 1, "k", "n", "o", "p", "d") for k, t in enumerate(TEXTS)]
    return [*out, (2, TEXTS[2], None, None, None, None, None, None, None, None), (None, BASE, "en", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_bpe(docs, rows):
    tok = Tokenizer.from_file(VOCABULARY)
    want = []
    for r in rows:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert by_id(bpe.encode_decode(docs, VOCABULARY)) == sorted(want, key=str)


def test_bpe_lockstep_equals_search():
    a = bpe.encoder(VOCABULARY).automaton
    words = [b" the", b"aaaaaaa", "naïveté".encode(), b"zq" * 20, bytes(range(200, 240))]
    assert [np.frombuffer(x, "<u4").tolist() for x in a.encode_many(words)] == [a.encode(w) for w in words]
    assert all(a.decode(a.encode(w)) == w for w in words)


def test_packing(docs, rows):
    tok = Tokenizer.from_file(VOCABULARY)
    got = packing.pack(docs, VOCABULARY).collect()
    lengths = Counter()
    for r in got:
        lengths[r.doc_id] += r.length
    for r in rows[: len(TEXTS)]:
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0]
        if r[0] != 2:
            assert lengths[r[0]] == len(ids)
            for p in (x for x in got if x.doc_id == r[0]):
                assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
                assert p.length == 2048 or p.piece == 0
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        held.sort()
        assert [o for o, _ in held] == np.cumsum([0, *[n for _, n in held]]).tolist()[:-1]
        assert sum(n for _, n in held) <= 2048


def test_best_fit_closes_the_fullest():
    fit = packing.BestFit(10, open_bins=2)
    assert [fit.place(n) for n in (6, 7, 3, 8, 4)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6)]
    fit = packing.BestFit(10, open_bins=1)
    assert [fit.place(n) for n in (6, 7, 4)] == [(0, 0), (1, 0), (0, 6)]


def test_exact(docs, rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    size = Counter(norm)
    first = {t: min((r[0] for r, x in zip(rows, norm, strict=True) if x == t and r[0] is not None), default=None) for t in size}
    got = exact.exact_dedup(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == sorted(((r[0], first[t], size[t], hashlib.sha256(t.encode()).hexdigest()) for r, t in zip(rows, norm, strict=True)), key=str)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in size)
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns
    assert Counter(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept.collect()) == Counter(dict.fromkeys(size, 1))


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sets, [find(i) for i in range(len(sets))]


def test_jaccard(spark, rows, docs):
    own = rows[: len(TEXTS)]
    sets, roots = brute_components([r[1] for r in own])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).where("doc_id is not null").collect()}
    assert got == {r[0]: (len(s), c) for r, s, c in zip(own, sets, roots, strict=True)}


def test_jaccard_near_copies(spark):
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(3):
        base = [f"v{x}" for x in rng.integers(0, 10**6, 120)]
        for _ in range(60):
            w = list(base)
            for at in rng.integers(0, 120, rng.integers(1, 9)):
                w[at] = f"u{rng.integers(0, 10**6)}"
            texts.append(" ".join(w))
    _, roots = brute_components(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r[1] for r in sorted((r.doc_id, r.component_id) for r in jaccard.near_duplicates(df).collect())] == roots
    assert sorted(r.doc_id for r in jaccard.keep_one(df).collect()) == sorted(set(roots))


def test_region_pairs_lose_nothing():
    rng = np.random.default_rng(4)
    centres = [rng.integers(0, 1 << 62, 100, dtype=np.uint64) for _ in range(12)]
    sets = [np.unique(np.r_[c[: rng.integers(80, 101)], rng.integers(0, 1 << 62, rng.integers(0, 15), dtype=np.uint64)]) for c in centres for _ in range(60)]
    got = {tuple(p) for p in jaccard.region_pairs(np.array([len(s) for s in sets]), np.arange(len(sets)), [jaccard.sketch(s) for s in sets])}
    for i in range(len(sets)):
        for j in range(i):
            if jaccard.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])):
                assert (j, i) in got


def brute_repeats(pairs):
    first, out = {}, {}
    for d, t in sorted(pairs):
        b, fresh = t.encode(), set()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            if w in first:
                gone[i : i + 50] = True
            else:
                fresh.add(w)
        first.update(dict.fromkeys(fresh, d))
        out[d] = (len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_repeats(docs, rows):
    got = {r.doc_id: tuple(r)[1:] for r in repeats.remove_repeats(docs).where("doc_id is not null").collect()}
    assert got == brute_repeats([(r[0], r[1] or "") for r in rows[: len(TEXTS)]])


def test_repeats_of_frequent_anchors(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", 3)
    rng = np.random.default_rng(5)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(1, 9)))
    ends = [" ".join(word() for _ in range(12)) for _ in range(6)]
    pairs = [(k, " ".join([word(), ends[rng.integers(6)], "a passage of thirty bytes or so", ends[rng.integers(6)], word(), "ab" * 40])) for k in range(80)]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    assert {r.doc_id: tuple(r)[1:] for r in repeats.remove_repeats(df).collect()} == brute_repeats(pairs)


def test_maximal_repeats():
    found = {(depth, tuple(sorted(zip(t.tolist(), p.tolist(), strict=True)))) for depth, _, t, p in repeats.maximal_repeats([b"xabcdefy", b"zabcdefw", b"abcdq"], np.arange(3), 4)}
    assert found == {(6, ((0, 1), (1, 1))), (4, ((0, 1), (1, 1), (2, 0)))}


def test_warc(spark):
    page = "<p>" + "content " * 20 + "\r\n\r\nWARC/1.1</p>"
    pages = [(3, "http://a/", page, 1), (1, "http://b/\r\nx", page, 2), (7, None, page, 3), (4, "u", "short", 4), (5, "u", "short", 5), (6, "u", None, 6), (8, "u", "", 7), (None, "u", page, 8), (9, "u", "é" * 50, 9)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest long")
    got = {r.page_id: tuple(r)[1:] for r in warc.archive_pages(df).collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    for i, _, html, _ in pages:
        again = html == page and i != 1
        assert got[i] == (len((html or "").encode()), sha(html), "revisit" if again else "response", 1 if again else None)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_warc_of_string_ids_and_awkward_blocks(spark):
    """Blocks that look like records or end in line breaks, ids with line breaks, repeated rows; the session's settings stay."""
    end = "\r\n\r\n"
    blocks = [end, f"a{end}", f"\r\n{end}b\r\n", f"WARC/1.1\r\nContent-Length: 3{end}x", "x" * 200 + end + "\r\n", "x" * 200 + end + "\r\n", "日" * 40]
    rows = [(f"p{k}\r\nq", "u", b) for k, b in enumerate(blocks)]
    rows += [rows[-1], (None, "u", "y" * 120), (None, None, "y" * 120)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = sorted((tuple(r) for r in warc.archive_pages(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()), key=str)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(i, len(b.encode()), sha(b), "revisit" if i == "p5\r\nq" else "response", "p4\r\nq" if i == "p5\r\nq" else None) for i, _, b in rows]
    assert got == sorted(want, key=str)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_a_revisit_without_its_response_is_an_error(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "x" * 150), (2, "u", "x" * 150)], "page_id long, url string, html string")
    warc.write_archives(warc.assign_roles(df).where("id = 2"), str(tmp_path / "w"))
    with pytest.raises(Exception, match="not there"):
        warc.read_archives(df, str(tmp_path / "w")).collect()
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab"))


PATTERNS = {
    "assign": r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
}


def base_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or "", re.ASCII):
            if {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}[kind](m):
                out.append((m.start(), k, kind, m.end()))
    return sorted(out)


def test_secrets(docs, rows):
    got = {r.doc_id: r for r in secrets.report(docs.where("doc_id is not null")).collect()}
    for r in rows[: len(TEXTS)]:
        spans = base_spans(r[1])
        digest = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
        g = got[r[0]]
        assert (g.n_assign, g.n_access, g.n_hex) == tuple(sum(s[2] == k for s in spans) for k in PATTERNS)
        assert g.base_sha256 == hashlib.sha256(digest.encode()).hexdigest()
        assert set(filter(None, digest.split(","))) <= set(g.spans.split(","))
    assert "entropy" in got[21].spans
    texts = {r.doc_id: r.text for r in secrets.redact(docs.where("doc_id is not null")).collect()}
    assert texts[3] is None and texts[0] == BASE and texts[21] == "key [SECRET] end" and "hunter2" not in texts[17]


def test_entropy(spark):
    word = "aB3dE6gH9jK2mN5pQ8sT"
    df = spark.createDataFrame([(word + "aaaaaaaaaa",), ("a" * 30,), ("abababababababababab",)], "c string")
    got = [r[0] for r in df.select(secrets.window_entropy(F.col("c"), 20)).collect()]
    assert got == pytest.approx([np.log2(20), 0, 1])


def test_urls(spark):
    links = [None, "no scheme", "http://", "https://Sub.EXAMPLE.com/en/7x?q", "https://x.com/en/1#f", "http://plain.net/a", "https://plain.net/b", "https://other.net/b", "https://a.example.net/de/81", "https://b.net/de/1?x", "https://xcom/en/", "https://o.org?x=/es/", "https://o.org/es/://b"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(links)], "page_id long, url string")
    want = [("", "", None, "allow")] * 3 + [
        ("sub.example.com", "/en/7x", "example.com/en/7", "allow"), ("x.com", "/en/1", "com/en/", "block"), ("plain.net", "/a", None, "block"), ("plain.net", "/b", None, "block"), ("other.net", "/b", None, "allow"),
        ("a.example.net", "/de/81", "example.net/de/8", "block"), ("b.net", "/de/1", "net/de/", "allow"), ("xcom", "/en/", None, "allow"), ("o.org", "", None, "allow"), ("o.org", "/es/://b", "org/es/", "block"),
    ]
    want[:3] = [("", "", None, "block")] * 3  # the empty host serves http:// itself
    for most, part in ((urls.MOST_BITS, urls.PART_KEYS), (8, urls.PART_KEYS), (8, 2), (urls.MOST_BITS, 2)):
        assert [tuple(r)[1:] for r in sorted(urls.judge(df, urls.listed_hosts(df), most_bits=most, part_keys=part).collect())] == want


@pytest.mark.parametrize("part_keys", [urls.PART_KEYS, 300])
def test_cascade_is_exact(spark, part_keys):
    universe = spark.range(5000).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = urls.build(universe, part_keys)
    keys = [f"h{k}" for k in range(5000)]
    assert cascade.listed(keys).tolist() == [k % 7 == 0 for k in range(5000)]
    assert len(cascade.paths) > 2 and cascade.parts == (17 if part_keys == 300 else 1)
    for odd in ("", "é", "x" * 100):
        assert spark.range(1).select(urls._part(F.lit(odd), 17)).first()[0] == urls.part_of(odd, 17)


def test_a_large_cascade_judges_every_row(spark):
    """Filters that go to the rows by parts, with a host that holds half of all rows."""
    df = spark.range(20000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 2 == 0, "http://hot.org/a").otherwise(F.concat(F.when(F.col("id") % 3 == 0, "http://h").otherwise("https://h"), (F.col("id") % 900).cast("string"), F.lit(".net/b"))).alias("url"))
    small = {tuple(r) for r in urls.judge(df, urls.listed_hosts(df)).collect()}
    large = {tuple(r) for r in urls.judge(df, urls.listed_hosts(df), most_bits=8, part_keys=50).collect()}
    assert small == large and len(small) == 20000


def test_quality_statistics(rows):
    for r in rows[: len(TEXTS)]:
        t = r[1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        hit = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert quality.statistics(t)[:5] == (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))


def test_quality_rules(spark, docs):
    rng = np.random.default_rng(0)
    counts = np.stack([np.full(600, 100), np.full(600, 500), np.r_[rng.integers(0, 5, 400), rng.integers(60, 200, 200)], *[np.zeros(600, int)] * 2, np.full(600, 5), *[np.zeros(600, int)] * 3, np.full(600, 80)], 1)
    bad = np.arange(600) >= 400
    rules = quality.learn(counts, bad)
    assert rules and rules[0][0][0] == "symbols"
    assert quality.learn(counts[:0], bad[:0]) == []
    out = quality.judge(docs, rules).where("doc_id is not null").collect()
    assert {r.doc_id: r.kept for r in out}[0] and not {r.doc_id: r.kept for r in out}[3]
    labels = spark.createDataFrame([(0, 1, 0), (1, None, 0), (22, 0, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, labels) == []


def test_language(spark, docs):
    prototypes = language.fit(spark.createDataFrame([(k, t, g) for k, (t, g) in enumerate([("the cat sat on the mat", "en"), ("le chat est sur la table", "fr")] * 5)], "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in language.predict(docs.where("doc_id is not null"), prototypes).collect()}
    assert got[3].lang_pred == "und" == got[4].lang_pred and got[0].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[1].held_out == (zlib.crc32(b"1") % 3 == 1)
    assert {r.lang_pred for r in language.predict(docs, {}).collect()} == {"und"}


def test_empty_tables(none):
    assert bpe.encode_decode(none, VOCABULARY).count() == 0
    assert packing.pack(none, VOCABULARY).count() == 0
    assert exact.exact_dedup(none).count() == 0
    assert jaccard.near_duplicates(none).count() == 0
    assert repeats.remove_repeats(none).count() == 0
    assert secrets.report(none).count() == 0
    assert quality.judge(none, [], columns=["doc_id"]).count() == 0
    assert language.predict(none, language.fit(none)).count() == 0
    pages = none.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"))
    assert urls.judge(pages, urls.listed_hosts(pages)).count() == 0


def test_jaccard_identities_that_meet(spark, rows, docs):
    """Sets whose first 6 bits meet are told apart by the other half."""
    own = rows[: len(TEXTS)]
    _, roots = brute_components([r[1] for r in own])
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs, id_bits=6).where("doc_id is not null").collect()}
    assert got == {r[0]: c for r, c in zip(own, roots, strict=True)}


def test_neighbourhoods_keep_every_link():
    rng = np.random.default_rng(11)
    for _ in range(40):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(30)]
        sets += [np.unique(np.r_[s, rng.integers(0, 60, 2).astype(np.uint64)]) for s in sets[:15]]
        sig, node, n, place = [], [], [], []
        for k, s in enumerate(sets):
            m = len(s) - (75 * len(s) + 99) // 100 + 1
            for i, x in enumerate(s[:m]):
                sig.append(x)
                node.append(k)
                n.append(len(s))
                place.append(i * 256 // len(s))
        group, who, _, _ = jaccard.neighbourhoods(np.array(sig, np.uint64), *(np.array(x, np.int64) for x in (node, n, place)))
        shared = {(a, b) for g in set(group.tolist()) for a in who[group == g].tolist() for b in who[group == g].tolist()}
        for i, a in enumerate(sets):
            for j in range(i):
                if jaccard.linked(len(np.intersect1d(a, sets[j])), len(a), len(sets[j])):
                    assert (i, j) in shared


def naive_best_fit(needs, capacity, most):
    bins, out, n = {}, [], 0
    for need in needs:
        fits = sorted((free, -at) for at, free in bins.items() if free >= need)
        if fits:
            free = fits[0][0]
            at = max(at for at, f in bins.items() if f == free)
        else:
            at, free, n = n, capacity, n + 1
        out.append((capacity - free, free))
        bins.pop(at, None)
        if free > need:
            bins[at] = free - need
        if len(bins) > most:
            full = min(bins.values())
            bins.pop(max(at for at, f in bins.items() if f == full))
    return out


def test_best_fit_against_brute_force():
    rng = np.random.default_rng(9)
    for most in (1, 3, 50):
        needs = rng.integers(1, 40, 500).tolist()
        fit = packing.BestFit(40, open_bins=most)
        got = [fit.place(n)[1] for n in needs]
        assert got == [offset for offset, _ in naive_best_fit(needs, 40, most)]


@pytest.mark.parametrize("parts", [1, 64])
def test_few_sequences_whatever_the_tasks(spark, parts):
    rng = np.random.default_rng(2)
    texts = [(k, "ab cd " * int(rng.integers(1, 400))) for k in range(600)]
    out = packing.pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(parts), VOCABULARY).collect()
    total = sum(r.length for r in out)
    assert len({r.sequence_id for r in out}) <= -(-total // 2048) * 1.01 + 1
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out)


def test_library_ids_equal_on_awkward_texts():
    tok, enc = Tokenizer.from_file(VOCABULARY), packing.Ranked(VOCABULARY)
    texts = ["", " " * 1_100_000, "a" * 60_000, "<|endoftext|> x <|endoftext|>", "a԰bԯ  \x85\xa0\x1c", "日本 ١٢٣  x"]
    texts += ["".join(f"a{chr(c)}1{chr(c)}! {chr(c)}  {chr(c)}x" for c in range(a, a + 64) if not 0xD800 <= c < 0xE000) for a in range(0, 0x110000, 64)]
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_chunks_spell_the_text(spark):
    texts = [t for t in TEXTS if t] + ["One two three. " * 400, "日本語です。" * 300, "привет мир " * 300, "q7A" * 5000, "x" * 9000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    cut = df.select("doc_id", F.regexp_extract_all(exact.normalised(), F.lit(exact.CHUNK), F.lit(0)).alias("c"), exact.normalised().alias("t")).collect()
    assert all("".join(r.c) == r.t for r in cut)
    assert all(len(x) <= exact.MOST for r in cut for x in r.c) and max(len(r.c) for r in cut) > 10
    rng = np.random.default_rng(6)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(2, 9)))
    one = " ".join(" ".join([word().title(), *(word() for _ in range(rng.integers(3, 15)))]) + "." for _ in range(2000))
    two = one
    moved = spark.createDataFrame([(1, one), (2, "A new start. " + two)], "doc_id long, text string").select(F.regexp_extract_all(exact.normalised(), F.lit(exact.CHUNK), F.lit(0)).alias("c")).collect()
    assert len(set(moved[0].c) & set(moved[1].c)) > 0.9 * len(moved[0].c)


def test_clashing_columns(spark):
    names = ["kept", "spans", "base", "n_words", "base_failed", "_t", "_c", "row", "e", "text_sha256", "_id", "_mark", "_gone", "first"]
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in names)
    rows = [(1, "password = hunter2hunter " + BASE, *names), (2, BASE, *names), (3, "few", *names), (None, None, *names)]
    df = spark.createDataFrame(rows, schema)
    for out in (secrets.redact(df), quality.keep_good(df, []), exact.drop_copies(df), jaccard.keep_one(df)):
        assert out.columns == df.columns
        got = [tuple(r) for r in out.collect()]
        assert got and all(r[2:] == tuple(names) for r in got)
    assert sorted(r.doc_id for r in quality.keep_good(df, []).collect()) == [1, 2]
    for call in (lambda: secrets.scan(df), lambda: quality.judge(df, [], columns=df.columns)):
        with pytest.raises(ValueError):
            call()


def test_language_against_brute_force(spark):
    """Prototypes and cosines from vectors of whole texts, made n-gram by n-gram; ties go to the first language."""
    own = language.Profiles()
    texts = [("the cat sat on the mat", "en"), ("le chat est sur la table", "fr"), ("die katze sitzt auf der matte", "de"), ("the dog and the bird", "en")]

    def vector(text):
        words = re.sub(r"[\W\d_]+", " ", text).lower().split()
        codes = [ord(c) for c in f" {' '.join(words)} "]
        total = np.zeros(language.DIMENSIONS)
        for i in range(len(codes) - language.GRAM + 1):
            v = np.ones(language.DIMENSIONS)
            for k in range(language.GRAM):
                v *= np.roll(own.letter(codes[i + k]), k)
            total += v
        return total

    train = spark.createDataFrame([(k, t, g) for k, (t, g) in enumerate(texts)], "doc_id long, text string, lang string")
    sums = {g: sum(vector(t) for t, x in texts if x == g) for g in ("de", "en", "fr")}
    fitted = language.fit(train)
    assert all((fitted[g] == sums[g]).all() for g in sums) and sorted(fitted) == sorted(sums)
    asked = ["a mat for the dog", "la table", "katze", "zzz", "  12 ", None]
    got = {r.doc_id: r for r in language.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), fitted | {"zz": fitted["en"]}).collect()}
    for k, t in enumerate(asked):
        if t is None or not re.search("[a-z]", t):
            assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
            continue
        cosines = {g: sums[g] @ vector(t) / np.linalg.norm(sums[g]) / np.linalg.norm(vector(t)) for g in sums}
        best = max(sorted(cosines), key=cosines.get)
        assert got[k].lang_pred == best and got[k].score == pytest.approx((1 + cosines[best]) / 2)
