"""Secret scans over very long candidates and very many of them; entropy spans against a plain search."""

import math
import random
import re
import string
import time
from collections import Counter

from sigloom.llm import secrets

ANY = string.ascii_letters + string.digits + "+/"


def entropy(window):
    return math.log2(len(window)) - sum(n * math.log2(n) for n in Counter(window).values()) / len(window)


def plain(text):
    """All spans by Python's re, every window counted anew."""
    base = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, text) if len(m[2]) >= 6]
    base += [(m.start(), k, m.end()) for k, p in ((1, secrets.ACCESS), (2, secrets.HEX)) for m in re.finditer(p, text)]
    found = []
    for m in re.finditer(secrets.CANDIDATE, text):
        c = m[0]
        pieces = re.split(secrets.JOINS, c)
        worded = (sum(bool(re.search("[A-Za-z]{2}", p)) for p in pieces) > 1 or re.search("[a-z][A-Z]", c)) and all(re.search(secrets.PIECE, p) for p in pieces)
        if worded or any(re.search(p, c) for p in secrets.ALLOWED) or any(a < m.end() and m.start() < b for a, _, b in base):
            continue
        for pattern, size, least in secrets.CLASSES:
            if re.search(pattern, c):
                if any(entropy(c[k : k + size]) >= least for k in range(len(c) - size + 1)):
                    found.append((m.start(), 3, m.end()))
                break
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + found))


def texts():
    rng = random.Random(11)
    kinds = [string.hexdigits, "abcdef0123456789", string.ascii_uppercase + string.digits, string.ascii_letters, ANY + "_=-", "ab", "abcdefgh", string.ascii_lowercase + "-"]
    out = []
    for _ in range(150):
        words = []
        for _ in range(rng.randrange(1, 12)):
            letters = rng.choice(kinds)
            word = "".join(rng.choices(letters, k=rng.choice([5, 19, 20, 21, 23, 24, 40, 255, 256, 257, 300, 700])))
            words.append(rng.choice(["", "", "token=", "password: ", "AKIA", "x"]) + word)
        out.append(rng.choice([" ", "\n", "é "]).join(words))
    # little entropy at first, much only across a slice's edge
    out += ["a" * 250 + "kJ8x2Qm4Zp9Lr7Tn" + "a" * 250, "a" * 244 + "kJ8x2Qm4Zp9Lr7Tn3Vb6Wd1Y" + "a" * 300, "ab" * 5000]
    return out


def test_spans_against_a_plain_search(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r.spans for r in secrets.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [k for k, t in rows if got[k] != plain(t)] == []


def test_redacted_against_a_plain_cut(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        out, at = [], 0
        for s in filter(None, plain(t).split(",")):
            a, b = map(int, s.split(":")[1:])
            if a >= at:
                out += [t[at:a], "[SECRET]"]
            at = max(at, b)
        assert got[k] == "".join(out) + t[at:]


def test_long_and_many(spark):
    """A candidate of a million characters, quiet but for its end, and 10^5 candidates in one text: seconds, not hours."""
    rng = random.Random(2)
    quiet = "abcdefg" * 150_000 + "".join(rng.choices(ANY, k=40))
    many = " ".join("".join(rng.choices(ANY, k=24)) for _ in range(100_000))
    df = spark.createDataFrame([(0, quiet), (1, many)], "doc_id long, text string")
    began = time.monotonic()
    got = {r.doc_id: r for r in secrets.report(df).collect()}
    assert got[0].spans == f"entropy:0:{len(quiet)}"
    assert got[1].spans.count("entropy:") > 99_000
    masked = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert masked[0] == "[SECRET]" and masked[1].count("[SECRET]") == got[1].spans.count("entropy:")
    assert time.monotonic() - began < 120
