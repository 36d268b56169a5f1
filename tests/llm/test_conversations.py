"""Repair of conversations against a search over all edits, whole and in segments cut at every turn."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from sigloom.llm import conversations as m

SCHEMA = "conv_id long, turn long, role string, text string, conv string, seg int"
BLANK = "[\x20\x09-\x0d]"


def cheapest(turns):
    """Least (cost, audit) by a search over (turns done, roles so far as a state), written apart from the library."""
    ok = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, last, out = heapq.heappop(heap)
        if (k, last) in done:
            continue
        if k == len(turns) and last in ("", "a"):
            return cost, audit, out
        done.add((k, last))
        role = {"u": "user", "a": "assistant"}
        for x in ok[last]:
            if x in role:
                heapq.heappush(heap, (cost + 2, audit + "I", k, x, (*out, role[x] + ":")))
        if k < len(turns):
            r, text, fault = turns[k]
            heapq.heappush(heap, (cost + 3, audit + "D", k + 1, last, out))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if r[:1] and r[:1] in ok[last]:
                    heapq.heappush(heap, (cost + more, audit + "K", k + 1, r[0], (*out, f"{r}:{text}")))
                for x in ok[last]:
                    if x in role:
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", k + 1, x, (*out, f"{role[x]}:{text}")))


def brute(rows):
    convs = {}
    for conv, turn, role, text, *_ in rows:
        held = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        held += [(turn, "user" if how == 4 else role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    out = []
    for conv, held in convs.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, turns = set(), []
        for _, role, text in held:
            trimmed = re.sub(BLANK + r"+\Z", "", text)
            fault = "blank" if not trimmed else "duplicate" if (role, text) in seen else "truncated" if trimmed[-1] not in ".!?" else ""
            seen.add((role, text))
            turns.append((role, text, fault))
        numbers = [t for t, _, _ in held if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit, lines = cheapest(turns)
        n = [sum(f == x for _, _, f in turns) for x in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = ["Good morning.", "What now?", "no end", "", " \n", None, "Yes!", "a. b", "x" * 3000, "ünï…", "Ends here.  \n", " "]
    roles = ["user", "assistant", "system", "tool", None, "", "User"]
    out = []
    for conv in range(150):
        turns = rng.sample(range(40), rng.randint(1, 12))
        for t in turns:
            out.append((conv, t, rng.choices(roles, [8, 8, 3, 1, 1, 1, 1])[0], rng.choice(texts) if rng.random() < 0.6 else f"Turn {t} of {conv}."))
    out += [(7, None, "user", "No number."), (7, None, "assistant", "None either."), (None, 1, "user", "Whose?"), (None, 2, "assistant", "Nobody's."), (None, None, None, None)]
    out += [out[3], out[3], out[40]]
    # a hot conversation, with one text that fills half of it
    out += [(1000, t, rng.choice(roles[:3]), "The same again." if t % 2 else f"Line {t}.") for t in range(700)]
    rng.shuffle(out)
    return [(*r, "c", 1) for r in out]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_report(spark, rows):
    assert got(m.report(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_segments_compose(spark, rows, monkeypatch):
    """Segments of three turns, and partitions cut anywhere: the same rows."""
    monkeypatch.setattr(m, "SEGMENT", 3)
    fixed = m.Repair(m.damaged(spark.createDataFrame(rows, SCHEMA)))
    assert fixed.segments.where("size(turns) > 3").count() == 0
    assert got(m.report(spark.createDataFrame(rows, SCHEMA).repartition(7))) == brute(rows)


def test_repaired_turns(spark, rows):
    fixed = m.Repair(m.damaged(spark.createDataFrame(rows, SCHEMA)))
    lines = {}
    for r in sorted(fixed.turns().collect(), key=lambda r: (r["seg"], r["place"])):
        lines.setdefault(r["conv"], []).append(f"{r['role']}:{r['text']}")
        assert r["edit"] in "KRI"
    want = {r[0]: r[-1] for r in brute(rows)}
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in lines.items()}.items() <= want.items()
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in v)) for v in lines.values())


def test_long_conversation_is_split(spark):
    """One conversation of 30,000 turns lies in many segments, and in several tasks."""
    rows = [(1, t, "user" if t % 3 else "assistant", f"Words {t % 5000}.", "c", 1) for t in range(30_000)]
    fixed = m.Repair(m.damaged(spark.createDataFrame(rows, SCHEMA)))
    segs = fixed.segments.select("seg").collect()
    assert len({r["seg"] >> 33 for r in segs}) > 3 and len(segs) >= 30_000 // m.SEGMENT
    assert got(m.report(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_empty(spark):
    assert m.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_all_dropped(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    want = [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert got(m.report(spark.createDataFrame([(gone, 0, "user", "Hi.", "c", 1)], SCHEMA))) == want


def test_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert got(m.report(rows)) == brute([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])
