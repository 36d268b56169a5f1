"""Secret scans: base patterns, and sliding-window Shannon entropy per character class; DataFrame functions only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import text_or_empty


def _either(word: str) -> str:
    """A pattern for word whose ASCII letters stand in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The base patterns, by kind.
ASSIGN = "(" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
#: A span, its places in code points.
SPAN = "struct<start:int,kind:int,end:int>"
#: Items of a block of a scan; characters of a slice of a candidate or of a text; characters of a window at most.
BLOCK, SLICE, MOST_WINDOW = 256, 64, 24
#: Strings that entropy is taken of.
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
#: Character classes, narrowest first: pattern, window in characters, least entropy in bits a character. No window is longer than its candidates.
CLASSES = (("^[0-9A-Fa-f]+$", 20, 2.9), ("^[0-9A-Z]+$", 20, 3.3), ("^[0-9A-Za-z]+$", 20, 3.5), ("^[0-9A-Za-z+/_=-]{20,23}$", 20, 3.5), ("^[0-9A-Za-z+/_=-]+$", 24, 3.7))
#: Candidates that are no secrets: UUIDs, dates and times, documentation examples, counting runs, numbers. Words joined are told by _worded.
ALLOWED = (
    "^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    "^[0-9]{4}-[0-9]{2}-[0-9]{2}([T_-][0-9-]+)?$",
    "(?i)example|sample|dummy|placeholder|changeme|xxxx",
    "0123456789|12345678|abcdefgh|ABCDEFGH",
    "^[0-9=_+-]+$",
)
#: What joins the words of paths and identifiers.
JOINS = "[/_=+-]+"


def _word(first: str, rest: str) -> str:
    """A pattern for pronounceable words of at most 15 letters: consonants and vowels in turn, first and rest giving the case of their letters."""
    vowel, other = "aeiouy", "bcdfghjklmnpqrstvwxz"
    v1, c1 = (f"[{''.join(f(x) for f in ({'l': [str.lower], 'u': [str.upper], 'lu': [str.lower, str.upper]}[first]))}]" for x in (vowel, other))
    v, c = (f"[{getattr(x, {'l': 'lower', 'u': 'upper'}[rest])()}]" for x in (vowel, other))
    letters = "[a-z]" if rest == "l" else "[A-Z]"
    return f"(?:(?![A-Za-z]{letters}{{15}})(?:{c1}{c}{{0,2}}{v}{{1,3}}|{v1}{v}{{0,2}})(?:{c}{{1,4}}{v}{{1,3}}){{0,7}}{c}{{0,4}})"


#: A piece between joins: nothing, a number, a few letters, or words in capitals, in small letters or in camel case, with at most two digits.
PIECE = f"^(?:|[0-9]{{1,4}}|(?:[a-z]{{1,3}}|[A-Z]{{1,3}})[0-9]{{0,2}}|(?:{_word('u', 'u')}|{_word('lu', 'l')}(?:{_word('u', 'l')}){{0,12}})[0-9]{{0,2}})$"


def _scan(n: Column, state: dict[str, Column], step, item: str) -> Column:
    """An array of what step(state, k) emits for k in 0 .. n - 1; step gives the next state, whether it emits, and what.

    In blocks whose arrays are joined once at the end: an array that grows with each of n items would be copied n times.
    """
    none = F.expr(f"cast(array() as array<{item}>)")
    named = lambda s: [v.alias(k) for k, v in s.items()]

    def within(acc: Column, k: Column) -> Column:
        after, emits, out = step({x: acc[x] for x in state}, k)
        return F.struct(*named(after), F.when(emits, F.concat(acc["out"], F.array(out))).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, first: Column) -> Column:
        begin = F.struct(*[acc[x].alias(x) for x in state], none.alias("out"))
        join = lambda a: F.struct(*[a[x].alias(x) for x in state], F.concat(acc["outs"], F.array(a["out"])).alias("outs"))
        return F.aggregate(F.sequence(first, F.least(first + BLOCK, n) - 1), begin, within, join)

    begin = F.struct(*named(state), F.expr(f"cast(array() as array<array<{item}>>)").alias("outs"))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1, F.lit(BLOCK)), begin, block, lambda a: F.flatten(a["outs"]))).otherwise(none)


def _spans(matches: Column, between: Column, kind: int, wanted) -> Column:
    """Spans (start, kind, end) of the matches that wanted(index) keeps; between are the lengths of the pieces around matches, which give the places."""

    def step(s: dict, k: Column) -> tuple[dict, Column, Column]:
        start = s["at"] + F.get(between, k)
        end = start + F.length(F.get(matches, k))
        return {"at": end}, wanted(k), F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))

    # both columns are named several times, so that the optimizer leaves them as columns, made once
    return _scan(F.least(F.size(matches), F.size(between) - 1), {"at": F.lit(0)}, step, SPAN)


def _apart(every: Column) -> Column:
    """Of spans by start, those found by entropy (disjoint ones) that meet no other, in one pass: the last one found waits for what follows it."""
    span = lambda start, end: F.struct(start.alias("start"), F.lit(len(KINDS) - 1).alias("kind"), end.alias("end"))

    def step(s: dict, k: Column) -> tuple[dict, Column, Column]:
        x = F.get(every, k)
        ours = x["kind"] == len(KINDS) - 1
        after = {
            "reach": F.when(ours, s["reach"]).otherwise(F.greatest(s["reach"], x["end"])),
            "start": F.when(ours, x["start"]).otherwise(s["start"]),
            "end": F.when(ours, x["end"]).otherwise(s["end"]),
            "free": F.when(ours, s["reach"] <= x["start"]).otherwise(s["free"] & (x["start"] >= s["end"])),
        }
        return after, F.coalesce(ours, F.lit(True)) & s["free"], span(s["start"], s["end"])

    # one step beyond the last span lets the one that waits out
    begin = {"reach": F.lit(0), "start": F.lit(0), "end": F.lit(0), "free": F.lit(False)}
    return _scan(F.when(F.size(every) > 0, F.size(every) + 1).otherwise(0), begin, step, SPAN)


def window_entropy(c: Column, window: int | Column) -> Column:
    """The largest Shannon entropy of any window of that many characters (MOST_WINDOW at most) of a candidate, by incremental counts; 0 for a shorter one.

    The state holds the count of each possible character in the window, as the characters of a string, and the sum of n * log2(n) over these
    counts n, in whole units of 2^-48, so that no rounding gathers. A step takes the oldest character's count down by one and
    the next one's up. A step costs the place in c, so long strings are cut into slices first (_reaches).
    """
    window = F.lit(window) if isinstance(window, int) else window
    weigh = F.array(*[F.lit(round(n * math.log2(n) * 2**48) if n else 0).cast("bigint") for n in range(MOST_WINDOW + 2)])
    weight = lambda n: F.get(weigh, n)
    place = lambda x: F.ascii(x) - (ord("+") - 1)
    count = lambda counts, x: F.ascii(F.substring(counts, place(x), F.lit(1))) - ord("0")
    told = lambda counts, x, n: F.overlay(counts, F.chr(n + ord("0")), place(x), F.lit(1))

    def step(a: Column, i: Column) -> Column:
        counts, new, old = a["counts"], F.substring(c, i, F.lit(1)), F.substring(c, i - window, F.lit(1))
        n, m = count(counts, new), count(counts, old)
        more = told(counts, new, n + 1)
        gain = weight(n + 1) - weight(n)
        moved = F.when(i <= window, F.struct(more.alias("counts"), (a["sum"] + gain).alias("sum")))
        moved = moved.when(new == old, F.struct(counts.alias("counts"), a["sum"].alias("sum")))
        moved = moved.otherwise(F.struct(told(more, old, m - 1).alias("counts"), (a["sum"] + gain + weight(m - 1) - weight(m)).alias("sum")))
        least = lambda x: F.struct(x["counts"].alias("counts"), x["sum"].alias("sum"), F.when(i >= window, F.least(a["least"], x["sum"])).otherwise(a["least"]).alias("least"))
        return F.get(F.transform(F.array(moved), least), F.lit(0))

    begin = F.struct(F.lit("0" * (ord("z") - ord("+") + 1)).alias("counts"), F.lit(0).cast("bigint").alias("sum"), F.lit(1 << 62).cast("bigint").alias("least"))
    bits = lambda a: F.log2(window.cast("double")) - a["least"] / (F.lit(2.0**48) * window)
    return F.when(F.length(c) >= window, F.aggregate(F.sequence(F.lit(1), F.length(c)), begin, step, bits)).otherwise(F.lit(0.0))


def _reaches(c: Column, window: Column, least: Column) -> Column:
    """Whether a window of c has that much entropy: slices that overlap by a window less one, until one of them has."""
    pieces = F.array(F.regexp_extract_all(c, F.lit(f".{{1,{SLICE}}}"), F.lit(0)))
    joined = lambda ps: F.transform(ps, lambda p, k: F.concat(F.when(k > 0, F.right(F.get(ps, k - 1), window - 1)).otherwise(F.lit("")), p))
    return F.exists(F.flatten(F.transform(pieces, joined)), lambda x: window_entropy(x, window) >= least)


def _worded(c: Column) -> Column:
    """Whether a candidate is a path or an identifier made of two words or more. One long run of letters is none, so entropy decides on it."""
    pieces = F.split(c, JOINS, -1)
    several = (F.size(F.filter(pieces, lambda p: p.rlike("[A-Za-z]{2}"))) > 1) | c.rlike("[a-z][A-Z]")
    return several & F.forall(pieces, lambda p: p.rlike(PIECE))


def _secret_looking(c: Column) -> Column:
    allowed = reduce(lambda a, b: a | b, [c.rlike(p) for p in ALLOWED]) | _worded(c)
    which = F.when(allowed, F.lit(None).cast("int"))
    for k, (pattern, _, _) in enumerate(CLASSES):
        which = which.when(c.rlike(pattern), F.lit(k))
    windows, leasts = F.array(*[F.lit(w) for _, w, _ in CLASSES]), F.array(*[F.lit(x) for _, _, x in CLASSES])
    return F.exists(F.array(which), lambda k: k.isNotNull() & _reaches(c, F.get(windows, k), F.get(leasts, k)))


def _scanned(df: DataFrame, text_col: str) -> DataFrame:
    """row (all columns of df, whatever their names, in one struct), text, base and spans."""
    t = F.col("text")
    out = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), text_or_empty(text_col).alias("text"))
    found = {"a": (ASSIGN, 0), "v": (ASSIGN, 2), "k": (ACCESS, 0), "h": (HEX, 0), "c": (CANDIDATE, 0)}
    pieces = {f"{n}_gaps": F.transform(F.split(t, p, -1), F.length) for n, p in (("a", ASSIGN), ("k", ACCESS), ("h", HEX), ("c", CANDIDATE))}
    out = out.select("row", "text", *[F.regexp_extract_all(t, F.lit(p), F.lit(g)).alias(name) for name, (p, g) in found.items()])
    out = out.select("*", *[F.when(F.size(n[0]) > 0, x).otherwise(F.array(F.length(t))).alias(n) for n, x in pieces.items()])
    always = lambda i: F.lit(True)
    assign = _spans(F.col("a"), F.col("a_gaps"), 0, lambda i: F.length(F.get(F.col("v"), i)) >= 6)
    access = _spans(F.col("k"), F.col("k_gaps"), 1, always)
    hexes = _spans(F.col("h"), F.col("h_gaps"), 2, always)
    entropy = _spans(F.col("c"), F.col("c_gaps"), 3, lambda i: _secret_looking(F.get(F.col("c"), i)))
    out = out.select("row", "text", F.array_sort(F.concat(assign, access, hexes)).alias("base"), entropy.alias("e"))
    out = out.select("row", "text", "base", "e", F.array_sort(F.concat("base", "e")).alias("every"))
    alone = F.when(F.size("base") == 0, F.col("e")).when(F.size("e") == 0, F.col("e")).otherwise(_apart(F.col("every")))
    out = out.select("row", "text", "base", alone.alias("alone"))
    return out.select("row", "text", "base", F.array_sort(F.concat("base", "alone")).alias("spans"))


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with base and spans: arrays of (start, kind, end) by start, then kind; places in code points, end exclusive.

    A null or empty text has none. An entropy span is added where it meets no base span. A narrow transformation;
    other columns pass, but a column of df called base or spans is an error. Texts without a candidate cost one search for each pattern.
    """
    if clash := {"base", "spans"} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} would clash")
    return _scanned(df, text_col).select(*[F.col("row")[c].alias(c) for c in df.columns], "base", "spans")


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of each document's spans, one row a row; other columns than id and text are not read. Texts and candidates of
    any length are read whole, in time in proportion to them."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")
    return scan(df.select(id_col, text_col), text_col).select(id_col, n(0), n(1), n(2), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with each span, or run of overlapping spans, of the text replaced by mark; all other columns as they are, whatever their names.

    Texts without spans, null ones too, stay as they are; so do repeated rows and an empty table. The pieces between spans are cut
    out by their places, of blocks of the text, and joined once; time is in proportion to the text and its spans.
    """
    text, blocks = F.col("text"), F.col("blocks")

    def step(s: dict, k: Column) -> tuple[dict, Column, Column]:
        x = F.get("spans", k)
        piece = F.struct(s["at"].alias("from"), x["start"].alias("to"))
        return {"at": F.greatest(s["at"], x["end"])}, x["start"] >= s["at"], piece

    def cut(low: Column, high: Column) -> Column:
        """The text from low to high: of the blocks that hold it, each read from its own start."""
        part = lambda b: F.substring(F.get(blocks, b), F.greatest(low - b * SLICE, F.lit(0)) + 1, F.least(high - b * SLICE, F.lit(SLICE)) - F.greatest(low - b * SLICE, F.lit(0)))
        number = lambda x: F.floor(x / SLICE).cast("int")
        return F.when(high > low, F.array_join(F.transform(F.sequence(number(low), number(high - 1)), part), "")).otherwise(F.lit(""))

    before = F.transform(_scan(F.size("spans"), {"at": F.lit(0)}, step, "struct<from:int,to:int>"), lambda p: cut(p["from"], p["to"]))
    after = cut(F.array_max(F.transform("spans", lambda x: x["end"])), F.length(text))
    masked = F.when(F.size("spans") > 0, F.array_join(F.concat(before, F.array(after)), mark)).otherwise(F.col("row")[text_col])
    sliced = F.when(F.size("spans") > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SLICE}}}"), F.lit(0)))
    scanned = _scanned(df, text_col).select("row", "text", "spans", sliced.alias("blocks"))
    return scanned.select(*[(masked if c == text_col else F.col("row")[c]).alias(c) for c in df.columns])
