"""Repair of conversations' structure: a forward Viterbi over four states of the grammar (s?(ua)+)?.

States are what the roles so far allow: nothing yet, after a system turn, after a user turn, after an assistant turn. Each carries the least
(cost, audit string); a turn moves them by its edits, and its layer is closed by at most two inserts. From every state an inserted or
re-roled turn has one role only, so an audit string says all of a repair.

Turns are dealt by ranges of (conversation, turn, role, text), so a long conversation lies in several tasks, in segments of bounded size. A segment
that may go on from another is solved from each of the four states, and the few costs and strings of a conversation's segments are then
composed in order. Of two ways to one state through the same turns, neither audit string begins with the other at equal cost (more
inserts cost more), so the less one stays the less whatever follows, and segments compose exactly.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import SPACE, keep, partitions

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that an inserted or re-roled turn leads to, and that a kept turn with such an initial does.
FORWARD = (USER, USER, ASSISTANT, USER)
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ROLE = {USER: "user", ASSISTANT: "assistant"}
ENDS = (START, ASSISTANT)
#: Costs of a re-role, a delete, an insert, and of a truncated turn that stays.
REROLE, DELETE, INSERT, STAYS = 2, 3, 2, 1
#: Turns and characters of a segment at most (one longer turn is a segment of its own).
SEGMENT, CHARS = 256, 1 << 16
#: Characters of a text by which ranges are told apart.
PREFIX = 64
LEGAL = ("su", "ua", "au")
Layer = dict[int, tuple[int, str]]


def better(layer: Layer, state: int, cost: int, path: str) -> None:
    if state not in layer or (cost, path) < layer[state]:
        layer[state] = (cost, path)


def closed(layer: Layer) -> Layer:
    """The layer with inserts: from any state two lead to all that inserts can reach; a third would come back."""
    for _ in range(2):
        for state, (cost, path) in list(layer.items()):
            better(layer, FORWARD[state], cost + INSERT, path + "I")
    return layer


def step(layer: Layer, initial: str, fault: str | None) -> Layer:
    """The layer after one more turn."""
    out: Layer = {}
    stays = STAYS if fault == "t" else 0
    for state, (cost, path) in layer.items():
        better(out, state, cost + DELETE, path + "D")
        if fault not in ("b", "d"):
            if (to := KEPT.get(initial, {}).get(state)) is not None:
                better(out, to, cost + stays, path + "K")
            better(out, FORWARD[state], cost + REROLE + stays, path + "R")
    return closed(out)


def solve(turns: list[tuple[str, str | None]], layer: Layer) -> Layer:
    """The layer after turns (initial, fault). What all ways share is set aside, so that long conversations stay cheap."""
    shared: list[str] = []
    for k, (initial, fault) in enumerate(turns, 1):
        layer = step(layer, initial, fault)
        if k % 64 == 0:
            layer, same = _apart(layer)
            shared.append(same)
    before = "".join(shared)
    return {s: (c, before + p) for s, (c, p) in layer.items()}


def _apart(layer: Layer) -> tuple[Layer, str]:
    same = os.path.commonprefix([p for _, p in layer.values()])
    return {s: (c, p[len(same) :]) for s, (c, p) in layer.items()}, same


def repaired(turns: list[tuple[str, str]], piece: str, state: int) -> tuple[list[tuple[str, str, str]], int]:
    """(edit, role, text) of what a piece of audit makes of turns (role, text), and the state after it."""
    out, at = [], 0
    for edit in piece:
        role, text = ("", "") if edit == "I" else turns[at]
        at += edit != "I"
        if edit == "K":
            state = KEPT[role[:1]][state]
        elif edit in "RI":
            state = FORWARD[state]
            role = ROLE[state]
        if edit != "D":
            out.append((edit, role, text))
    return out, state


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) of the rows that a fixed damage leaves: by crc32('conv:turn') % 20 it drops a row (0), empties its text (1), takes out
    its sentence ends (2), repeats it (3) or makes its role user (4). Nulls are one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(part(conv), F.lit(":"), part(turn)).cast("binary")) % 20
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), part(role).alias("role"), part(text).alias("text"), how.alias("how")).where("how != 0")
    rows = rows.withColumn("copy", F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    said = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"))


def _fault(text: Column) -> Column:
    """b for a blank text, t for one that does not end a sentence."""
    trimmed = F.regexp_replace(text, SPACE + r"+\z", "")
    return F.when(trimmed == "", "b").when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "t")


_PACKED = "conv {kind}, seg long, whole boolean, goes_on boolean, turns array<bigint>, roles array<string>, faults array<string>, marks array<binary>, texts array<string>"


def _packer(most: int, chars_most: int):
    """Segments of sorted rows (conv, turn, role, text, fault). whole: all of its conversation; goes_on: another segment may come before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        schema: list[pa.Schema] = []
        part: list[tuple] = []
        held: list[tuple] = []
        chars, cuts, seen, conv, begun, first = 0, 0, set(), None, False, True

        def cut(last: bool, end: bool) -> None:
            nonlocal part, chars, cuts, number
            goes_on = first or cuts > 0
            whole = last and not goes_on and not end
            turns, roles, texts, faults, marks = zip(*part, strict=True)
            held.append((conv, number, whole, goes_on, turns, roles, faults, None if whole else marks, texts))
            number, cuts, chars, part = number + 1, cuts + 1, 0, []

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], f.type) for k, f in enumerate(schema[0])], schema=schema[0])
            held.clear()
            return got

        for b in batches:
            if not schema:
                lists = [(n, pa.list_(t)) for n, t in (("turns", pa.int64()), ("roles", pa.string()), ("faults", pa.string()), ("marks", pa.binary()), ("texts", pa.string()))]
                schema.append(pa.schema([("conv", b.schema.field(0).type), ("seg", pa.int64()), ("whole", pa.bool_()), ("goes_on", pa.bool_()), *lists]))
            waiting = 0
            for key, turn, role, text, fault in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if begun and key != conv:
                    cut(True, False)
                    first, cuts, seen = False, 0, set()
                elif len(part) >= most or chars and chars + len(text) > chars_most:
                    cut(False, False)
                conv, begun = key, True
                mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
                if fault != "b":
                    fault = "d" if mark in seen else fault
                    seen.add(mark)
                # only a turn that none of this run repeats can be repeated by an earlier task's
                part.append((turn, role, text, fault, None if fault in ("b", "d") else mark))
                chars += len(text)
                waiting += len(text)
                if waiting > chars_most and held:
                    yield out()
                    waiting = 0
            if held:
                yield out()
        if part:
            cut(True, True)
            yield out()

    return run


def segments(turns: DataFrame) -> DataFrame:
    """Turns (conv, turn, role, text) by conversation, turn (nulls first), role and text, packed into numbered segments, with faults known within a task."""
    spark = turns.sparkSession
    key = ["conv", "turn", "role", F.substring("text", 1, PREFIX)]
    dealt = turns.select("conv", "turn", "role", "text", _fault(F.col("text")).alias("fault")).repartitionByRange(partitions(spark), *key).sortWithinPartitions("conv", "turn", "role", "text")
    return dealt.mapInArrow(_packer(SEGMENT, CHARS), _PACKED.format(kind=dict(turns.dtypes)["conv"]))


def late_duplicates(segs: DataFrame) -> DataFrame:
    """(seg, late): places of turns that repeat one of an earlier segment in another task. Only conversations of several segments are looked at; a
    role and text counts once a task and conversation, so a hot one is as many rows as tasks hold its conversation."""
    marks = segs.where(~F.col("whole")).select("conv", "seg", F.posexplode("marks").alias("place", "mark")).where("mark is not null")
    first = marks.groupBy("conv", "mark").agg(F.min("seg").alias("seg"), F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("seg", "place")).alias("at")).where("n > 1")
    late = first.select(F.col("seg").alias("first"), F.explode("at").alias("a")).where("a.seg > first")
    return late.groupBy("a.seg").agg(F.collect_list("a.place").alias("late"))


_SOLVED = "conv {kind}, seg long, whole boolean, first_turn long, last_turn long, n_turns long, first_role string, last_role string, blank long, duplicate long, truncated long, illegal long, froms array<int>, tos array<int>, costs array<bigint>, paths array<string>, n int"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and ways of each segment, of rows (conv, seg, whole, goes_on, turns, roles, faults, late)."""
    lists = [pa.list_(t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.string())]
    for b in batches:
        kinds = [b.schema.field(0).type, pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.string()] * 2, *[pa.int64()] * 4, *lists, pa.int32()]
        rows = []
        for conv, seg, whole, goes_on, turns, roles, faults, late in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for k in late or ():
                faults[k] = "d"
            initials = [r[:1] for r in roles]
            known = [t for t in turns if t is not None]
            legal = sum(x + y not in LEGAL for x, y in zip(initials, initials[1:], strict=False))
            ways = []
            # unknown what comes before: from every state; else from the start, with what is inserted before the first turn
            for state in range(4) if goes_on else (-1,):
                begin = closed({START: (0, "")}) if state < 0 else {state: (0, "")}
                ways += [(state, to, cost, path) for to, (cost, path) in solve(list(zip(initials, faults, strict=True)), begin).items()]
            counts = [faults.count(f) for f in "bdt"]
            rows.append((conv, seg, whole, min(known, default=None), max(known, default=None), len(set(known)), initials[0], initials[-1], *counts, legal, *map(list, zip(*ways, strict=True)), len(turns)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [x.split()[0] for x in _SOLVED.split(", ")])


_REPAIR = "conv {kind}, seg long, state int, piece string, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each segment the state that it begins in and its piece of audit; with the last one of a conversation, what holds for all of it."""
    kind: list[pa.DataType] = []
    conv, begun = None, False
    layer: Layer = {}
    shared: list[str] = []
    segs: list[tuple[int, int]] = []
    totals = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
    low, high, role = None, None, None
    rows: list[tuple] = []

    def end() -> None:
        cost, path = min(layer[s] for s in ENDS if s in layer)
        audit = "".join(shared) + path
        gaps = 0 if low is None else high - low + 1 - totals["turns"]
        state, at = START, 0
        for k, (seg, n) in enumerate(segs):
            piece, at = _piece(audit, at, n, k == 0)
            last = k == len(segs) - 1
            whole = (gaps if gaps < 1 << 63 else None, *(totals[x] for x in ("blank", "duplicate", "truncated", "illegal")), cost, audit) if last else (None,) * 7
            rows.append((conv, seg, state, piece, last, *whole))
            if not last:
                state = seg_state(seg, piece, state)

    def seg_state(seg: int, piece: str, state: int) -> int:
        turns = iter(initials[seg])
        for edit in piece:
            initial = "" if edit == "I" else next(turns)
            state = KEPT[initial][state] if edit == "K" else state if edit == "D" else FORWARD[state]
        return state

    initials: dict[int, list[str]] = {}

    def out() -> pa.RecordBatch:
        kinds = [kind[0], pa.int64(), pa.int32(), pa.string(), pa.bool_(), *[pa.int64()] * 6, pa.string()]
        got = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [x.split()[0] for x in _REPAIR.split(", ")])
        rows.clear()
        return got

    for b in batches:
        kind[:] = [b.schema.field(0).type]
        for r in b.to_pylist():
            if begun and r["conv"] != conv:
                end()
            if not begun or r["conv"] != conv:
                conv, begun, layer, shared, segs, initials = r["conv"], True, closed({START: (0, "")}), [], [], {}
                totals = dict.fromkeys(totals, 0)
                low = high = role = None
            new: Layer = {}
            for f, t, c, p in zip(r["froms"], r["tos"], r["costs"], r["paths"], strict=True):
                if f < 0:
                    better(new, t, c, p)
                elif f in layer:
                    better(new, t, layer[f][0] + c, layer[f][1] + p)
            layer, same = _apart(new)
            shared.append(same)
            segs.append((r["seg"], r["n"]))
            if not r["whole"]:
                initials[r["seg"]] = r["initials"]
            for x in ("blank", "duplicate", "truncated", "illegal"):
                totals[x] += r[x]
            totals["illegal"] += role is not None and role + r["first_role"] not in LEGAL
            role = r["last_role"]
            if r["first_turn"] is not None:
                # turns come in order, so a segment shares at most its first one with those before it
                totals["turns"] += r["n_turns"] - (high is not None and high == r["first_turn"])
                low, high = r["first_turn"] if low is None else low, r["last_turn"]
        if rows:
            yield out()
    if begun:
        end()
        yield out()


def _piece(audit: str, at: int, n: int, first: bool) -> tuple[str, int]:
    """The part of audit for n turns from at on, with the inserts after them, and before them in a conversation's first segment."""
    start = at
    while first and at < len(audit) and audit[at] == "I":
        at += 1
    while n and at < len(audit):
        n -= audit[at] != "I"
        at += 1
    while at < len(audit) and audit[at] == "I":
        at += 1
    return audit[start:at], at


class Repair:
    """A repair of turns (conv, turn, role, text): segments with their texts, and what becomes of each."""

    def __init__(self, turns: DataFrame):
        spark, kind = turns.sparkSession, dict(turns.dtypes)["conv"]
        self.segments, _ = keep(spark, segments(turns), "segments")
        narrow = self.segments.drop("texts", "marks").join(late_duplicates(self.segments), "seg", "left")
        narrow = narrow.select("conv", "seg", "whole", "goes_on", "turns", "roles", "faults", "late")
        solved, _ = keep(spark, narrow.mapInArrow(_solve, _SOLVED.format(kind=kind)), "solved")
        initials = self.segments.where(~F.col("whole")).select("seg", F.transform("roles", lambda r: F.left(r, F.lit(1))).alias("initials"))
        ordered = solved.join(initials, "seg", "left").repartition(partitions(spark), "conv").sortWithinPartitions("conv", "seg")
        self.pieces, _ = keep(spark, ordered.mapInArrow(_compose, _REPAIR.format(kind=kind)), "pieces")

    def conversations(self) -> DataFrame:
        """conv, gaps, blank, duplicate, truncated, illegal, cost, audit."""
        return self.pieces.where("last").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def turns(self) -> DataFrame:
        """The repaired turns: conv, seg and place (in order), edit (K, R or I), role, text."""
        both = self.segments.select("seg", "conv", "roles", "texts").join(self.pieces.select("seg", "state", "piece"), "seg")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for n, (seg, roles, texts, state, piece) in enumerate(zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4, 5)), strict=True)):
                    rows, _ = repaired(list(zip(roles, texts, strict=True)), piece, state)
                    if rows:
                        key = [pa.array([b.column(1)[n].as_py()] * len(rows), b.schema.field(1).type), pa.array([seg] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int32())]
                        yield pa.RecordBatch.from_arrays([*key, *(pa.array(x, pa.string()) for x in zip(*rows, strict=True))], ["conv", "seg", "place", "edit", "role", "text"])

        return both.mapInArrow(run, f"conv {dict(both.dtypes)['conv']}, seg long, place int, edit string, role string, text string")

    def digests(self) -> DataFrame:
        """conv, repaired_sha256: of the repaired turns as role:text, joined by newlines. A hash of one conversation is one chain, so its segments are
        streamed through one task, one at a time."""
        spark, kind = self.segments.sparkSession, dict(self.segments.dtypes)["conv"]
        none = F.lit(None)
        texts = self.segments.select("conv", "seg", F.lit(1).alias("k"), none.cast("int").alias("state"), none.cast("string").alias("piece"), "roles", "texts")
        made = self.pieces.select("conv", "seg", F.lit(0).alias("k"), "state", "piece", none.cast("array<string>").alias("roles"), none.cast("array<string>").alias("texts"))
        both = made.unionAll(texts).repartition(partitions(spark), "conv").sortWithinPartitions("conv", "seg", "k")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, begun, chain, some, state, piece, type_ = None, False, None, False, 0, "", None
            for b in batches:
                done, type_ = [], b.schema.field(0).type
                for conv, k, s, p, roles, texts in zip(*(b.column(c).to_pylist() for c in (0, 2, 3, 4, 5, 6)), strict=True):
                    if begun and conv != now:
                        done.append((now, chain.hexdigest()))
                    if not begun or conv != now:
                        now, begun, chain, some = conv, True, hashlib.sha256(), False
                    if k == 0:
                        state, piece = s, p
                        continue
                    for _, role, text in repaired(list(zip(roles, texts, strict=True)), piece, state)[0]:
                        chain.update((f"\n{role}:{text}" if some else f"{role}:{text}").encode())
                        some = True
                if done:
                    yield _pairs(done, type_)
            if begun:
                yield _pairs([(now, chain.hexdigest())], type_)

        return both.mapInArrow(run, f"conv {kind}, repaired_sha256 string")


def _pairs(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string())], ["conv", "repaired_sha256"])


def report(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation of df: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, after the fixed damage.

    Null roles and texts are one space, a null conversation is one of its own; null turns come first and count for no gap; turns of one number go by role
    and text, repeated rows follow each other. A conversation without rows after the damage has zeros, an empty audit and the empty string's hash. gaps is
    null where turns lie over 2^63 apart. Other columns are not read. An empty table gives no rows.
    """
    fixed = Repair(damaged(df, conv, turn, role, text))
    every = df.select(F.col(conv).alias("_conv")).distinct()
    a, b = fixed.conversations(), fixed.digests().withColumnRenamed("conv", "_of")
    both = a.join(b, a["conv"].eqNullSafe(b["_of"]))
    out = every.join(both, every["_conv"].eqNullSafe(both["conv"]), "left")
    none, counts = F.col("audit").isNull(), ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("_conv").alias(conv), *[F.when(none, F.lit(0).cast("long")).otherwise(F.col(c)).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def _oracle() -> str:
    """The same rows in SQL: a state's (cost, audit) is one string, nine digits of cost first, so that the least string is the least pair."""

    def add(state: str, cost: str, edit: str) -> str:
        return f"lpad(cast(cast(left({state}, 9) as integer) + {cost} as varchar), 9, '0') || substr({state}, 10) || '{edit}'"

    move = lambda edit, cost, initial, *states: ", ".join(f"case when stays{f' and initial = {initial!r}' if initial else ''} then {add(s, cost, edit)} end" for s in states)
    forward = lambda *states: ", ".join(add(s, str(INSERT), "I") for s in states)
    kept, anew = "late", f"{REROLE} + late"
    return rf"""
with recursive d as (
    select conv_id as conv, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        list_reduce([4294967295] || flatten(list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1])),
            lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end) as crc
    from conversations
), h as (select *, xor(crc, 4294967295) % 20 as how from d),
r as (
    select conv, turn, case when how = 4 then 'user' else role end as role, case how when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
    from h, (select unnest([0, 1]) as copy) where how <> 0 and (copy = 0 or how = 3)
), o as (select *, left(role, 1) as initial, row_number() over (partition by conv order by turn nulls first, role, text) as k, regexp_replace(text, '[\x20\x09-\x0D]+$', '') as said from r),
f as (
    select *, case when said = '' then 'b' when row_number() over (partition by conv, role, text order by k) > 1 then 'd' when right(said, 1) not in ('.', '!', '?') then 't' else '' end as fault,
        lag(initial) over (partition by conv order by k) || initial as pair from o
), g as (select *, fault not in ('b', 'd') as stays, case when fault = 't' then {STAYS} else 0 end as late from f),
total as (
    select conv, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'b') as blank, count(*) filter (where fault = 'd') as duplicate,
        count(*) filter (where fault = 't') as truncated, count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal from g group by conv
), v as (
    select conv, cast(0 as bigint) as k, '000000000' as s0, cast(null as varchar) as s1, '00000000{INSERT}I' as s2, '00000000{2 * INSERT}II' as s3 from total
    union all
    select conv, k, n0, n1, least(m2, {forward("m3")}), least(m3, {forward("m2")}) from (
        select *, least(n2, {forward("n0", "n1", "n3")}) as m2, least(n3, {forward("n2")}) as m3 from (
            select v.conv, g.k, {add("s0", str(DELETE), "D")} as n0, least({add("s1", str(DELETE), "D")}, {move("K", kept, "s", "s0")}) as n1,
                least({add("s2", str(DELETE), "D")}, {move("K", kept, "u", "s0", "s1", "s3")}, {move("R", anew, "", "s0", "s1", "s3")}) as n2,
                least({add("s3", str(DELETE), "D")}, {move("K", kept, "a", "s2")}, {move("R", anew, "", "s2")}) as n3
            from v join g on g.conv is not distinct from v.conv and g.k = v.k + 1))
), best as (
    select t.*, cast(left(least(s0, s3), 9) as bigint) as cost, substr(least(s0, s3), 10) as audit from total t join v on v.conv is not distinct from t.conv and v.k = t.n
), w as (
    select conv, cast(0 as bigint) as i, cast(0 as bigint) as k, 'n' as state, cast(null as varchar) as said, audit from best
    union all
    select conv, i + 1, k, case when edit = 'D' then state when edit = 'K' then initial when state = 'u' then 'a' else 'u' end,
        case when edit = 'D' then said else coalesce(said || chr(10), '') || case when edit = 'K' then role when state = 'u' then 'assistant' else 'user' end || ':' || case when edit = 'I' then '' else text end end, audit
    from (
        select w.conv, i, state, w.said, audit, substr(audit, i + 1, 1) as edit, case when substr(audit, i + 1, 1) = 'I' then w.k else w.k + 1 end as k, g.role, g.text, g.initial
        from w left join g on g.conv is not distinct from w.conv and g.k = w.k + 1 where i < length(audit))
)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
    coalesce(cost, 0) as cost, coalesce(b.audit, '') as audit, sha256(coalesce(w.said, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join best b on b.conv is not distinct from c.conv_id left join w on w.conv is not distinct from b.conv and w.i = length(b.audit)
"""


ORACLE = _oracle()
