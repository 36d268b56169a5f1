"""A live tagged sink: packets of samples by stream position, with time tags and metadata, become data, gaps and metadata by sample index.

Packets may come out of order, twice or never. What is in order is passed on; what is ahead waits in a reorder buffer; a timer of event time
gives a hole up once the watermark has passed the packet behind it; packets behind the watermark are late and left out.
Everything is passed on once (append mode), and state is held for open holes only.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: What a live sink puts out: kind is data, zeros (a gap of n samples) or metadata (all fields as they stand from sample_idx on, as JSON).
OUT = "channel string, kind string, sample_idx long, n long, data array<double>, metadata string"
#: Positions of a block, in which waiting packets are one value of Spark's state; rows that are put out at once.
BLOCK, PIECE = 1 << 14, 10_000


@dataclass
class Line:
    """Where a channel stands: the position and index due next, None before the first sample; whether it has stopped."""

    pos: int | None = None
    idx: int | None = None
    stopped: bool = False


class Sequencer:
    """The rules of one channel, without Spark: which packets go on, where, and what waits. held: position to (ts, data, tag, metadata)."""

    def __init__(self, line: Line, held: dict[int, tuple], fields: dict, gapless: bool, stop_on_skip: bool, stop_on_tag: bool):
        self.line, self.held, self.fields = line, held, fields
        self.gapless, self.stop_on_skip, self.stop_on_tag = gapless, stop_on_skip, stop_on_tag
        self.out: list[tuple] = []
        #: Positions of held as a heap; some may have gone.
        self.order = list(held)
        heapq.heapify(self.order)

    def _first(self) -> int | None:
        """The least position that waits."""
        while self.order and self.order[0] not in self.held:
            heapq.heappop(self.order)
        return self.order[0] if self.order else None

    def _hold(self, pos: int, packet: tuple) -> None:
        if pos not in self.held:
            self.held[pos] = packet
            heapq.heappush(self.order, pos)

    def take(self, pos: int, packet: tuple) -> None:
        """A packet waits, unless its place has gone by or is taken already."""
        if not self.line.stopped and (self.line.pos is None or pos >= self.line.pos):
            self._hold(pos, packet)

    def drain(self) -> None:
        """Pass on what is due."""
        while not self.line.stopped and self.line.pos in self.held:
            self._pass(self.line.pos)
        if self.line.stopped:
            self.held.clear()

    def give_up(self, ts: int) -> None:
        """Event time has passed ts: nothing comes any more before a packet of that time."""
        while self.held and not self.line.stopped:
            first = self._first()
            if self.held[first][0] > ts and first != self.line.pos:
                break
            self._pass(first)
        if self.line.stopped:
            self.held.clear()

    def _pass(self, pos: int) -> None:
        _, data, tag, metadata = self.held.pop(pos)
        line = self.line
        begun = line.pos is not None
        due = line.idx + pos - line.pos if begun else pos
        # a time tag that goes backwards is not followed; one that says what is due changes nothing
        jumps = tag is not None and tag > due
        at = tag if jumps or not begun and tag is not None else due
        if begun and (self.stop_on_tag and tag is not None or self.stop_on_skip and at > line.idx):
            line.stopped = True
            return
        if begun and at > line.idx and self.gapless:
            self.out.append(("zeros", line.idx, at - line.idx, None, None))
        if metadata or not begun or at > line.idx:
            self.fields.update(metadata or {})
            self.out.append(("metadata", at, None, None, json.dumps(self.fields, sort_keys=True)))
        self.out.append(("data", at, len(data), data, None))
        line.pos, line.idx = pos + len(data), at + len(data)
        # a packet that the one passed on overlaps begins where that one ends
        while (late := self._first()) is not None and late < line.pos:
            ts, rest, tag, metadata = self.held.pop(late)
            if len(rest) > line.pos - late:
                self._hold(line.pos, (ts, rest[line.pos - late :], None, metadata))


class LiveSink(StatefulProcessor):
    """A Sequencer a channel, its state in Spark's: where it stands, the reorder buffer by blocks of positions, the metadata's fields by name, one timer."""

    def __init__(self, gapless: bool = True, stop_on_skip: bool = False, stop_on_tag: bool = False):
        self.rules = (gapless, stop_on_skip, stop_on_tag)

    def init(self, handle) -> None:
        self.handle = handle
        self.line = handle.getValueState("line", "pos long, idx long, stopped boolean")
        self.held = handle.getMapState("blocks", "block long", "pos array<bigint>, ts array<bigint>, data array<array<double>>, tag array<bigint>, metadata array<string>")
        self.fields = handle.getMapState("fields", "name string", "value string")

    def _load(self) -> Sequencer:
        line = Line(*self.line.get()) if self.line.exists() else Line()
        held, blocks = {}, {}
        for k, packed in self.held.iterator():
            blocks[k[0]] = set(packed[0])
            held |= {int(pos): (int(ts), list(data), None if tag is None else int(tag), json.loads(md) if md else None) for pos, ts, data, tag, md in zip(*packed, strict=True)}
        self.before = (blocks, {k[0]: v[0] for k, v in self.fields.iterator()})
        return Sequencer(line, held, {k: json.loads(v) for k, v in self.before[1].items()}, *self.rules)

    def _store(self, s: Sequencer) -> None:
        had, fields = self.before
        blocks: dict[int, list[int]] = {}
        for pos in s.held:
            blocks.setdefault(pos // BLOCK, []).append(pos)
        for block in had.keys() - blocks.keys():
            self.held.removeKey((block,))
        for block, here in blocks.items():
            # a packet that waits stays as it is, so equal positions are an equal block
            if had.get(block) != set(here):
                ts, data, tag, md = zip(*[s.held[p] for p in here], strict=True)
                self.held.updateValue((block,), (here, list(ts), list(data), list(tag), [json.dumps(m) if m else None for m in md]))
        for name, value in s.fields.items():
            if fields.get(name) != json.dumps(value):
                self.fields.updateValue((name,), (json.dumps(value),))
        self.line.update((s.line.pos, s.line.idx, s.line.stopped))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if s.held:
            self.handle.registerTimer(s.held[s._first()][0])

    def _rows(self, key, s: Sequencer) -> Iterator:
        import pandas as pd

        for k in range(0, len(s.out), PIECE):
            yield pd.DataFrame([(key[0], *r) for r in s.out[k : k + PIECE]], columns=["channel", "kind", "sample_idx", "n", "data", "metadata"]).astype({"n": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        s, passed = self._load(), timerValues.getCurrentWatermarkInMs()
        # Spark leaves out what was late a batch ago; what is late by now is left out here, after the holes that this closes
        s.give_up(passed)
        for frame in rows:
            for pos, ts, data, tag, md in zip(frame["pos"], frame["ts_ms"], frame["data"], frame["tag"], frame["metadata"], strict=True):
                if ts > passed and data is not None and len(data):
                    s.take(int(pos), (int(ts), [float(x) for x in data], None if tag is None or tag != tag else int(tag), json.loads(md) if md else None))
        s.drain()
        self._store(s)
        yield from self._rows(key, s)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        s = self._load()
        s.give_up(timerValues.getCurrentWatermarkInMs())
        s.drain()
        self._store(s)
        yield from self._rows(key, s)

    def close(self) -> None:
        pass


def live_sink(packets: DataFrame, delay: str, gapless: bool = True, stop_on_skip: bool = False, stop_on_tag: bool = False) -> DataFrame:
    """SNK-11, SRC-23: a stream of packets (channel, pos, ts, data, tag, metadata) as rows OUT, each once, in order within a channel.

    pos counts the stream's samples; a packet's samples follow its first. tag, where there is one, is the absolute index of its first sample: it may only go
    forward, and what it skips is a gap. Without any tag indexes are positions. metadata is a JSON object of fields to change; the
    fields as they stand come with every change, at a channel's start and after a gap. Repeated packets count once. ts is the packet's event time, rising with
    pos; a hole is given up when the watermark, delay behind the latest ts, passes the packet behind it. gapless puts out gaps as rows zeros.
    stop_on_skip and stop_on_tag end a channel at its first gap or later time tag; what came before stays.
    The session needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass). A channel is one key: its packets, not its samples, are rows.
    """
    timed = packets.withColumn("ts_ms", F.unix_millis("ts")).withWatermark("ts", delay)
    return timed.groupBy("channel").transformWithStateInPandas(LiveSink(gapless, stop_on_skip, stop_on_tag), OUT, "append", "EventTime")
