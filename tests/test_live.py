"""The live sink: its rules on packets of many samples, and a stream that stops and goes on from its checkpoint."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sigloom.plans import extended
from sigloom.streaming.live import Line, Sequencer

SF = "/root/testdata/sf0.001"


def sequenced(packets, gapless=True, stop_on_skip=False, stop_on_tag=False, until=10**9):
    s = Sequencer(Line(), {}, {}, gapless, stop_on_skip, stop_on_tag)
    for p in packets:
        s.take(p[0], p[1:])
        s.drain()
    s.give_up(until)
    s.drain()
    return s.out


def packet(pos, n=4, tag=None, metadata=None):
    return pos, pos, [float(pos + k) for k in range(n)], tag, metadata


def test_order_does_not_matter():
    rng = random.Random(1)
    packets = [packet(4 * k, tag=4 * k + 100 * (k // 10) if k % 10 == 0 else None, metadata={"f": k} if k % 6 == 0 else None) for k in range(50) if k not in (7, 20, 21)]
    want = sequenced(packets)
    for _ in range(20):
        mixed = packets + rng.sample(packets, 10)
        rng.shuffle(mixed)
        assert sequenced(mixed) == want
    data = [(i, n) for kind, i, n, _, _ in want if kind in ("data", "zeros")]
    # gapless: every block begins where the one before ends
    assert all(a + n == b for (a, n), (b, _) in zip(data, data[1:], strict=False))


def test_tags_and_gaps():
    out = sequenced([packet(0, tag=1000, metadata={"a": 1, "b": 2}), packet(4, tag=900), packet(8, tag=1008), packet(12, tag=1020, metadata={"b": 3}), packet(20)])
    assert out == [
        ("metadata", 1000, None, None, '{"a": 1, "b": 2}'), ("data", 1000, 4, [0.0, 1.0, 2.0, 3.0], None), ("data", 1004, 4, [4.0, 5.0, 6.0, 7.0], None), ("data", 1008, 4, [8.0, 9.0, 10.0, 11.0], None),
        ("zeros", 1012, 8, None, None), ("metadata", 1020, None, None, '{"a": 1, "b": 3}'), ("data", 1020, 4, [12.0, 13.0, 14.0, 15.0], None),
        ("zeros", 1024, 4, None, None), ("metadata", 1028, None, None, '{"a": 1, "b": 3}'), ("data", 1028, 4, [20.0, 21.0, 22.0, 23.0], None),
    ]


def test_stops():
    packets = [packet(0), packet(4), packet(12), packet(16)]
    assert [r[1] for r in sequenced(packets, stop_on_skip=True) if r[0] == "data"] == [0, 4]
    assert [r[1] for r in sequenced([packet(0, tag=5), packet(4), packet(8, tag=13), packet(12)], stop_on_tag=True) if r[0] == "data"] == [5, 9]
    assert not [r for r in sequenced(packets, gapless=False) if r[0] == "zeros"]


def test_overlapping_packets_count_once():
    out = [r for r in sequenced([packet(0), packet(2), packet(4), packet(6, n=1)]) if r[0] == "data"]
    assert [x for r in out for x in r[3]] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0]


def test_a_hole_waits_for_its_time():
    s = Sequencer(Line(), {}, {}, True, False, False)
    for p in (packet(0), packet(8)):
        s.take(p[0], p[1:])
    s.give_up(0)
    s.drain()
    assert [r[1] for r in s.out if r[0] == "data"] == [0] and list(s.held) == [8]
    s.give_up(7)
    assert list(s.held) == [8]
    s.give_up(8)
    assert [(r[0], r[1]) for r in s.out[-3:]] == [("zeros", 4), ("metadata", 8), ("data", 8)] and not s.held


@pytest.mark.parametrize("cut", [3])
def test_restart(spark, tmp_path, cut):
    """A stream that ends after some files and is started anew, with a reorder buffer in its state, gives what one run gives."""
    rows = extended.arrivals(spark, SF).where(F.col("channel").isin("click", "~clock")).cache()
    outs = []
    for name, parts in (("one", [range(10)]), ("two", [range(cut), range(cut, 10)])):
        path, out, checkpoint = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "checkpoint"))
        for part in parts:
            extended.arrive(rows, path, part)
            extended.run_live(spark, path, out, checkpoint)
        outs.append(sorted((tuple(r) for r in spark.read.parquet(out).collect()), key=str))
    assert outs[0] == outs[1] and len(outs[0]) > 100


def test_a_long_hole_costs_no_scan_a_packet():
    """200,000 packets wait for the first one, and go on in one pass (before: each looked through all that waited)."""
    s = Sequencer(Line(0, 0), {}, {}, True, False, False)
    began = time.monotonic()
    for k in range(200_000, 0, -1):
        s.take(k, (k, [float(k)], None, None))
    assert not s.out
    s.take(0, (0, [0.0], None, None))
    s.drain()
    assert [r[1] for r in s.out] == list(range(200_001))
    for k in range(300_000, 400_000, 2):
        s.take(k, (k, [float(k)], None, None))
    s.give_up(10**9)
    assert len([r for r in s.out if r[0] == "zeros"]) == 50_000 and time.monotonic() - began < 20
