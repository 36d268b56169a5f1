"""Several roots, subchannels as columns of their own, and values that do not fit their type."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sigloom.operators.metadata import MetadataStore
from sigloom.sources.roots import Roots, sweep
from sigloom.sources.store import Store, checked_cast


def made(spark, path, ranges, sign=1, rate=(200, 3), subs=1):
    s = Store(spark, str(path))
    s.create("ch", "s32", rate, 2, 400, num_subchannels=subs)
    for a, b in ranges:
        x = spark.range(a, b).select(F.col("id").alias("sample_idx"), (F.col("id") * sign).alias("re"))
        every = x.crossJoin(spark.range(subs).select(F.col("id").alias("subchannel"))).withColumn("re", F.col("re") + 10_000 * F.col("subchannel"))
        s.append(every if subs > 1 else x, "ch")
    return s.root


def test_roots_take_turns(spark, tmp_path):
    """Blocks written to three roots in turn are one channel; a strict reader takes them, in order of the index."""
    roots = [made(spark, tmp_path / str(k), [(100 * j, 100 * j + (100 if j < 5 else 60)) for j in range(k, 9, 3)]) for k in range(3)]
    r = Roots(spark, roots)
    assert r.channels() == ["ch"] and r.bounds("ch") == (0, 859)
    assert sorted((b.block_start, b.n) for b in r.blocks("ch").collect()) == [(0, 560), (600, 60), (700, 60), (800, 60)]
    got = {x.sample_idx: (x.v, x.root) for x in r.read("ch", 50, 720).collect()}
    assert got == {i: (i, i // 100 % 3) for i in range(50, 721) if i < 500 or i % 100 < 60}


def test_overlap_is_refused_before_reading(spark, tmp_path):
    roots = [made(spark, tmp_path / "a", [(0, 300)]), made(spark, tmp_path / "b", [(290, 400)], -1)]
    with pytest.raises(ValueError, match="both hold ch from 290 on"):
        Roots(spark, roots).read("ch", 0, 399)
    got = {x.sample_idx: x.v for x in Roots(spark, roots, strict=False).read("ch", 0, 399).collect()}
    assert got == {i: i if i < 290 else -i for i in range(400)}
    assert {x.sample_idx: x.v for x in Roots(spark, roots[::-1], strict=False).read("ch", 250, 350).collect()} == {i: i if i < 300 else -i for i in range(250, 351)}


def test_roots_must_share_properties(spark, tmp_path):
    roots = [made(spark, tmp_path / "a", [(0, 10)]), made(spark, tmp_path / "b", [(20, 30)], rate=(100, 3))]
    with pytest.raises(ValueError, match="rate_num"):
        Roots(spark, roots).read("ch", 0, 30)
    with pytest.raises(ValueError, match="is a channel"):
        Roots(spark, [roots[0] + "/chunks/channel=ch"])
    with pytest.raises(FileNotFoundError):
        Roots(spark, [str(tmp_path / "none")])


def test_metadata_of_the_first_root(spark, tmp_path):
    roots = [made(spark, tmp_path / str(k), [(10 * k, 10 * k + 5)]) for k in range(3)]
    for k in (1, 2):
        m = MetadataStore(spark, roots[k], "ch")
        m.create((200, 3), 60, 60)
        m.write(spark.createDataFrame([(k, k)], "sample_idx long, x int"))
    assert [r.x for r in Roots(spark, roots).metadata("ch").read().collect()] == [1]


def test_sweep_against_a_search(spark):
    rng = random.Random(4)
    rows = []
    for root in range(4):
        at = 0
        while at < 400:
            at += rng.randrange(0, 20)
            n = rng.randrange(1, 60)
            rows.append((root, at, n))
            at += n
    got = {}
    for p in sweep(spark.createDataFrame(rows, "root int, block_start long, n long"), 4, stretch=32).collect():
        for i in range(p.first, p.first + p.n):
            assert i not in got
            got[i] = (p.holders, p.winner, p.own)
    want = {}
    for root, a, n in rows:
        for i in range(a, a + n):
            want.setdefault(i, [None] * 4)[root] = a
    assert got == {i: ([k for k in range(4) if o[k] is not None], max(k for k in range(4) if o[k] is not None), o) for i, o in want.items()}


def test_a_subchannel_reads_its_column(spark, tmp_path):
    root = made(spark, tmp_path / "wide", [(0, 3000)], subs=64)
    s = Store(spark, root)
    one = s.read("ch", 0, 2999, subchannel=5)
    scan = next(x for x in one._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x)
    assert "s5:array" in scan.split("ReadSchema")[1] and "s6:array" not in scan.split("ReadSchema")[1] and "s4:array" not in scan.split("ReadSchema")[1]
    sizes = {}
    for f in (tmp_path / "wide" / "chunks").rglob("*.parquet"):
        m = pq.ParquetFile(f).metadata
        for g in range(m.num_row_groups):
            for c in range(m.num_columns):
                x = m.row_group(g).column(c)
                sizes[x.path_in_schema.split(".")[0]] = sizes.get(x.path_in_schema.split(".")[0], 0) + x.total_compressed_size
    data = {k: v for k, v in sizes.items() if k[1:].isdigit()}
    assert len(data) == 64 and data["s5"] * 50 < sum(data.values())
    assert [tuple(r) for r in one.orderBy("sample_idx").limit(3).collect()] == [(0, 50_000), (1, 50_001), (2, 50_002)]
    assert s.read("ch", 10, 10).first()["v"] == [10 + 10_000 * k for k in range(64)]
    with pytest.raises(ValueError):
        s.read("ch", 0, 1, subchannel=64)


@pytest.mark.parametrize("dtype, value", [("s16", 1.5), ("s16", -2.7), ("s8", 128.0), ("u8", -1.0), ("u8", 0.25), ("u64", -1.0), ("f32", 1e300), ("s32", float("nan"))])
def test_values_that_do_not_fit_are_refused(spark, dtype, value):
    df = spark.createDataFrame([(value,)], "x double")
    with pytest.raises(Exception, match="a value is"):
        df.select(checked_cast(F.col("x"), dtype).alias("y")).collect()


@pytest.mark.parametrize("dtype, value", [("s16", -3.0), ("u8", 255.0), ("f32", float("inf")), ("f32", 0.1), ("f64", 1e300), ("u64", 2.0**60), ("s64", -5.0), ("s8", None)])
def test_values_that_fit_pass(spark, dtype, value):
    got = spark.createDataFrame([(value,)], "x double").select(checked_cast(F.col("x"), dtype).alias("y")).first()["y"]
    assert got is None if value is None else float(got) == pytest.approx(value)
