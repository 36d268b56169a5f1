"""Directories of long appends: their number does not grow with the time an append spans, and ranges, blocks and bounds are as they were."""

import re

import pytest
from pyspark.sql import functions as F

from sigloom.sources import store as stores
from sigloom.sources.store import Store

#: Appended ranges at 10 Hz in folders of 1 s: long, then from within its last folder on, short, and long again after a gap.
PARTS = ((25, 5996), (5996, 13000), (13004, 13016), (14111, 16000))


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("store")))
    s.create("c", "f64", (10, 1), 1, 500)
    for a, b in PARTS:
        s.append(spark.range(a, b).where("id % 1000 != 7").select(F.col("id").alias("sample_idx"), (F.col("id") * 0.5).alias("re")), "c")
    return s


def _held(first, last):
    return [i for a, b in PARTS for i in range(max(a, first), min(b, last + 1)) if i % 1000 != 7]


def test_number_of_directories(store):
    times = sorted(store._times("c"))
    # 598, 702, 3 and 190 folders
    assert len(times) <= 3 * (stores.DIRECTORIES + 1) + 3
    assert {2, 599, 1300, 1301, 1411} <= set(times)
    assert [stores._pack(n) for n in (1, 128, 129, 256, 257, 10**6)] == [1, 1, 2, 2, 4, 8192]


def test_rows_know_their_folder(store):
    rows = store.chunks("c").select("subdir", "file_ms", "block_start", "n").collect()
    assert all(r.subdir == r.file_ms // 1000 == r.block_start // 10 for r in rows)
    assert sum(r.n for r in rows) == len(_held(0, 20000))
    assert store.file_of("c", 5993).subdir == 599 and store.written("c")["last_subdir"] == 1599


@pytest.mark.parametrize("first, last", [(0, 24), (30, 41), (5989, 5999), (5996, 5996), (12990, 13020), (13003, 14200), (15995, 20000), (0, 20000)])
def test_ranges(store, first, last):
    got = store.read("c", first, last).collect()
    assert sorted((r.sample_idx, r.v) for r in got) == [(i, i * 0.5) for i in _held(first, last)]


def test_a_range_reads_few_directories(store):
    # sample 9000 is of folder 900, in the directory of folders 896 to 903
    plan = store.chunks("c", 9000, 9100)._jdf.queryExecution().executedPlan().toString()
    bounds = re.search(r"PartitionFilters: \[([^\]]*)\]", plan).group(1)
    assert re.findall(r"subdir#\d+ ([<>]=) (\d+)", bounds) == [(">=", "896"), ("<=", "910")]


def test_blocks_and_bounds(store):
    want, before = [], None
    for i in _held(0, 20000):
        if i - 1 != before:
            want.append([i, 0])
        want[-1][1] += 1
        before = i
    assert sorted([r.block_start, r.n] for r in store.blocks("c").collect()) == want
    assert store.bounds("c") == (25, 15999)


def test_roundtrip_of_many_folders(spark, tmp_path, monkeypatch):
    from sigloom.plans import catalogue

    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey", "o_totalprice").toPandas()
    size = int(orders["o_orderkey"].max()) + 1
    copies = spark.createDataFrame(orders).crossJoin(spark.range(40).withColumnRenamed("id", "r"))
    copies.select((F.col("o_orderkey") + F.col("r") * size).alias("o_orderkey"), "o_totalprice").write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(catalogue, "scratch", lambda _: str(tmp_path / "s"))
    got = sorted(tuple(r) for r in catalogue.queries()["store_roundtrip"](spark, str(tmp_path)).collect())
    assert got == [(i, x) for i, x in sorted(zip(orders["o_orderkey"].tolist(), orders["o_totalprice"].tolist(), strict=True)) if 25 <= i <= 1210]
    held = Store(spark, str(tmp_path / "s"))
    # all copies are stored, over some 450 folders
    assert held.written("ord")["total_samples"] == 40 * len(orders)
    assert len(held._folders("ord")) <= stores.DIRECTORIES + 8
