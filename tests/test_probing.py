"""Bounds by probing: bad files at both ends, folders between that are not read, and rows numbered by stretches."""

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sigloom.operators import blocks
from sigloom.sources.store import Store


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.create("c", "f64", (10, 1), 10, 10_000)
    # folders of 100 samples: 20 to 99, ..., 1000 to 1010
    s.append(spark.range(20, 1011).select(F.col("id").alias("sample_idx"), F.col("id").cast("double").alias("re")), "c")
    return s


def _files(store, folder):
    return sorted(Path(f"{store.root}/chunks/channel=c/subdir={folder}").glob("*.parquet"))


def _spoil(store, folder, body=b"no parquet"):
    for f in _files(store, folder):
        f.write_bytes(body)
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)


def test_bad_ends(spark, store):
    assert store.bounds("c") == (20, 1010) and store.bad_files("c").count() == 0
    _spoil(store, 0)
    _spoil(store, 100, b"")
    whole = _files(store, 90)[0].read_bytes()
    _spoil(store, 90, whole[: len(whole) // 2])
    assert store.bounds("c") == (100, 899)
    bad = [r["path"] for r in store.bad_files("c").collect()]
    assert sorted(bad) == sorted(str(f) for k in (0, 90, 100) for f in _files(store, k))
    with pytest.raises(Exception, match="(?i)parquet"):
        store.bounds("c", skip_bad=False)
    with pytest.raises(Exception, match="(?i)parquet"):
        # a writer must know what is held
        store.append(spark.range(5000, 5001).select(F.col("id").alias("sample_idx"), F.lit(0.0).alias("re")), "c")
    for f in _files(store, 20):
        f.unlink()
    for k in (*range(10, 100, 10),):
        _spoil(store, k)
    assert store.bounds("c") is None
    shutil.rmtree(f"{store.root}/chunks/channel=c")
    assert store.bounds("c") is None and store.bad_files("c").count() == 0


def test_middle_is_not_read(store, monkeypatch):
    asked, own = [], Store._indexes

    def seen(self, folders, skip_bad):
        asked.append([int(f.rpartition("=")[2]) for f in folders])
        return own(self, folders, skip_bad)

    monkeypatch.setattr(Store, "_indexes", seen)
    assert store.bounds("c") == (20, 1010) and asked == [[0], [100]]
    for k in (0, 10, 20, 100):
        _spoil(store, k)
    asked.clear()
    assert store.bounds("c") == (300, 999) and asked == [[0], [10, 20], [30, 40, 50, 60], [100], [90, 80]]


def test_nth(spark):
    rows = [(g, i) for g in ("a", "b", None) for i in (*range(0, 300, 7), -5, None)]
    df = spark.createDataFrame(rows, "g string, i long")
    for step, first, stretch in ((3, 0, 16), (5, 2, 50), (1, 4, 1)):
        want = []
        for g in ("a", "b", None):
            own = sorted((r[1] for r in rows if r[0] == g), key=lambda i: -(2**63) if i is None else i)
            want += [(g, i) for i in own[first::step]]
        got = [tuple(r) for r in blocks.nth_of_group(df, "g", "i", step, first, stretch).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
