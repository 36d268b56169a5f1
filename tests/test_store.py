"""The five-block fixture at 200/3 Hz, negative cases, identifiers, kernels against numpy."""

from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.functions import signal, timebase
from sigloom.operators import blocks, filters, metadata, raster, spectral
from sigloom.sources.store import Store, validate

START = 92957882000
BLOCKS = ((0, 40), (40, 66), (93, 120), (173, 184), (186, 214))


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("store")))
    s.create("ch", "s16", (200, 3), 2, 400)
    for a, b in BLOCKS:
        s.append(spark.range(START + a, START + b).select(F.col("id").alias("sample_idx"), (F.col("id") % 100).alias("re")), "ch")
    return s


def test_blocks_bounds_and_files(store):
    got = sorted((r.block_start - START, r.n) for r in store.blocks("ch").collect())
    assert got == [(0, 66), (93, 27), (173, 11), (186, 28)]
    assert store.bounds("ch") == (START, START + 213)
    files = sorted({(r.subdir, r.file_ms - 1394368230000) for r in store.chunks("ch").select("subdir", "file_ms").collect()})
    assert [f[1] for f in files] == [0, 400, 800, 1200, 1600, 2400, 2800]
    assert {f[0] for f in files} == {1394368230, 1394368232}


def test_read_is_clipped_and_pruned(store):
    got = sorted(r.sample_idx - START for r in store.read("ch", START + 60, START + 100).collect())
    assert got == [*range(60, 66), *range(93, 101)]
    plan = store.chunks("ch", START, START + 10)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "subdir" in plan


def test_refusals(spark, store):
    more = spark.range(START, START + 5).select(F.col("id").alias("sample_idx"), F.col("id").alias("re"))
    with pytest.raises(ValueError):
        store.append(more, "ch")
    with pytest.raises(KeyError):
        store.append(more, "other")
    with pytest.raises(KeyError):
        store.chunks("other")
    with pytest.raises(ValueError):
        store.read("ch", 10, 9)
    with pytest.raises(ValueError):
        store.create("ch", "s32", (200, 3), 2, 400)
    for bad in (("s9", 1, 1, 1, 1), ("s8", 0, 1, 1, 1), ("s8", 1, 1, 1, 3), ("s8", 1, 1, 0, 1)):
        with pytest.raises(ValueError):
            validate(*bad)
    s = spark.range(10).select(F.lit("a").alias("channel"), F.col("id").alias("sample_idx"), F.col("id").alias("re"))
    with pytest.raises(Exception, match="samples asked for"):
        blocks.read_vector(s, "a", 5, 10).collect()
    with pytest.raises(ValueError):
        blocks.read_vector(s, "a", 5, 0)


def test_unsafe_cast_is_refused(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.create("ch", "s8", (100, 1), 1, 1000)
    with pytest.raises(Exception, match="OVERFLOW|out of range|CAST"):
        s.append(spark.range(1).select(F.col("id").alias("sample_idx"), F.lit(1000).alias("re")), "ch")


def test_sample_time(spark):
    sec, ps = timebase.sample_seconds(F.col("id"), 200, 3)
    r = spark.range(START + 1, START + 2).select(sec.alias("s"), ps.alias("p"), timebase.sample_timestamp(F.col("id"), 200, 3).alias("t")).first()
    assert (r.s, r.p) == (1394368230, 15000000000)
    assert r.t.microsecond == 15000


def test_time_at_a_gigahertz(spark):
    idx = 1_394_368_230_000_000_123
    sec, ps = timebase.sample_seconds(F.lit(idx), 10**9, 1)
    assert tuple(spark.range(1).select(sec, ps).first()) == (1_394_368_230, 123_000)


def test_identifiers():
    p = timebase.parse_sample
    assert p("", 200, 3) is None and p("17", 200, 3) == 17 and p("+5", 200, 3, ref=10) == 15
    assert p("1394368230.0", 200, 3) == START == p("2014-03-09T12:30:30Z", 200, 3)
    assert p("+1.5", 200, 3, ref=START) == START + 100
    now = datetime(2014, 3, 9, 12, 30, 29, 5, tzinfo=timezone.utc)
    assert p("nowish", 200, 3, now=now) == START
    assert timebase.parse_time("10") == datetime(1970, 1, 1, 0, 0, 10, tzinfo=timezone.utc)
    with pytest.raises(ValueError):
        p("+5", 200, 3)


def test_metadata_helpers():
    rows = metadata.broadcast_write([1, 2], {"a": [5, 6], "b": "xy!", "c": {"d": (7, 8), "e": 9}})
    assert rows[1] == {"sample_idx": 2, "a": 6, "b": "xy!", "c": {"d": 8, "e": 9}}
    assert metadata.deep_update({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_islands_across_stretches(spark):
    s = spark.range(0, 1000).where("id not in (0, 500, 501)").select(F.lit("a").alias("channel"), F.col("id").alias("sample_idx"))
    assert sorted((r.block_start, r.n) for r in blocks.islands(s, 64).collect()) == [(1, 499), (502, 498)]


def test_windows_and_least_squares(spark):
    assert np.allclose(signal.window("hann", 8), 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(8) / 8))
    code = spectral.random_code(32, 1).real
    h = np.array([1.0, 0.0, 0.5, 0.0])
    x = sum(h[k] * np.roll(code, k) for k in range(4))
    df = spark.createDataFrame([(0, [float(v) for v in x - np.median(x)])], "id long, x array<double>")
    got = sorted((r.k, r.re) for r in spectral.least_squares(df, "id", "x", code, 4).collect())
    want = np.linalg.pinv(np.stack([np.roll(code, k) for k in range(4)], 1)) @ (x - np.median(x) - np.median(x - np.median(x)))
    assert np.allclose([g[1] for g in got], want)


def test_robust_line(spark):
    rng = np.random.default_rng(1)
    t = np.arange(200.0)
    y = 3 * t + 5 + rng.normal(0, 0.1, 200)
    y[::20] += 500
    df = spark.createDataFrame([(float(a), float(b), 1.0) for a, b in zip(t, y, strict=True)], "t double, y double, w double")
    slope, offset = filters.robust_line(df)
    assert abs(slope - 3) < 0.01 and abs(offset - 5) < 0.5


def test_unknown_aggregate_goes_to_numpy(spark):
    df = spark.range(8).select(F.col("id").alias("vec"), F.lit(0).alias("pos"), F.col("id").cast("double").alias("x"))
    assert raster.vector_aggregate(df, 4, "argmax").first().value == 3.0


def test_empty_inputs(spark):
    e = spark.createDataFrame([], "channel string, sample_idx long, re double")
    assert blocks.islands(e).count() == 0
    assert blocks.gap_accounting(blocks.islands(e)).count() == 0
    assert filters.fir(e.select("sample_idx", F.col("re").alias("x")), [1.0, 2.0]).count() == 0


def test_block_table(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.create("ch", "s16", (100, 1), 10, 1000)
    v = spark.range(10).select(F.col("id").alias("pos"), F.col("id").alias("re"))
    assert s.write_blocks(v, "ch", [5, 20], [0, 4]) == 26
    assert sorted((r.block_start, r.n) for r in s.blocks("ch").collect()) == [(5, 4), (20, 6)]
    assert s.write(v, "ch") == 36 and s.bounds("ch") == (5, 35)
    for idx, at in (([50], [0, 1]), ([50], [1]), ([50, 50], [0, 1]), ([60, 70], [0, 0]), ([60, 62], [0, 5]), ([60, 90], [0, 10]), ([], [])):
        with pytest.raises(ValueError):
            s.write_blocks(v, "ch", idx, at)
    with pytest.raises(ValueError):
        s.write(v, "ch", 30)
    w = s.written("ch")
    assert (w["total_samples"], w["gap_samples"], w["next_sample"], w["last_utc"].second) == (20, 11, 36, 0)
    held = s.file_of("ch", 30)
    assert (held.first_sample, held.last_sample) == (5, 35)
    with pytest.raises(FileNotFoundError):
        s.file_of("ch", 5000)


@pytest.mark.parametrize("subs", [1, 8])
@pytest.mark.parametrize("dtype", ["s8", "u8", "s16", "u16", "s32", "u32", "s64", "u64", "f32", "f64"])
@pytest.mark.parametrize("cplx", [False, True])
def test_grid_of_types(spark, tmp_path, dtype, cplx, subs):
    s = Store(spark, str(tmp_path))
    s.create("ch", ("c" if cplx else "") + dtype, (200, 3), 2, 400, is_complex=cplx, num_subchannels=subs)
    cols = [F.col("id").alias("sample_idx"), (F.col("id") % 100).alias("re"), (F.col("id") % 7).alias("im")][: 2 + cplx]
    x = spark.range(START, START + 90).select(*cols)
    if subs > 1:
        x = x.crossJoin(spark.range(subs).select(F.col("id").alias("subchannel"))).withColumn("re", F.col("re") + F.col("subchannel"))
    s.append(x, "ch")
    got = s.read_vector("ch", START, 90, subs - 1).first().vector
    plain = [(v.re, v.im) if cplx else v for v in got]
    assert plain == [((START + k) % 100 + subs - 1, (START + k) % 7) if cplx else (START + k) % 100 + subs - 1 for k in range(90)]
    if dtype[0] == "u":
        low = spark.range(1).select((F.col("id") + START + 500).alias("sample_idx"), F.lit(-1).alias("re"), F.lit(0).alias("im"), F.lit(0).alias("subchannel"))
        with pytest.raises(Exception, match="out of range|lacks"):
            s.append(low if subs > 1 else low.drop("subchannel"), "ch")
    if subs > 1:
        with pytest.raises(ValueError):
            s.read("ch", START, START + 5, subs)
        with pytest.raises(ValueError):
            s.append(x.where("subchannel = 0").drop("subchannel").withColumn("sample_idx", F.col("sample_idx") + 1000), "ch")


def test_repeated_indexes_and_lost_properties(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.create("ch", "s16", (100, 1), 10, 1000)
    x = spark.range(10).select((F.col("id") % 7).alias("sample_idx"), F.col("id").alias("re"))
    with pytest.raises(Exception, match="distinct"):
        s.append(x, "ch")
    s.append(x.where("re < 7"), "ch")
    s.create("other", "cf32", (7, 3), 10, 1000, is_complex=True)
    s.append(x.where("re < 7").withColumn("im", F.lit(1)), "other")
    import shutil

    before = sorted(tuple(r) for r in s.properties().collect())
    shutil.rmtree(tmp_path / "channels")
    assert s.recover() == ["ch", "other"] and sorted(tuple(r) for r in s.properties().collect()) == before
    assert s.recover() == [] and s.last_write("ch")[1].endswith(".parquet")


def test_metadata_store(spark, tmp_path):
    s = metadata.MetadataStore(spark, str(tmp_path), "ch")
    with pytest.raises(FileNotFoundError):
        s.properties()
    s.create((100, 1), 3600, 60)
    s.create((100, 1), 3600, 60)
    with pytest.raises(ValueError):
        s.create((200, 1), 3600, 60)
    x = spark.range(0, 100, 10).select(F.col("id").alias("sample_idx"), F.struct((F.col("id") * 2).alias("gain")).alias("rx"))
    s.write(x)
    for bad in (x.limit(1), x.withColumn("sample_idx", F.lit(500)), x.limit(1).withColumn("sample_idx", F.lit(-1))):
        with pytest.raises(ValueError):
            s.write(bad)
    s.write(spark.range(200, 202).select(F.col("id").alias("sample_idx"), F.lit("x").alias("note")))
    assert s.fields() == ["note", "rx"] and s.bounds() == (0, 201)
    assert sorted(r.sample_idx for r in s.read(25, 45, fill=True).collect()) == [20, 30, 40]


def test_gaps_in_filters(spark):
    x = spark.range(0, 400).where("id not in (100, 250, 251)").select(F.col("id").alias("sample_idx"), (F.col("id") * 1.0).alias("x"))
    got = {r.sample_idx: r.y for r in filters.fir(x, [1.0, 0.0, 1.0], 64).collect()}
    held = set(range(400)) - {100, 250, 251}
    assert got == {i: 2.0 * i + 2 for i in range(398) if {i, i + 1, i + 2} <= held}
    full = {r.sample_idx: r.y for r in filters.correlate(x, [1.0, 1.0], 64).collect()}
    assert full == {i: float(i + (i + 1 if i + 1 in held else 0)) for i in held}
    steps = {r.sample_idx: r.step for r in filters.phase_steps(x.withColumn("p", F.col("x") / 10), "p", 64).collect()}
    assert steps[101] == steps[252] == steps[0] == 0.0 and abs(steps[5] - 0.1) < 1e-9


def test_exact_median(spark):
    rng = np.random.default_rng(3)
    for values in (rng.normal(size=5001), rng.integers(0, 5, 4000).astype(float), np.zeros(3000), np.arange(2000.0)):
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        assert filters.exact_median(df, "x", few=50) == pytest.approx(float(np.median(values)))
    assert filters.exact_median(df.limit(0), "x") is None


def test_asof_and_blocks_across_stretches(spark):
    s = spark.range(0, 1000, 3).select(F.lit("a").alias("channel"), F.col("id").alias("sample_idx"))
    m = spark.createDataFrame([("a", 10, 1.0), ("a", 11, None), ("a", 700, 3.0)], "channel string, sample_idx long, v double")
    got = {r.sample_idx: (r.md_idx, r.md_value) for r in metadata.asof(s, m, "channel", "sample_idx", "v", 64).collect()}
    assert got[9] == (None, None) and got[12] == (11, None) and got[600] == (11, None) and got[702] == (700, 3.0) and len(got) == 334
    b = spark.createDataFrame([("a", 0, 100), ("a", 100, 5), ("a", 110, 300), ("a", 500, 1)], "channel string, block_start long, n long")
    assert sorted((r.block_start, r.n) for r in blocks.merge_blocks(b, 16).collect()) == [(0, 105), (110, 300), (500, 1)]
    assert sorted((r.gap_start, r.gap_n) for r in blocks.gaps(blocks.merge_blocks(b, 16)).collect()) == [(105, 5), (410, 90)]
    with pytest.raises(Exception, match="even number"):
        blocks.interleaved(spark.createDataFrame([([1.0],)], "a array<double>"), "a").collect()
    assert blocks.interleaved(spark.createDataFrame([([],)], "a array<double>"), "a").first().a == []


def test_channel_and_range_identifiers():
    assert timebase.parse_channels("a, b:1") == [("a", None), ("b", 1)]
    assert timebase.parse_range("5:+10", 200, 3) == (5, 15) and timebase.parse_range(":", 200, 3) == (None, None)
    for f, bad in ((timebase.parse_channels, "a,a"), (timebase.parse_channel, ":1"), (timebase.parse_channel, "a:x")):
        with pytest.raises(ValueError):
            f(bad)
    for bad in ("5", "9:5", "1:2:3"):
        with pytest.raises(ValueError):
            timebase.parse_range(bad, 200, 3)


def test_residual_frequency_waveform_and_prc(spark):
    n, f = 64, 9.3
    t = np.arange(n)
    x = np.cos(2 * np.pi * f * t / n)
    df = spark.createDataFrame([(0, x.tolist(), x.tolist())], "id long, a array<double>, b array<double>")
    r = spectral.residual_frequency(df, "id", "a", "b", 1, 30, n, float(n), 15.0).first()
    z = np.abs(np.fft.fft(x) * np.conj(np.fft.fft(x))) ** 2
    k = int(z[1:31].argmax()) + 1
    y = 10 * np.log10(z[k - 1 : k + 2])
    assert r.peak_k == k and r.found and r.hz == pytest.approx(k + 0.5 * (y[0] - y[2]) / (y[0] - 2 * y[1] + y[2]))
    assert r.snr_db == pytest.approx(10 * np.log10(z[k] / (np.median(z) / np.log(2))))
    w = spectral.waveform(np.array([1, -1, 1]), 4, np.ones(3) / 3)
    assert len(w) == 12 and np.abs(w).max() == pytest.approx(1)


def test_transfer_and_mirror(spark, tmp_path):
    from sigloom.operators import catalog
    from sigloom.streaming import ingest

    for k in range(5):
        at = tmp_path / "in" / f"ch{k % 2}" / "2024-01-01T00-00-00"
        at.mkdir(parents=True, exist_ok=True)
        (at / f"rf@{100 + k}.000.h5").write_bytes(b"x" * (k + 1))
    files = catalog.list_files(spark, str(tmp_path / "in"))
    assert [r.key_ms for r in catalog.in_order(files, reverse=True).collect()] == [104000, 103000, 102000, 101000, 100000]
    assert catalog.transfer(files.where("key_ms < 103000"), str(tmp_path / "in"), str(tmp_path / "out")) == 3
    assert (tmp_path / "out" / "ch1" / "2024-01-01T00-00-00" / "rf@101.000.h5").read_bytes() == b"xx"
    table = str(tmp_path / "table")
    files.select("path", "size", "mtime").write.parquet(table)
    stream = ingest.source(spark, table, "path string, size long, mtime timestamp")
    for want in (5, 0):
        assert ingest.mirror(stream, str(tmp_path / "in"), str(tmp_path / "mirror"), str(tmp_path / "check")) == want
    assert catalog.transfer(files, str(tmp_path / "in"), str(tmp_path / "moved"), move=True) == 5
    assert not list((tmp_path / "in").rglob("*.h5")) and len(list((tmp_path / "moved").rglob("*.h5"))) == 5


def test_forward_only_retention_and_restart(spark, tmp_path):
    from sigloom.streaming import ingest

    at, out, back = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "channel string, sample_idx long"
    stream = lambda: ingest.blocks_of(ingest.source(spark, at, schema)).writeStream.outputMode("update").foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{out}/batch={k}"))
    for a, b in ((0, 10), (10, 20), (25, 30)):
        spark.range(a, b).select(F.lit("a").alias("channel"), F.col("id").alias("sample_idx")).coalesce(1).write.mode("append").parquet(at)
        stream().option("checkpointLocation", back).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out).groupBy("block_start").agg(F.max("n").alias("n")).collect()
    assert sorted((r.block_start, r.n) for r in got) == [(0, 20), (25, 5)]
    held, last = [], [None]

    def write(df):
        rows = sorted(r.sample_idx for r in df.collect())
        held.extend(rows)
        last[0] = max([*rows, last[0] or 0])

    batch = ingest.forward_only(write, lambda: last[0])
    for a, b in ((0, 5), (3, 8)):
        batch(spark.range(a, b).select(F.col("id").alias("sample_idx")), 0)
    assert held == [0, 1, 2, 3, 4, 5, 6, 7]
    gone = []
    files = lambda: spark.createDataFrame([("g", k, str(k), 10) for k in range(6)], "grp string, key_ms long, path string, size long")
    from sigloom.operators import catalog

    ingest.retain(ingest.source(spark, at, schema), lambda f: catalog.expired(f, size=30), lambda f: gone.extend(r.path for r in f.collect()), files, str(tmp_path / "ring"))
    assert sorted(set(gone)) == ["0", "1", "2"]


def test_tag_translators(spark):
    from sigloom.streaming import ingest

    tags = spark.createDataFrame([(1, "freq", 5.0), (2, "other", 1.0)], "offset long, key string, value double")
    got = ingest.tagged(tags, {"freq": lambda t: t.select("offset", F.explode(F.array(F.lit("lo"), F.lit("hi"))).alias("key"), "value")})
    assert sorted((r.offset, r.key) for r in got.collect()) == [(1, "hi"), (1, "lo"), (2, "other")]
