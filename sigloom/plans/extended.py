"""More queries of the catalogue: writers, subchannels, complex reads, metadata stores, streams, gaps, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions import signal
from sigloom.functions.timebase import div
from sigloom.operators import blocks, catalog, filters, metadata, raster, spectral, watching
from sigloom.plans.catalogue import DEN, FILE_MS, NUM, SUBDIR_S, ev, fil, ord_, query, r6, s6, scratch, vec
from sigloom.sources.store import Store
from sigloom.streaming import ingest

# --- store -------------------------------------------------------------------------------------------------------


@query("write_blocks", "select 'ord' as channel, block_start, n from (select unnest([50, 200]) as block_start, unnest([100, 900]) as n) union all select 'ord', 5000, count(*) - 1000 from orders")
def write_blocks(spark, d):
    """SNK-02, SNK-03: all orders written as three blocks of a block table, one index after the other."""
    s = Store(spark, scratch(spark))
    s.create("ord", "f64", (NUM, DEN), 200 * SUBDIR_S, 100 * FILE_MS)
    pos = ord_(spark, d).select(F.col("sample_idx").alias("pos"), F.col("x").alias("re"))
    s.write_blocks(pos, "ord", [50, 200, 5000], [0, 100, 1000])
    return s.blocks("ord")


@query("write_next", "select o_orderkey + 7 as sample_idx, o_totalprice as v from orders union all select o_orderkey + 8 + (select max(o_orderkey) from orders), -o_totalprice from orders")
def write_next(spark, d):
    """SNK-02: a block at sample 7, then one at the next index, which the writer knows."""
    s = Store(spark, scratch(spark))
    s.create("ord", "f64", (NUM, DEN), 200 * SUBDIR_S, 100 * FILE_MS)
    pos = ord_(spark, d).select(F.col("sample_idx").alias("pos"), F.col("x").alias("re"))
    s.write(pos, "ord", 7)
    s.write(pos.withColumn("re", -F.col("re")), "ord")
    first, last = s.bounds("ord")
    return s.read("ord", first, last)


@query("write_stats", "select count(*) as total_samples, cast(0 as bigint) as gap_samples, max(o_orderkey) + 1 as next_sample, max(o_orderkey) as last_sample from orders")
def write_stats(spark, d):
    """SNK-09, SRC-10, SRC-11: what a writer knows, and the last file."""
    s = Store(spark, scratch(spark))
    s.create("ord", "f64", (NUM, DEN), 200 * SUBDIR_S, 100 * FILE_MS)
    s.append(ord_(spark, d).withColumnRenamed("x", "re"), "ord")
    w = s.written("ord")
    held = s.file_of("ord", w["next_sample"] - 1)
    if not s.last_write("ord")[1].startswith("file:") and "://" not in s.last_write("ord")[1]:
        raise RuntimeError("the last write has a path")
    return spark.createDataFrame([(w["total_samples"], w["gap_samples"], w["next_sample"], held["last_sample"])], "total_samples long, gap_samples long, next_sample long, last_sample long")


@query("bounds_bad_ends", f"with f as (select o_orderkey as i, o_orderkey * {DEN} // {NUM} // 10 as folder from orders), e as (select min(folder) as a, max(folder) as b from f) select min(i) as first_sample, max(i) as last_sample, cast(2 as bigint) as bad_folders from f, e where folder > a and folder < b")
def bounds_bad_ends(spark, d):
    """SRC-09, SRT-03: orders in folders of ten seconds, all files of the first and the last folder spoilt: the bounds of the rest, and how many folders are bad.

    The first and the last are appends of their own, so that no folder between shares a directory with them.
    """
    s = Store(spark, scratch(spark))
    s.create("ord", "f64", (NUM, DEN), 10, 2000)
    o, at = ord_(spark, d).withColumnRenamed("x", "re"), div(F.col("sample_idx") * DEN, NUM * 10)
    low, high = o.agg(F.min(at), F.max(at)).first()
    for part in (at == low, (at > low) & (at < high), (at > low) & (at == high)):
        s.append(o.where(part), "ord")
    held = s._folders("ord")
    for folder in (held[0], held[-1]):
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        for f in fs.listStatus(at):
            with_junk = fs.create(f.getPath(), True)
            with_junk.write(bytearray(b"no parquet"))
            with_junk.close()
    first, last = s.bounds("ord") or (None, None)
    folder = F.element_at(F.split("path", "/"), -2)
    return s.bad_files("ord").agg(F.lit(first).cast("long").alias("first_sample"), F.lit(last).cast("long").alias("last_sample"), F.count_distinct(folder).alias("bad_folders"))


def _subchannels(spark, d) -> Store:
    s = Store(spark, scratch(spark))
    s.create("vec", "f64", (NUM, DEN), 200 * SUBDIR_S, 100 * FILE_MS, num_subchannels=64)
    long = raster.vectors(vec(spark, d), "vec_id", "embedding")
    s.append(long.select(F.col("vec").alias("sample_idx"), F.col("pos").alias("subchannel"), F.col("x").alias("re")), "vec")
    return s


@query("subchannel_read", "select cast(vec_id as bigint) as sample_idx, cast(embedding[6] as double) as v from embeddings")
def subchannel_read(spark, d):
    """PRJ-01: vectors stored as 64 subchannels, one of them read back."""
    s = _subchannels(spark, d)
    return s.read("vec", *s.bounds("vec"), subchannel=5)


@query("subchannels_all", f"select cast(vec_id as bigint) as sample_idx, {s6('list_sum(list_transform(embedding, lambda x: cast(x as double)))', 'total')}, cast(len(embedding) as bigint) as width from embeddings")
def subchannels_all(spark, d):
    """PRJ-01: all subchannels of each sample as an array."""
    s = _subchannels(spark, d)
    return s.read("vec", *s.bounds("vec")).select("sample_idx", r6(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), "total"), F.size("v").cast("long").alias("width"))


@query("vector_complex", "select l_orderkey, l_linenumber, cast(l_linenumber as double) as re, cast(-l_linenumber as double) as im, cast(cast(l_quantity as float) as double) as re64, 0.0::double as im64 from lineitem")
def vector_complex(spark, d):
    """SRC-05, SRC-07: complex structs of short integers in the smallest floating type, and reals as single-precision complex values."""
    import warnings

    pair = F.struct(F.col("l_linenumber").cast("smallint").alias("re"), (-F.col("l_linenumber")).cast("smallint").alias("im"))
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", pair.alias("z"), F.col("l_quantity").cast("double").alias("q"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", DeprecationWarning)
        got = blocks.as_complex64(blocks.as_float(rows, "z"), "q")
    return got.select("l_orderkey", "l_linenumber", *[F.col(f"{c}.{p}").cast("double").alias(p + ("64" if c == "q" else "")) for c in "zq" for p in ("re", "im")])


@query("complex_store", "select event_id as sample_idx, round(value * 10) as re, round(cast(json_extract_string(props, '$.k') as double)) as im from events")
def complex_store(spark, d):
    """SRC-05, SNK-05: complex 32-bit samples stored and read back in double precision."""
    s = Store(spark, scratch(spark))
    s.create("ev", "cs32", (NUM, DEN), 200 * SUBDIR_S, 100 * FILE_MS, is_complex=True)
    s.append(ev(spark, d).select("sample_idx", F.round(F.col("re") * 10).alias("re"), F.round("im").alias("im")), "ev")
    return blocks.as_float(s.read("ev", *s.bounds("ev")), "v").select("sample_idx", "v.re", "v.im")


@query("interleaved", "select cast(vec_id as bigint) as vec, cast(k as bigint) as pos, cast(embedding[2 * k + 1] as double) as re, cast(embedding[2 * k + 2] as double) as im from (select vec_id, embedding, unnest(range(0, 32)) as k from embeddings)")
def interleaved(spark, d):
    """ARR-01: vectors of 64 items as 32 complex values."""
    rows = blocks.interleaved(vec(spark, d).select(F.col("vec_id").cast("long").alias("vec"), F.col("embedding").cast("array<double>").alias("a")), "a")
    return rows.select("vec", F.posexplode("a").alias("p", "z")).select("vec", F.col("p").cast("long").alias("pos"), "z.re", "z.im")


@query("archive_range", "select o_orderkey as sample_idx, o_totalprice as v from orders where o_orderkey between 100 and 900")
def archive_range(spark, d):
    """SNK-14: a time range of a store to another one, compressed anew."""
    a, b = Store(spark, scratch(spark)), Store(spark, scratch(spark))
    a.create("ord", "f64", (NUM, DEN), 200 * SUBDIR_S, 100 * FILE_MS)
    a.append(ord_(spark, d).withColumnRenamed("x", "re"), "ord")
    catalog.archive(a, b, "ord", 100, 900)
    return b.read("ord", *b.bounds("ord"))


@query("properties_recovered", f"select 'ord' as channel, 'f64' as dtype, cast({NUM} as bigint) as rate_num, cast({DEN} as bigint) as rate_den, count(*) as n from orders")
def properties_recovered(spark, d):
    """SRC-27: a store whose properties were lost gets them back from its chunks."""
    s = Store(spark, scratch(spark))
    s.create("ord", "f64", (NUM, DEN), 200 * SUBDIR_S, 100 * FILE_MS)
    s.append(ord_(spark, d).withColumnRenamed("x", "re"), "ord")
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{s.root}/channels")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    s.recover()
    n = s.chunks("ord").agg(F.sum("n").alias("n"))
    return s.properties().select("channel", "dtype", "rate_num", "rate_den").crossJoin(F.broadcast(n))


# --- metadata store ----------------------------------------------------------------------------------------------


def _metadata_store(spark, d) -> metadata.MetadataStore:
    s = metadata.MetadataStore(spark, scratch(spark), "ord")
    s.create((NUM, DEN), 3600, 60)
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("sample_idx"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    s.write(rows.where("sample_idx % 2 = 0"))
    s.write(rows.where("sample_idx % 2 = 1"))
    return s


@query("md_store", "select 'ord' as channel, o_orderkey as sample_idx, o_totalprice as price, o_orderpriority as priority from orders")
def md_store(spark, d):
    """SNK-10, SRC-12, SRC-19, SRC-20: metadata written in two parts to a channel's store and read back."""
    return _metadata_store(spark, d).read().select("channel", "sample_idx", "price", "priority")


@query("md_store_range", "select 'ord' as channel, o_orderkey as sample_idx, o_totalprice as price from orders where o_orderkey between (select max(o_orderkey) from orders where o_orderkey <= 100) and 500")
def md_store_range(spark, d):
    """SRC-13, SRC-14, SNK-15: a range of a stored channel, archived to another store with the last row before it."""
    a, b = _metadata_store(spark, d), metadata.MetadataStore(spark, scratch(spark), "ord")
    catalog.archive_metadata(a, b, 100, 500)
    return b.read().select("channel", "sample_idx", "price")


# --- gaps and filters --------------------------------------------------------------------------------------------


@query("fir_gappy", f"select a.channel, a.sample_idx, {s6('a.re + 2 * b.re - c.re', 'y')} from ev a join ev b on b.channel = a.channel and b.sample_idx = a.sample_idx + 1 join ev c on c.channel = a.channel and c.sample_idx = a.sample_idx + 2", "ev")
def fir_gappy(spark, d):
    """DSP-08 over channels with gaps: only whole runs of neighbours give a value."""
    x = ev(spark, d).select("channel", "sample_idx", F.col("re").alias("x"))
    return filters.fir(x, [1.0, 2.0, -1.0], by=("channel",)).select("channel", "sample_idx", r6(F.col("y"), "y"))


_BARKER_13 = (1, 1, 1, 1, 1, -1, -1, 1, 1, -1, 1, -1, 1)


@query("correlate_full", "select sample_idx, round(" + " + ".join(f"({c}) * coalesce(lead(x, {k}) over w, 0)" if k else "x" for k, c in enumerate(_BARKER_13)) + ", 4) + 0.0 as y from ord window w as (order by sample_idx)", "ord")
def correlate_full(spark, d):
    """DSP-08: the full correlation, lag 0 aligned, zeros past the end."""
    return filters.correlate(ord_(spark, d), signal.barker(13)).select("sample_idx", (F.round("y", 4) + F.lit(0.0)).alias("y"))


@query("s4_clamped", f"with b as (select min(sample_idx) as lo, max(sample_idx) as hi from ord) select o.sample_idx, {s6('stddev_pop(q.x) / (select median(x) from ord)', 's4')} from ord o, b, (select unnest(range(-25, 25)) as k) f join ord q on q.sample_idx = greatest(b.lo, least(b.hi, o.sample_idx + f.k)) group by o.sample_idx", "ord")
def s4_clamped(spark, d):
    """AGG-13, WIN-06: the rolling frame clamped at both ends, over the exact median."""
    return filters.rolling_s4(ord_(spark, d), 25, clamped=True).select("sample_idx", r6(F.col("s4"), "s4"))


@query("gapless_pieces", "with g as (select channel, block_start, n, 'data' as kind from isl union all select channel, e, block_start - e, 'zeros' from (select *, lag(block_start + n) over (partition by channel order by block_start) as e from isl) where block_start > e) select channel, block_start + k * 4 as block_start, least(4, n - k * 4) as n, kind from (select *, unnest(range(0, (n - 1) // 4 + 1)) as k from g)", "ev isl")
def gapless_pieces(spark, d):
    """SRC-23: a gapless reader's output in pieces of at most four samples."""
    return blocks.gap_zeros(blocks.islands(ev(spark, d)), 4)


@query("nth_of_group", "select channel, sample_idx from (select *, row_number() over (partition by channel order by sample_idx) - 1 as r from ev) where r >= 2 and (r - 2) % 5 = 0", "ev")
def nth_of_group(spark, d):
    """WIN-09: every fifth sample of each channel from the third on."""
    return blocks.nth_of_group(ev(spark, d), "channel", "sample_idx", 5, 2).select("channel", "sample_idx")


@query("detrend_median", f"select vec, pos, {s6('x - median(x) over (partition by vec)', 'x')} from vec", "vec")
def detrend_median(spark, d):
    """MTH-08 by the median."""
    return spectral.detrend(raster.vectors(vec(spark, d), "vec_id", "embedding"), ["vec"], "x", "median").select("vec", "pos", r6(F.col("x"), "x"))


@query("histogram_complex", "with b as (select min(re) as rl, max(re) as rh, min(im) as il, max(im) as ih from ev) select 're' as part, cast(least(floor((re - rl) / ((rh - rl) / 16)), 15) as bigint) as bin, count(*) as n from ev, b where re is not null group by 2 union all select 'im', cast(least(floor((im - il) / ((ih - il) / 16)), 15) as bigint), count(*) from ev, b where im is not null group by 2", "ev")
def histogram_complex(spark, d):
    """AGG-06: real and imaginary parts."""
    return spectral.histogram(ev(spark, d), ["re", "im"], 16)


# --- spectra -----------------------------------------------------------------------------------------------------

_DFT32 = "dft as (select vec, k, sum(x * cos(2 * pi() * k * pos / 64)) as re, -sum(x * sin(2 * pi() * k * pos / 64)) as im from vec, (select unnest(range(0, 64)) as k) group by vec, k)"


def _pairs(spark, d) -> DataFrame:
    v = vec(spark, d).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("a"))
    odd = v.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return v.where("vec_id % 2 = 0").join(odd, "vec_id")


@query("cross_db", f"with {_DFT32}, z as (select a.vec // 20 as grp, a.k, avg(a.re * b.re + a.im * b.im) as re, avg(a.im * b.re - a.re * b.im) as im from dft a join dft b on b.vec = a.vec + 1 and a.k = b.k where a.vec % 2 = 0 group by 1, 2) select grp, k, {s6('10 * log10(sqrt(re * re + im * im) + 1e-12)', 'db')}, case when abs(im) < 1e-9 * abs(re) then (case when re < 0 then 3.0 else 0.0 end)::double else {s6('atan2(im, re)', 'x').rpartition(' as ')[0]} end as phase from z", "vec")
def cross_db(spark, d):
    """DSP-07: magnitude in dB and phase of averaged cross spectra. Where the spectrum is real, rounding decides between pi and -pi: 3 stands for both."""
    z = spectral.cross_spectrum(_pairs(spark, d), "vec_id", "a", "b")
    mean = z.groupBy(div(F.col("vec_id"), 20).alias("grp"), "k").agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
    real = mean.select("grp", "k", (F.abs("im") < 1e-9 * F.abs("re")).alias("real"), "re")
    out = spectral.cross_db(z, div(F.col("vec_id"), 20)).join(real, ["grp", "k"])
    phase = F.when(F.col("real"), F.when(F.col("re") < 0, 3.0).otherwise(0.0)).otherwise(F.round("phase", 6) + F.lit(0.0))
    return out.select("grp", "k", r6(F.col("db"), "db"), phase.alias("phase"))


@query("lag_correlation", f"select lag, {s6('sum(a.x / 1e5 * b.x / 1e5)', 'r')} from (select unnest(range(-6, 7)) as lag) l, ord a join ord b on b.sample_idx = a.sample_idx + l.lag group by lag", "ord")
def lag_correlation(spark, d):
    """DSP-18: the correlation of a signal with itself for lags of six samples either way."""
    x = ord_(spark, d).select("sample_idx", (F.col("x") / 1e5).alias("a"), (F.col("x") / 1e5).alias("b"))
    return spectral.lag_of(x, "a", "b", 6).select(F.col("lag").cast("long").alias("lag"), r6(F.col("r"), "r"))


@query("residual_frequency")
def residual_frequency(spark, d):
    """DSP-18: the residual frequency of neighbouring vectors; tests hold it against numpy."""
    out = spectral.residual_frequency(_pairs(spark, d), "vec_id", "a", "b", 1, 30, 64, 1e6, 3.0)
    return out.select("vec_id", "peak_k", r6(F.col("hz"), "hz"), r6(F.col("snr_db"), "snr_db"), "found")


# --- listings ----------------------------------------------------------------------------------------------------


@query("files_reverse", "select path, row_number() over (order by key_ms desc, path desc) as place from fil", "fil")
def files_reverse(spark, d):
    """SRT-02: every file with its place, last first."""
    return catalog.places(fil(spark, d), [F.desc("key_ms"), F.desc("path")], scratch(spark)).select("path", F.col("place").cast("long").alias("place"))


@query("files_once", "select path, min(size) as size from (select path, size from fil union all select path, size + 1 from fil where size % 3 = 0) group by path", "fil")
def files_once(spark, d):
    """SRT-09: files that are told of twice, once."""
    f = fil(spark, d).select("path", "size")
    return catalog.once(f.unionByName(f.where("size % 3 = 0").withColumn("size", F.col("size") + 1)))


_TRIGGER = "5-LOW"


@query("expire_size_event", f"with m as (select grp, max((key_ms, path)) as top from fil where grp <> '{_TRIGGER}' group by grp), f as (select fil.*, m.grp is not null as newest, fil.grp = '{_TRIGGER}' as own from fil left join m on m.grp = fil.grp and m.top = (fil.key_ms, fil.path)), c as (select *, sum(size) over (order by key_ms desc, own, path desc rows unbounded preceding) as t from f where not newest) select grp, key_ms, size, path from c where t > 30000000 - (select sum(size) from f where newest)", "fil")
def expire_size_event(spark, d):
    """SRT-07: what goes when a file of one group has come, on times that many files share: that group's go first, and its newest may go."""
    return catalog.expired_by_size(fil(spark, d), 30_000_000, _TRIGGER)


@query("files_watch", "select path, case when cast(path as bigint) % 5 = 0 then 'created' when cast(path as bigint) % 7 = 0 then 'deleted' else 'modified' end as event from fil where cast(path as bigint) % 5 = 0 and cast(path as bigint) % 7 <> 0 or cast(path as bigint) % 5 <> 0 and cast(path as bigint) % 7 = 0 or cast(path as bigint) % 35 <> 0 and cast(path as bigint) % 11 = 0", "fil")
def files_watch(spark, d):
    """Watch: what changed between two listings."""
    f = fil(spark, d).select("path", "size", F.col("key_ms").alias("mtime"), F.col("path").cast("long").alias("p"))
    old, new = f.where("p % 5 <> 0"), f.where("p % 7 <> 0")
    new = new.withColumn("size", F.when(F.col("p") % 11 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return catalog.changes(old, new)


@query("events_in_time", "select path, key_ms from (select path, case when size % 10 = 0 then null else key_ms end as key_ms from fil) where key_ms is null or key_ms between 852076800000 and 883612800000", "fil")
def events_in_time(spark, d):
    """PRJ-10: events in a time range; those without a time pass."""
    f = fil(spark, d).select("path", F.when(F.col("size") % 10 != 0, F.col("key_ms")).alias("key_ms"))
    return catalog.in_time(f, 852076800000, 883612800000)


@query("file_kinds", "select path, case cast(path as bigint) % 5 when 0 then 'data' when 1 then 'metadata' when 2 then 'properties' end as kind, 'ch' || (size % 4) as channel from fil where cast(path as bigint) % 5 < 3", "fil")
def file_kinds(spark, d):
    """PRJ-05, PRJ-06, STR-01, STR-03, SET-02: names of each kind, in progress and foreign, told apart."""
    from sigloom.functions import timebase

    p, sec = F.col("path").cast("long"), F.col("path")
    name = F.when(p % 5 == 0, F.concat(F.lit("rf@"), sec, F.lit(".250.h5"))).when(p % 5 == 1, F.concat(F.lit("metadata@"), sec, F.lit(".h5"))).when(p % 5 == 2, "drf_properties.h5")
    name = name.when(p % 5 == 3, F.concat(F.lit("tmp.rf@"), sec, F.lit(".250.h5"))).otherwise("notes.txt")
    full = F.concat(F.lit("/data/ch"), (F.col("size") % 4).cast("string"), F.lit("/2024-01-01T00-00-00/"), name)
    f = fil(spark, d).select("path", full.alias("full")).select("path", timebase.file_kind(F.element_at(F.split("full", "/"), -1)).alias("kind"), catalog.channel_of(F.col("full")).alias("channel"))
    return catalog.of_kinds(f)


# --- streams -----------------------------------------------------------------------------------------------------


@query("files_moves", "with p as (select path, grp, size, cast(path as bigint) as p from fil) select case when p % 5 = 0 then 'moved' when p % 7 = 0 then 'deleted' when p % 11 = 0 then 'modified' else 'created' end as event, case when p % 5 <> 0 and p % 7 <> 0 and p % 11 <> 0 then 'new/' || path else path end as path, case when p % 5 = 0 then grp || '/' || path end as dest from p where p % 5 = 0 or p % 7 = 0 or p % 11 = 0 or p % 13 = 0", "fil")
def files_moves(spark, d):
    """Watch: what was created, deleted, modified and moved between two listings, moves told by content."""
    f = fil(spark, d).select("path", "grp", "size", F.col("key_ms").alias("mtime"), F.sha2("path", 256).alias("mark"), F.col("path").cast("long").alias("p"))
    own = f.drop("grp", "p")
    stays = f.where("p % 5 = 0 or p % 7 <> 0").withColumn("mtime", F.when((F.col("p") % 5 != 0) & (F.col("p") % 11 == 0), F.col("mtime") + 1).otherwise(F.col("mtime")))
    here = stays.withColumn("path", F.when(F.col("p") % 5 == 0, F.concat_ws("/", "grp", "path")).otherwise(F.col("path")))
    fresh = f.where("p % 13 = 0 and p % 5 <> 0 and p % 7 <> 0 and p % 11 <> 0")
    more = fresh.select(F.concat(F.lit("new/"), "path").alias("path"), "size", "mtime", F.sha2(F.concat(F.lit("new/"), "path"), 256).alias("mark"))
    return watching.events(own, here.select(own.columns).unionByName(more))


def _stream(spark, d) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    s = ingest.source(spark, f"{d}/event[s].parquet", schema)
    return s.select(F.col("event_type").alias("channel"), F.col("event_id").alias("sample_idx"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("re"))


def _windows(spark, d, windows) -> DataFrame:
    """What windows of a stream over all events give in append mode: three files in order of time and one that moves the clock on, a restart before each."""
    path, out, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    e = spark.read.parquet(f"{d}/events.parquet")
    rows = e.select(F.col("event_type").alias("channel"), F.col("event_id").alias("sample_idx"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("re"))
    us = F.unix_micros("ts")
    low, high = rows.agg(F.min(us), F.max(us)).first()
    low, high = low or 0, high or 0
    third = (high - low) // 3
    clock = spark.range(1).select(F.lit("~clock").alias("channel"), F.lit(0).cast("long").alias("sample_idx"), F.timestamp_micros(F.lit(high + 10 * 86_400_000_000)).alias("ts"), F.lit(0.0).alias("re"))
    at = F.least(F.lit(2), F.floor((us - low) / F.lit(max(1, third))))
    for files in (*(rows.where(at == k) for k in range(3)), clock):
        files.write.mode("append").parquet(path)
        ingest.sink(windows(ingest.source(spark, path, rows.schema, files_at_once=1 << 30)), out, checkpoint)
    return spark.read.parquet(out).where("channel <> '~clock'")


@query("stream_tumbling", "select channel, sample_idx // 500 as raster, count(*) as n, round(sum(re), 4) + 0.0 as total from ev group by 1, 2", "ev")
def stream_tumbling(spark, d):
    """AGG-03 over a stream: tumbling rasters by sample index, put out once when the watermark has passed a raster's day."""
    return _windows(spark, d, lambda x: ingest.raster_sums(x, 500)).groupBy("channel", "raster").agg(F.sum("n").alias("n"), (F.round(F.sum("total"), 4) + 0.0).alias("total"))


@query("stream_sliding", "select event_type as channel, (epoch_us(ts) // 21600000000 - k) * 21600000000 as start_us, count(*) as n, round(sum(value), 4) + 0.0 as total from events, (select unnest(range(0, 4)) as k) group by 1, 2")
def stream_sliding(spark, d):
    """Sliding windows of a day every six hours over a stream, put out once when the watermark has passed their ends."""
    return _windows(spark, d, lambda x: ingest.sliding_sums(x, "1 day", "6 hours")).select("channel", F.unix_micros("w.start").alias("start_us"), "n", (F.round("total", 4) + 0.0).alias("total"))


@query("stream_sessions", "select channel, min(us) as start_us, max(us) + 1800000000 as end_us, count(*) as n from (select *, sum(case when us - p < 1800000000 then 0 else 1 end) over (partition by channel order by us rows unbounded preceding) as s from (select event_type as channel, epoch_us(ts) as us, lag(epoch_us(ts)) over (partition by event_type order by ts) as p from events)) group by channel, s")
def stream_sessions(spark, d):
    """Session windows over a stream: half an hour without samples closes one, which is put out once."""
    return _windows(spark, d, lambda x: ingest.sessions(x, "30 minutes")).select("channel", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")


@query("stream_blocks", "select channel, block_start, n from isl", "ev isl")
def stream_blocks(spark, d):
    """AGG-01 over a stream, with the last block of a channel's stretch as its state."""
    at = scratch(spark)
    q = ingest.blocks_of(_stream(spark, d)).writeStream.outputMode("update").foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{at}/batch={k}"))
    q.option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start().awaitTermination()
    return blocks.merge_blocks(spark.read.parquet(at).groupBy("channel", "block_start").agg(F.max("n").alias("n")))


@query("stream_tags", "select event_id as pos, case when event_id < 100 then event_id + 10 when event_id < 700 then event_id + 50 else event_id + 1000 end as sample_idx from events")
def stream_tags(spark, d):
    """SNK-11: samples split into blocks by time tags; one that goes backwards is dropped."""
    pos = ev(spark, d).select(F.col("sample_idx").alias("pos"))
    tags = spark.createDataFrame([(0, 10), (100, 150), (300, 20), (700, 1700)], "pos long, sample_idx long")
    return ingest.forward_tags(pos, tags)




# --- live streams --------------------------------------------------------------------------------------------------

_ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Arrivals of the live queries: files that hold the events in order, a fifth each, and files for what comes after.
_FILES = 5


def arrivals(spark, d) -> DataFrame:
    """Events as packets of one sample with their file of arrival: every 11th comes a file late, every 7th a second time, every 53rd three files
    late, when its time is over. Every 1000th has a time tag ten samples on, some go backwards; every 97th and 131st change a field."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("channel"), F.col("event_id").alias("pos"), F.array("value").alias("data"))
    n = e.agg((F.max("pos") + 1).alias("n"))
    i = F.col("pos")
    tag = F.when(i % 1000 < 8, i + 10 * div(i, 1000)).when(i % 1700 == 9, i - 5)
    one = lambda m, name: F.when(i % m == 0, F.concat(F.lit(f'"{name}": '), i.cast("string")))
    fields = F.when((i % 97 == 0) | (i % 131 == 0), F.concat(F.lit("{"), F.concat_ws(", ", one(97, "freq"), one(131, "gain")), F.lit("}")))
    file = div(i * _FILES, F.col("n")) + F.when(i % 53 == 1, 3).when(i % 11 == 3, 1).otherwise(0)
    # a file is an hour of event time, of the second day: Spark takes the very first instant as late
    ts = F.timestamp_micros(F.lit(86_400_000_000) + div(i * F.lit(3_600_000_000 * _FILES), F.col("n")))
    rows = e.crossJoin(F.broadcast(n)).select("channel", "pos", ts.alias("ts"), "data", tag.alias("tag"), fields.alias("metadata"), file.alias("file"))
    twice = rows.where((i % 7 == 0) & (i % 53 != 1)).withColumn("file", F.col("file") + 1)
    clock = spark.range(_FILES, _FILES + 5).select(F.lit("~clock").alias("channel"), F.col("id").alias("pos"), F.timestamp_seconds((F.col("id") + 26) * 3600).alias("ts"), F.array(F.lit(0.0)).alias("data"), F.lit(None).cast("long").alias("tag"), F.lit(None).cast("string").alias("metadata"), F.col("id").alias("file"))
    return rows.unionByName(twice).unionByName(clock)


def arrive(rows: DataFrame, path: str, files: range) -> None:
    """Write the arrivals of these files, one after the other; all are made once, dealt out by file."""
    made = scratch(rows.sparkSession)
    rows.write.partitionBy("file").parquet(made)
    dealt = rows.sparkSession.read.schema(rows.schema).parquet(made)
    for k in files:
        dealt.where(F.col("file") == k).drop("file").coalesce(1).write.mode("append").parquet(path)


def run_live(spark, path: str, out: str, checkpoint: str, **options) -> None:
    """The live sink over the packets at path, a file a batch, from where the checkpoint stands."""
    from sigloom.streaming import live

    before = spark.conf.get(_ROCKS[0], None)
    spark.conf.set(*_ROCKS)
    try:
        schema = "channel string, pos long, ts timestamp, data array<double>, tag long, metadata string"
        packets = ingest.source(spark, path, schema, files_at_once=1)
        ingest.sink(live.live_sink(packets, "90 minutes", **options), out, checkpoint)
    finally:
        spark.conf.set(_ROCKS[0], before) if before else spark.conf.unset(_ROCKS[0])


_LIVE = """here as (select event_type as channel, event_id as pos, value as re from events where event_id % 53 <> 1),
tagged as (select *, case when pos % 1000 < 8 then 10 * (pos // 1000) when pos % 1700 = 9 then -5 end as shift, row_number() over (partition by channel order by pos) as k from here),
placed as (select *, pos + coalesce(max(case when k > 1 or shift is not null then shift end) over (partition by channel order by pos), 0) as idx,
    case when pos % 97 = 0 then pos end as f, case when pos % 131 = 0 then pos end as g from (select channel, pos, re, k, case when k > 1 and shift < 0 then null else shift end as shift from tagged)),
steps as (select *, lag(idx) over w + 1 as due, last_value(f ignore nulls) over w as freq, last_value(g ignore nulls) over w as gain from placed window w as (partition by channel order by pos))
"""


@query(
    "stream_live",
    f"""with {_LIVE}
select channel, 'data' as kind, idx as sample_idx, cast(1 as bigint) as n, re, cast(null as varchar) as metadata from steps
union all select channel, 'zeros', due, idx - due, null, null from steps where idx > due
union all select channel, 'metadata', idx, null, null,
    '{{' || concat_ws(', ', case when freq is not null then '"freq": ' || freq end, case when gain is not null then '"gain": ' || gain end) || '}}'
from steps where due is null or idx > due or f is not null or g is not null""",
)
def stream_live(spark, d):
    """SNK-11, SRC-23, stateful streams with late data: packets out of order, twice, late and never, through a live sink in append mode, a file a batch."""
    path, out = scratch(spark), scratch(spark)
    arrive(arrivals(spark, d), path, range(_FILES + 5))
    run_live(spark, path, out, scratch(spark))
    got = spark.read.parquet(out).where("channel <> '~clock'")
    return got.select("channel", "kind", "sample_idx", "n", F.get("data", F.lit(0)).alias("re"), "metadata")


# --- several roots -------------------------------------------------------------------------------------------------


def three_roots(spark, d) -> list[str]:
    """Orders in three roots that disagree: two thirds of them as they are; runs of two in five negated; the middle doubled."""
    x, roots = ord_(spark, d).withColumnRenamed("x", "re"), []
    high = x.agg(F.max("sample_idx")).first()[0]
    i = F.col("sample_idx")
    for own in (x.where(i % 30 < 20), x.where(i % 5 < 2).withColumn("re", -F.col("re")), x.where(i.between(high // 4, high // 2)).withColumn("re", 2 * F.col("re"))):
        s = Store(spark, scratch(spark))
        s.create("ord", "f64", (NUM, DEN), 200 * SUBDIR_S, 100 * FILE_MS)
        s.append(own, "ord")
        roots.append(s.root)
    return roots


_ROOTS = """held as (
    select o_orderkey as i, o_totalprice as x, o_orderkey % 30 < 20 as a, o_orderkey % 5 < 2 as b,
        o_orderkey between (select max(o_orderkey) from orders) // 4 and (select max(o_orderkey) from orders) // 2 as c from orders
)"""


@query("multi_root_conflict", f"with {_ROOTS} select i as sample_idx, case when c then 2 * x when b then -x else x end as v, case when c then 2 when b then 1 else 0 end as root from held where a or b or c")
def multi_root_conflict(spark, d):
    """SRC-01, SET-01: three roots hold overlapping parts with other values; the last root's count."""
    from sigloom.sources.roots import Roots

    r = Roots(spark, three_roots(spark, d), strict=False)
    return r.read("ord", *r.bounds("ord"))


@query(
    "multi_root_held",
    f"""with {_ROOTS}, marked as (select i, concat_ws(',', case when a then '0' end, case when b then '1' end, case when c then '2' end) as holders from held where a or b or c)
select holders, min(i) as block_start, count(*) as n from (select *, i - row_number() over (partition by holders order by i) as g from marked) group by holders, g""",
)
def multi_root_held(spark, d):
    """SRC-26: which roots hold what, by a sweep over their index columns."""
    from sigloom.sources.roots import Roots

    return Roots(spark, three_roots(spark, d), strict=False).held("ord")


@query("multi_root_blocks", f"with {_ROOTS} select 'ord' as channel, min(i) as block_start, count(*) as n from (select i, i - row_number() over (order by i) as g from held where a or b or c) group by g")
def multi_root_blocks(spark, d):
    """SRC-08 over three roots: each sample once."""
    from sigloom.sources.roots import Roots

    return Roots(spark, three_roots(spark, d), strict=False).blocks("ord")


@query("decimate_zero_phase")
def decimate_zero_phase(spark, d):
    """DSP-09: events' channels, gaps and all, at a quarter of their rate by a recursive filter without delay; held against numpy by a test."""
    from sigloom.operators import recursive

    x = ev(spark, d).select("channel", "sample_idx", F.col("re").alias("x"))
    return recursive.decimate_zero_phase(x, 4, path=scratch(spark))


@query("robust_polynomial")
def robust_polynomial(spark, d):
    """DSP-19: each vector's curve by a polynomial that leaves out what its residual's slope rejects; held against numpy by a test."""
    from sigloom.operators import robust

    points = raster.vectors(vec(spark, d), "vec_id", "embedding").select(F.col("vec").alias("channel"), F.col("pos").alias("k"), F.col("x").alias("y"))
    return robust.polynomials(points, scratch(spark)).select("channel", "k", r6(F.col("fit"), "fit"), "gone")


_TAPS = signal.equiripple(0.2, 0.2, 50)
_HALF = len(_TAPS) // 2


def _around(k: int) -> str:
    return "x" if k == _HALF else f"lag(x, {_HALF - k}) over w" if k < _HALF else f"lead(x, {k - _HALF}) over w"


@query("decimate_centred", "select sample_idx // 4 as sample_idx, round(y, 4) + 0.0 as y from (select sample_idx, " + " + ".join(f"({t!r}::double) * {_around(k)}" for k, t in enumerate(_TAPS)) + " as y from ord window w as (order by sample_idx)) where sample_idx % 4 = 0 and y is not null", "ord")
def decimate_centred(spark, d):
    """DSP-09, DSP-11, DSP-12: orders at a quarter of their rate by an equiripple filter, its delay taken back."""
    return filters.decimate_centred(ord_(spark, d), _TAPS, 4).select("sample_idx", (F.round("y", 4) + F.lit(0.0)).alias("y"))


# --- stripes and two frequencies ---------------------------------------------------------------------------------

_BINNED = "bin as (select channel, sample_idx // 16 as i, avg(re) as re, avg(im) as im from ev group by channel, sample_idx // 16)"


def binned(spark, d) -> DataFrame:
    """Events' channels as means of 16 indexes: where a channel has none of them there is a gap."""
    rows = ev(spark, d).groupBy("channel", div(F.col("sample_idx"), 16).alias("sample_idx"))
    return rows.agg(F.avg("re").alias("re"), F.avg("im").alias("im"))


@query(
    "sti_stripes",
    f"""with {_BINNED},
here as (select channel, i, re, im, unnest(range(greatest((i - 4) // 12, 0), i // 12 + 1)) as s from bin),
cut as (select channel, s, count(*) = 16 as whole from here where i - s * 12 between 0 and 15 group by channel, s),
every as (select channel, unnest(range(min(s), max(s) + 1)) as s from cut group by channel),
piece as (select channel, s, j.j as j, i - s * 12 - j.j * 4 as p, re, im from here, (select unnest([0, 1, 2]) as j) j where i - s * 12 - j.j * 4 between 0 and 7),
level as (select *, re - avg(re) over w as x, im - avg(im) over w as y from piece window w as (partition by channel, s, j)),
dft as (
    select channel, s, j, k.k as k, sum((0.5 - 0.5 * cos(pi() * p / 4)) * (x * cos(pi() * k.k * p / 4) + y * sin(pi() * k.k * p / 4))) as a,
        sum((0.5 - 0.5 * cos(pi() * p / 4)) * (y * cos(pi() * k.k * p / 4) - x * sin(pi() * k.k * p / 4))) as b
    from level, (select unnest(range(-4, 4)) as k) k group by channel, s, j, k.k
),
power as (select channel, s, k, avg(a * a + b * b) / 16 as p from dft group by channel, s, k)
select e.channel, e.s * 12 as start, k.k as k, k.k / 8.0::double as hz, coalesce(c.whole, false) as whole, case when c.whole then round(10 * log10(p + 1e-20), 4) + 0.0 end as db
from every e cross join (select unnest(range(-4, 4)) as k) k left join cut c on c.channel = e.channel and c.s = e.s
left join power p on p.channel = e.channel and p.s = e.s and p.k = k.k""",
    "ev",
)
def sti_stripes(spark, d):
    """DSP-05, DSP-04, WIN-05: overlapping stripes of gappy channels, means taken off, the axis shifted; null stands for the NaN of stripes with gaps."""
    from sigloom.operators import stripes

    out = stripes.spectra(binned(spark, d), 16, 12, 8, mean=True)
    return out.select("channel", "start", "k", "hz", (~F.isnan("db")).alias("whole"), F.when(~F.isnan("db"), F.round("db", 4) + F.lit(0.0)).alias("db"))


@query(
    "tec_two_frequencies",
    f"""with {_BINNED},
two as (select a.channel, a.i, a.re as re0, a.im as im0, b.re as re1, b.im as im1 from bin a join bin b on a.i = b.i and b.channel = 'click' where a.channel <> 'click'),
here as (select *, unnest(range(greatest((i - 2) // 8, 0), i // 8 + 1)) as m from two),
cut as (select channel, m from here where i - m * 8 between 0 and 9 group by channel, m having count(*) = 10),
piece as (select h.*, j.j as j, i - m * 8 - j.j * 2 as p from here h semi join cut using (channel, m), (select unnest([0, 1, 2, 3]) as j) j where i - m * 8 - j.j * 2 between 0 and 3),
dft as (
    select channel, m, j, k.k as k, sum(w * (re0 * c + im0 * s)) as a0, sum(w * (im0 * c - re0 * s)) as b0, sum(w * (re1 * c + im1 * s)) as a1, sum(w * (im1 * c - re1 * s)) as b1
    from (select piece.*, k, 0.5 - 0.5 * cos(pi() * p / 2) as w, cos(pi() * k * p / 2) as c, sin(pi() * k * p / 2) as s from piece, (select unnest([0, 1, 2, 3]) as k)) k
    group by channel, m, j, k.k
),
turn as (
    select x.channel, x.m, atan2(x.b0 * y.a0 - x.a0 * y.b0, x.a0 * y.a0 + x.b0 * y.b0) as t0, atan2(x.b1 * y.a1 - x.a1 * y.b1, x.a1 * y.a1 + x.b1 * y.b1) as t1
    from dft x join dft y on x.channel = y.channel and x.m = y.m and y.j = x.j + 1 where x.k = 0 and y.k = 0
),
steps as (select channel, m, avg(t0) * 8 / 3 - avg(t1) as step, var_pop(t0) + var_pop(t1) as spread from turn group by channel, m),
power as (select channel, m, k, sum(a0 * a0 + b0 * b0) as p0, sum(a1 * a1 + b1 * b1) as p1 from dft where j < 3 group by channel, m, k),
snr as (select channel, m, max(case when k = 0 then p0 end) / median(p0) as snr0, max(case when k = 0 then p1 end) / median(p1) as snr1 from power group by channel, m),
good as (select *, m - row_number() over (partition by channel order by m) as g from steps join snr using (channel, m) where snr0 > 2 and snr1 > 2),
sums as (
    select *, sum(step) over w as phase, sum(spread) over w as total, min(m) over (partition by channel, g) as run, stddev_pop(snr0) over (partition by channel, g order by m rows between 3 preceding and 2 following) as sd
    from good window w as (partition by channel, g order by m rows unbounded preceding)
),
scale as (select 299792458.0 / (40.308e16 * 4 * pi() * pi()) / (2 * pi() * 400e6 / (2 * pi() * 150e6) ** 2 - 1 / (2 * pi() * 400e6)) as c)
select channel, m as stripe, run, round(phase, 6) + 0.0 as phase, round(c * (phase - min(phase) over (partition by channel, run)), 6) + 0.0 as tec,
    round(c * sqrt(6 * total), 6) + 0.0 as tec_sigma, round(sd / median(snr0) over (partition by channel), 6) + 0.0 as s4 from sums, scale""",
    "ev",
)
def tec_two_frequencies(spark, d):
    """DSP-20: electron content and scintillation of each channel beside click, through gaps and drops of the signal."""
    from sigloom.operators import dualfreq

    x = binned(spark, d)
    low = x.where("channel <> 'click'").select("channel", "sample_idx", F.col("re").alias("re0"), F.col("im").alias("im0"))
    high = x.where("channel = 'click'").select("sample_idx", F.col("re").alias("re1"), F.col("im").alias("im1"))
    steps = dualfreq.phase_steps(low.join(high, "sample_idx"), 4, 3, 2, 400 / 150)
    out = dualfreq.electron_content(steps, scratch(spark), 150e6, 400e6, 2 * 3, 3, least=2.0)
    return out.select("channel", "stripe", "run", *[r6(F.col(c), c) for c in ("phase", "tec", "tec_sigma", "s4")])


# --- sounding ------------------------------------------------------------------------------------------------------


def _periods(spark, d) -> DataFrame:
    """Each vector as a code period."""
    return vec(spark, d).select(F.lit("rx").alias("channel"), F.col("vec_id").cast("long").alias("segment"), F.col("embedding").cast("array<double>").alias("x"))


@query("prc_whitened")
def prc_whitened(spark, d):
    """DSP-15: whitened Doppler spectra; held against numpy by a test."""
    from sigloom.operators import sounder

    out = sounder.analyses(_periods(spark, d), spectral.random_code(64, 0), 8, 16)
    return out.select("block", "range", "k", r6(F.col("power"), "power"))


@query("prc_online")
def prc_online(spark, d):
    """DSP-16: the same as a stream that stops between its files and goes on; tests hold it against the table's."""
    from sigloom.operators import sounder

    path, out, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    periods = _periods(spark, d)
    last = periods.agg(F.max("segment")).first()[0] or 0
    early = F.col("segment") <= last // 2
    # a period of the far future moves the clock on; its own analysis is never whole
    clock = spark.createDataFrame([("~clock", last + 64, [0.0] * 64)], periods.schema)
    for files in (periods.where(early), periods.where(~early), clock):
        files.write.mode("append").parquet(path)
        got = sounder.analyses(ingest.source(spark, path, periods.schema, files_at_once=1 << 30), spectral.random_code(64, 0), 8, 16)
        ingest.sink(got, out, checkpoint)
    return spark.read.parquet(out).select("block", "range", "k", r6(F.col("power"), "power"))
