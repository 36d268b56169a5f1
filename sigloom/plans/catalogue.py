"""The engine's queries over the test tables, seen as signals, and the SQL that gives the same rows.

Views: ev (events as five channels with natural gaps), vec (embeddings as fixed-length vectors), ord (orders as one gap-free
signal), fil (orders as a file catalogue). IDs in the docstrings are those of the coverage list.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions import signal, timebase
from sigloom.functions.timebase import div
from sigloom.operators import blocks, catalog, filters, metadata, raster, spectral
from sigloom.sources.store import Store
from sigloom.streaming import ingest

NUM, DEN, SUBDIR_S, FILE_MS = 200, 3, 2, 400
_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}
CTE = {
    "ev": "ev as (select event_type as channel, event_id as sample_idx, value as re, cast(json_extract_string(props, '$.k') as double) as im from events)",
    "evt": f"evt as (select event_id, epoch_us(ts) // 1000000 as s, epoch_us(ts) as us, (epoch_us(ts) // {1000000 * DEN}) * {NUM} + ((epoch_us(ts) % {1000000 * DEN}) * {NUM}) // {1000000 * DEN} as i from events)",
    "vec": "vec as (select cast(vec_id as bigint) as vec, cast(u.i - 1 as bigint) as pos, cast(embedding[u.i] as double) as x from embeddings, (select unnest(range(1, 65)) as i) u)",
    "ord": "ord as (select o_orderkey as sample_idx, o_totalprice as x from orders)",
    "fil": "fil as (select o_orderpriority as grp, epoch_ms(o_orderdate) as key_ms, cast(floor(o_totalprice) as bigint) as size, cast(o_orderkey as varchar) as path from orders)",
    "isl": "isl as (select channel, min(sample_idx) as block_start, count(*) as n from (select channel, sample_idx, sample_idx - row_number() over (partition by channel order by sample_idx) as g from ev) group by channel, g)",
    "md": "md as (select channel, sample_idx, re as v from ev where im < 10)",
}


def query(name: str, sql: str | None = None, uses: str = ""):
    """Register a query; sql follows the named views."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _QUERIES[name] = f
        if sql:
            views = ", ".join(CTE[u] for u in uses.split())
            _ORACLES[name] = f"with {views} {sql}" if views and not sql.startswith("with ") else (f"with {views}, {sql[5:]}" if views else sql)
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_ORACLES)


def r6(c, name: str):
    """Six decimals without a negative zero."""
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


def s6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 as {name}"


def ev(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("channel"), F.col("event_id").alias("sample_idx"), F.col("value").alias("re"), F.get_json_object("props", "$.k").cast("double").alias("im"))


def evt(spark, d) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", us.alias("us"), timebase.micros_to_sample(us, NUM, DEN).alias("i"))


def vec(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


def ord_(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("sample_idx"), F.col("o_totalprice").alias("x"))


def fil(spark, d) -> DataFrame:
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("grp"), ms.alias("key_ms"), F.floor("o_totalprice").cast("long").alias("size"), F.col("o_orderkey").cast("string").alias("path"))


def md(spark, d) -> DataFrame:
    return ev(spark, d).where("im < 10").select("channel", "sample_idx", F.col("re").alias("v"))


def scratch(spark) -> str:
    """A new path in the folder that all executors share; a local one only where there is one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names the shared folder of a cluster")
        base = tempfile.mkdtemp(prefix="sigloom-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


# --- time base ---------------------------------------------------------------------------------------------------

_SEC = f"(i // {NUM}) * {DEN} + ((i % {NUM}) * {DEN}) // {NUM}"
_REM = f"((i % {NUM}) * {DEN}) % {NUM}"
_MS = f"((({_SEC}) * 1000 + ({_REM} * 1000) // {NUM}) // {FILE_MS}) * {FILE_MS}"


@query("sample_time", f"select event_id, i as sample_idx, {_SEC} as sec, {_REM} * {10**12 // NUM} as ps, epoch_us(ts) as us from (select *, make_timestamp(({_SEC}) * 1000000 + ({_REM} * {10**12 // NUM}) // 1000000) as ts from evt)", "evt")
def sample_time(spark, d):
    """TIME-01, TIME-03, TIME-06."""
    sec, ps = timebase.sample_seconds(F.col("i"), NUM, DEN)
    return evt(spark, d).select("event_id", F.col("i").alias("sample_idx"), sec.alias("sec"), ps.alias("ps"), F.unix_micros(timebase.sample_timestamp(F.col("i"), NUM, DEN)).alias("us"))


@query("time_to_sample", f"select event_id, i as floor_idx, ((us // 1000) // {1000 * DEN}) * {NUM} + (((us // 1000) % {1000 * DEN}) * {NUM} + {1000 * DEN - 1}) // {1000 * DEN} as ceil_idx from evt", "evt")
def time_to_sample(spark, d):
    """TIME-02, TIME-05, TIME-07, TIME-12."""
    ms = div(F.col("us"), 1000) * 1000
    return evt(spark, d).select("event_id", F.col("i").alias("floor_idx"), timebase.micros_to_sample(ms, NUM, DEN, up=True).alias("ceil_idx"))


@query("sample_file_path", f"select event_id, strftime(make_timestamp((ms // {1000 * SUBDIR_S}) * {SUBDIR_S} * 1000000), '%Y-%m-%dT%H-%M-%S') as subdir, printf('rf@%d.%03d.h5', ms // 1000, ms % 1000) as name from (select event_id, {_MS} as ms from evt)", "evt")
def sample_file_path(spark, d):
    """TIME-10, SNK-04."""
    folder, name = timebase.file_path(F.col("ms"), SUBDIR_S)
    return evt(spark, d).select("event_id", timebase.file_millis(F.col("i"), NUM, DEN, FILE_MS).alias("ms")).select("event_id", folder.alias("subdir"), name.alias("name"))


@query("file_name_parse", f"select event_id, {_MS} as key_ms, 'data' as kind from evt", "evt")
def file_name_parse(spark, d):
    """TIME-11, STR-01, PRJ-05: names made and read back."""
    names = sample_file_path(spark, d)
    return names.select("event_id", timebase.file_key(F.col("name")).alias("key_ms"), timebase.file_kind(F.col("name")).alias("kind"))


@query("roundtrip_floor_ceil", "select count(*) as n, cast(0 as bigint) as wrong from evt", "evt")
def roundtrip_floor_ceil(spark, d):
    """TIME-02 after TIME-01, on microseconds rounded up."""
    sec, ps = timebase.sample_seconds(F.col("i"), NUM, DEN)
    back = timebase.micros_to_sample(sec * 1_000_000 + div(ps + 999_999, 1_000_000), NUM, DEN)
    return evt(spark, d).agg(F.count(F.lit(1)).alias("n"), F.sum((back != F.col("i")).cast("long")).alias("wrong"))


# --- scans and blocks --------------------------------------------------------------------------------------------


@query("channels", "select distinct channel from ev", "ev")
def channels(spark, d):
    """SRC-01, SRC-02."""
    return ev(spark, d).select("channel").distinct()


@query("bounds", "select channel, min(sample_idx) as first_sample, max(sample_idx) as last_sample from ev group by channel", "ev")
def bounds(spark, d):
    """SRC-09, SRC-18, AGG-02, SRT-03."""
    return blocks.bounds(ev(spark, d))


@query("range_scan", "select channel, min(sample_idx) as block_start, count(*) as n, round(sum(re), 4) as total from (select *, sample_idx - row_number() over (partition by channel order by sample_idx) as g from ev where sample_idx between 100 and 800) group by channel, g", "ev")
def range_scan(spark, d):
    """SRC-03, PRJ-03: samples of a range with the block that holds each."""
    got = blocks.between(ev(spark, d), 100, 800)
    own = blocks.islands(got).select("channel", "block_start", F.explode(F.sequence("block_start", F.col("block_start") + F.col("n") - 1)).alias("sample_idx"), "n")
    return got.join(own, ["channel", "sample_idx"]).groupBy("channel", "block_start", "n").agg(F.round(F.sum("re"), 4).alias("total"))


@query("continuous_blocks", "select channel, block_start, n from isl", "ev isl")
def continuous_blocks(spark, d):
    """SRC-08, AGG-01."""
    return blocks.islands(ev(spark, d))


@query("block_clip", "select channel, greatest(block_start, 150) as block_start, least(block_start + n - 1, 700) - greatest(block_start, 150) + 1 as n from isl where block_start <= 700 and block_start + n > 150", "ev isl")
def block_clip(spark, d):
    """PRJ-03 on blocks."""
    return blocks.clip(blocks.islands(ev(spark, d)), 150, 700)


@query("gap_list", "select channel, e as gap_start, block_start - e as gap_n from (select *, lag(block_start + n) over (partition by channel order by block_start) as e from isl) where block_start > e", "ev isl")
def gap_list(spark, d):
    """WIN-02."""
    return blocks.gaps(blocks.islands(ev(spark, d)))


@query("gap_fill", "select g.channel, g.i as sample_idx, coalesce(re, -1.0) as re, re is null as filled from (select channel, unnest(range(lo, hi + 1)) as i from (select channel, min(sample_idx) as lo, max(sample_idx) as hi from ev group by channel)) g left join ev on ev.channel = g.channel and ev.sample_idx = g.i", "ev")
def gap_fill(spark, d):
    """SNK-06, gapless streams: each channel from its first to its last sample."""
    return blocks.fill_bounds(ev(spark, d), F.lit(-1.0))


@query("gap_accounting", "select channel, cast(sum(n) as bigint) as total_samples, cast(max(block_start + n) - min(block_start) - sum(n) as bigint) as gap_samples, count(*) as n_blocks from isl group by channel", "ev isl")
def gap_accounting(spark, d):
    """AGG-14, SNK-09."""
    return blocks.gap_accounting(blocks.islands(ev(spark, d)))


@query("multi_root_union", "select channel, sample_idx, re from ev", "ev")
def multi_root_union(spark, d):
    """SET-01: three roots with shared samples, reunited."""
    e = ev(spark, d).select("channel", "sample_idx", "re")
    return blocks.union_roots([e.where(f"sample_idx % 3 = {k} or sample_idx % 7 = 0") for k in range(3)])


@query("overlap_check", "select channel, block_start, n, reach from (select *, max(block_start + n) over (partition by channel order by block_start, n rows between unbounded preceding and 1 preceding) as reach from (select channel, block_start, n from isl union all select channel, block_start, n + 1 from isl where block_start % 5 = 0)) where reach > block_start", "ev isl")
def overlap_check(spark, d):
    """SRC-25, SRC-26."""
    b = blocks.islands(ev(spark, d))
    return blocks.overlaps(b.unionByName(b.where("block_start % 5 = 0").withColumn("n", F.col("n") + 1)))


@query("vector_or_error", "select cast(sample_idx as bigint) as pos, x from ord where sample_idx between 10 and 109", "ord")
def vector_or_error(spark, d):
    """SRC-04, SRC-06: 100 samples as one vector, shown item by item."""
    s = ord_(spark, d).select(F.lit("ord").alias("channel"), "sample_idx", F.col("x").alias("re"))
    return blocks.read_vector(s, "ord", 10, 100).select(F.posexplode("vector").alias("p", "x")).select((F.col("p") + 10).cast("long").alias("pos"), "x")


@query("vector_cast", "select l_orderkey, cast(l_linenumber as double) as v from lineitem")
def vector_cast(spark, d):
    """SRC-05 for scalar types: every row."""
    return blocks.as_float(spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", F.col("l_linenumber").cast("int").alias("v")), "v")


@query("same_store", "select channel, sample_idx, re, 'a' as side from ev where sample_idx % 100 = 0", "ev")
def same_store(spark, d):
    """SET-04, JOIN-07: a store and a copy that lacks some rows."""
    e = ev(spark, d).select("channel", "sample_idx", "re")
    return blocks.same_store(e, e.where("sample_idx % 100 <> 0"))


@query("align_channels", "select a.sample_idx, a.x as re_a, b.x as re_b from ord a join ord b using (sample_idx) where a.sample_idx % 2 = 0 and b.sample_idx % 3 = 0", "ord")
def align_channels(spark, d):
    """JOIN-02."""
    o = ord_(spark, d).select("sample_idx", F.col("x").alias("re"), F.lit(0.0).alias("im"))
    return blocks.align(o.where("sample_idx % 2 = 0"), o.where("sample_idx % 3 = 0")).select("sample_idx", "re_a", "re_b")


@query("channel_pairs", "with c as (select channel, row_number() over (order by channel) - 1 as i from (select distinct event_type as channel from events)) select a.channel as a, b.channel as b from c a, c b where a.i < b.i")
def channel_pairs(spark, d):
    """JOIN-03."""
    names = sorted(r[0] for r in channels(spark, d).collect())
    return blocks.channel_pairs(spark.createDataFrame(list(enumerate(names)), "position int, channel string"), "combo")


@query("tag_attach", "select i.channel, block_start, e.sample_idx as \"offset\", e.sample_idx - block_start as \"at\", cast(im as varchar) as key from isl i join ev e on e.channel = i.channel and e.sample_idx >= block_start and e.sample_idx < block_start + n where im < 5", "ev isl")
def tag_attach(spark, d):
    """JOIN-04."""
    e = ev(spark, d)
    return blocks.attach_tags(blocks.islands(e), e.where("im < 5").select("channel", F.col("sample_idx").alias("offset"), F.col("im").cast("string").alias("key")))


@query("store_roundtrip", "select o_orderkey as sample_idx, o_totalprice as v from orders where o_orderkey between 25 and 1210")
def store_roundtrip(spark, d):
    """SNK-01..08, SRC-03: samples written in two appends to a new store, and a range of them read with pruned partitions."""
    s = Store(spark, scratch(spark))
    s.create("ord", "f64", (NUM, DEN), SUBDIR_S, FILE_MS)
    o = ord_(spark, d).withColumnRenamed("x", "re")
    s.append(o.where("sample_idx < 700"), "ord")
    s.append(o.where("sample_idx >= 700"), "ord", compression="gzip")
    return s.read("ord", 25, 1210)


@query("store_blocks", "select channel, block_start, n from isl", "ev isl")
def store_blocks(spark, d):
    """SRC-08 on stored chunks of every channel."""
    s, e, out = Store(spark, scratch(spark)), ev(spark, d), None
    for name in sorted(r[0] for r in channels(spark, d).collect()):
        s.create(name, "f64", (NUM, DEN), SUBDIR_S, FILE_MS)
        s.append(e.where(F.col("channel") == name).select("sample_idx", "re"), name)
        out = s.blocks(name) if out is None else out.unionByName(s.blocks(name))
    return out


# --- metadata ----------------------------------------------------------------------------------------------------


@query("md_ffill", "select e.channel, e.sample_idx, m.sample_idx as md_idx, m.v as md_value from ev e asof left join md m on e.channel = m.channel and e.sample_idx >= m.sample_idx", "ev md")
def md_ffill(spark, d):
    """JOIN-01, WIN-07."""
    return metadata.asof(ev(spark, d).select("channel", "sample_idx"), md(spark, d), "channel", "sample_idx", "v")


@query("md_range", "select * from md where sample_idx between 200 and 600", "ev md")
def md_range(spark, d):
    """SRC-12, SRC-13, PRJ-02."""
    return metadata.read(md(spark, d), 200, 600, columns=["v"])


@query("md_range_ffill", "select channel, sample_idx, v from md where sample_idx between 300 and 600 union all select channel, max(sample_idx), arg_max(v, sample_idx) from md where sample_idx < 300 and channel not in (select channel from md where sample_idx = 300) group by channel", "ev md")
def md_range_ffill(spark, d):
    """SRC-14."""
    return metadata.read(md(spark, d), 300, 600, fill=True)


@query("md_latest", "select channel, max(sample_idx) as sample_idx, arg_max(v, sample_idx) as v from md group by channel", "ev md")
def md_latest(spark, d):
    """SRC-17."""
    return metadata.latest(md(spark, d))


@query("md_flat", 'select event_id as sample_idx, user_id as "who/user", value as "what/value", event_type as "what/kind" from events')
def md_flat(spark, d):
    """SRC-15, MAP-01."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return metadata.flatten(e.select(F.col("event_id").alias("sample_idx"), F.struct(F.col("user_id").alias("user")).alias("who"), F.struct("value", F.col("event_type").alias("kind")).alias("what")))


@query("md_columnar", "select channel, sample_idx, v from md", "ev md")
def md_columnar(spark, d):
    """SRC-16 of all samples: arrays by channel and stretch, zipped again to show them."""
    m = md(spark, d).select("channel", div(F.col("sample_idx"), blocks.STRETCH).alias("stretch"), "sample_idx", F.col("sample_idx").alias("i"), "v")
    wide = metadata.columnar(m, "sample_idx", ("channel", "stretch"))
    return wide.select("channel", F.explode(F.arrays_zip("i", "v")).alias("z")).select("channel", F.col("z.i").alias("sample_idx"), "z.v")


@query("md_default_row", f"select c.channel, coalesce(m.sample_idx, 5) as sample_idx, v, cast({NUM} as bigint) as rate_num, cast({DEN} as bigint) as rate_den from (select distinct channel from ev union all select 'silent') c left join md m using (channel)", "ev md")
def md_default_row(spark, d):
    """SRC-19, SRC-21: every channel's metadata with its rate; a channel without any has a row of its rate alone."""
    silent = spark.range(1).select(F.lit("silent").alias("channel"))
    names = channels(spark, d).unionByName(silent).withColumns({"rate_num": F.lit(NUM).cast("long"), "rate_den": F.lit(DEN).cast("long")})
    return metadata.with_rate(md(spark, d), names, 5).select("channel", "sample_idx", "v", "rate_num", "rate_den")


@query("md_write_broadcast", "select o_orderkey as sample_idx, o_totalprice as gain, 'site' as name, 3 as level from orders")
def md_write_broadcast(spark, d):
    """MAP-03, SNK-10: one value a sample, and single values that hold for all of them."""
    rows = ord_(spark, d).withColumnRenamed("x", "gain")
    return metadata.with_single(rows, {"name": "site", "level": 3})


@query("md_no_overwrite", "select channel, sample_idx, v from md where sample_idx % 2 = 0", "ev md")
def md_no_overwrite(spark, d):
    """SNK-10: keys that a writer refuses."""
    m = md(spark, d)
    return metadata.refused(m, m.where("sample_idx % 2 = 0"))


# --- rasters and vectors -----------------------------------------------------------------------------------------


def _vector_query(op: str, expr: str, arg: int = 0) -> None:
    @query(f"vector_agg_{op}", f"select vec // 4 as grp, pos, {s6(expr, 'value')} from vec group by vec // 4, pos having count(*) = 4", "vec")
    def run(spark, d):
        """AGG-04."""
        return raster.vector_aggregate(raster.vectors(vec(spark, d), "vec_id", "embedding"), 4, op, arg).select("grp", "pos", r6(F.col("value"), "value"))


for _op, _sql in (("mean", "avg(x)"), ("sum", "sum(x)"), ("max", "max(x)"), ("min", "min(x)"), ("std", "stddev_pop(x)"), ("var", "var_pop(x)"), ("median", "median(x)"), ("prod", "product(x)"), ("ptp", "max(x) - min(x)")):
    _vector_query(_op, _sql)
_vector_query("take", "arg_min(x, case when vec % 4 = 1 then 0 else 1 end)", 1)


@query("raster_agg", f"select (sample_idx // 50) // 3 as grp, sample_idx % 50 as pos, {s6('avg(x)', 'value')} from ord group by 1, 2 having count(*) = 3", "ord")
def raster_agg(spark, d):
    """AGG-03."""
    return raster.raster_aggregate(raster.rasters(ord_(spark, d), 50), 3, "mean").select("grp", "pos", r6(F.col("value"), "value"))


@query("raster_select", "select sample_idx // 50 as raster, sample_idx % 50 - 40 as pos, x from ord where sample_idx % 50 >= 40", "ord")
def raster_select(spark, d):
    """PRJ-08: the window starts ten before the end and is cut there."""
    return raster.raster_select(raster.rasters(ord_(spark, d), 50), 50, -10, 20)


@query("raster_chunk", "select r.raster, c.c as chunk, a.a as \"at\", coalesce(x, 0.0) as x from (select distinct sample_idx // 50 as raster from ord) r, (select unnest(range(0, 9)) as c) c, (select unnest(range(0, 16)) as a) a left join ord on ord.sample_idx = r.raster * 50 + c.c * 6 + a.a and c.c * 6 + a.a < 50", "ord")
def raster_chunk(spark, d):
    """WIN-01, ARR-02."""
    return raster.raster_chunk(raster.rasters(ord_(spark, d), 50), 50, 16, 10)


@query("raster_tag", "select sample_idx // 50 as raster, sample_idx % 50 as pos, case sample_idx % 50 when 0 then 'begin' else 'pulse' end as tag from ord where sample_idx % 50 in (0, 7)", "ord")
def raster_tag(spark, d):
    """WIN-08."""
    return raster.raster_tags(raster.rasters(ord_(spark, d), 50), {0: "begin", 7: "pulse"})


@query("block_integrate_power", f"select sample_idx // 200 as block, sample_idx % 20 as pos, {s6('avg(x * x / 1e6)', 'value')} from ord group by 1, 2 having count(*) = 10", "ord")
def block_integrate_power(spark, d):
    """AGG-05, MTH-01."""
    return raster.block_average(ord_(spark, d), F.col("x") * F.col("x") / 1e6, 20, 10).select("block", "pos", r6(F.col("value"), "value"))


@query("rti", f"select sample_idx // 100 as \"column\", sample_idx % 100 as \"row\", {s6('10 * log10((x - m) * (x - m) + 1e-12)', 'db')} from (select *, avg(x) over (partition by sample_idx // 100) as m from ord)", "ord")
def rti(spark, d):
    """DSP-03, MTH-08: mean-detrended power, a column each modulus."""
    o = raster.rasters(ord_(spark, d), 100)
    both = o.join(o.groupBy("raster").agg(F.avg("x").alias("m")), "raster").withColumn("z", F.col("x") - F.col("m"))
    return both.select(F.col("raster").alias("column"), F.col("pos").alias("row"), r6(signal.decibel(F.col("z") * F.col("z")), "db"))


# --- point-wise and statistics -----------------------------------------------------------------------------------


@query("power_db", f"select sample_idx, {s6('10 * log10(re * re + im * im + 1e-12)', 'db')} from ev", "ev")
def power_db(spark, d):
    """MTH-01, MTH-03."""
    return ev(spark, d).select("sample_idx", r6(signal.decibel(signal.power(F.col("re"), F.col("im"))), "db"))


@query("phase", f"select sample_idx, {s6('atan2(im, re) / pi()', 'phase')} from ev", "ev")
def phase(spark, d):
    """MTH-02."""
    return ev(spark, d).select("sample_idx", r6(signal.phase(F.col("re"), F.col("im")) / math.pi, "phase"))


@query("iq_scale", f"select sample_idx, re * 256.0 as scaled, {s6('sign(re) * log2(abs(re) + 1e-30)', 'logged')} from ev", "ev")
def iq_scale(spark, d):
    """MTH-04."""
    return ev(spark, d).select("sample_idx", signal.iq_log(F.col("re"), 8).alias("scaled"), r6(signal.iq_log(F.col("re")), "logged"))


@query("histogram", "with b as (select min(re) as lo, max(re) as hi from ev) select least(floor((re - lo) / ((hi - lo) / 32)), 31)::bigint as bin, count(*) as n from ev, b group by 1", "ev")
def histogram(spark, d):
    """AGG-06, AGG-09: equal-width bins over the data's range; the last is closed."""
    e = ev(spark, d)
    lo, hi = e.agg(F.min("re"), F.max("re")).first()
    at = F.floor((F.col("re") - F.lit(lo)) / ((F.lit(hi) - F.lit(lo)) / 32))
    return e.groupBy(F.least(at, F.lit(31)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("detrend", f"select vec, pos, {s6('x - avg(x) over (partition by vec)', 'x')} from vec", "vec")
def detrend(spark, d):
    """MTH-08 within each vector, by array functions: nothing is shuffled."""
    mean = F.aggregate("a", F.lit(0.0), lambda s, x: s + x) / F.size("a")
    arr = vec(spark, d).select(F.col("vec_id").cast("long").alias("vec"), F.col("embedding").cast("array<double>").alias("a")).withColumn("m", mean)
    return arr.select("vec", F.posexplode(F.transform("a", lambda x: x - F.col("m"))).alias("p", "y")).select("vec", F.col("p").cast("long").alias("pos"), r6(F.col("y"), "x"))


@query("mix", f"select sample_idx, {s6('re * cos(0.01 * sample_idx) - im * sin(0.01 * sample_idx)', 're')}, {s6('re * sin(0.01 * sample_idx) + im * cos(0.01 * sample_idx)', 'im')} from ev", "ev")
def mix(spark, d):
    """MTH-05, DSP-10."""
    re, im = signal.rotate(F.col("re"), F.col("im"), F.col("sample_idx") * 0.01)
    return ev(spark, d).select("sample_idx", r6(re, "re"), r6(im, "im"))


@query("quantize", "select sample_idx, cast(round_even(re * 10, 0) as bigint) as q from ev", "ev")
def quantize(spark, d):
    """MTH-09."""
    return ev(spark, d).select("sample_idx", signal.quantize(F.col("re"), 10.0).alias("q"))


@query("fill_replace", "select sample_idx, case when im = 7 or im is null then 0.0 else im end as im from ev", "ev")
def fill_replace(spark, d):
    """PRJ-07."""
    return ev(spark, d).select("sample_idx", signal.replace_fill(F.col("im"), 7.0).alias("im"))


@query("axes", f"select sample_idx, {s6('sample_idx * 0.15::double', 'km')}, {s6('case when sample_idx % 64 < 32 then sample_idx % 64 else sample_idx % 64 - 64 end * 15625.0::double + 1000.0::double', 'hz')} from ev", "ev")
def axes(spark, d):
    """MTH-06, MTH-07: each sample's range, and the frequency of its bin of 64."""
    i = F.col("sample_idx")
    return ev(spark, d).select("sample_idx", r6(signal.range_km(i, 1e6), "km"), r6(signal.bin_frequency(i % 64, 64, 1e6, 1000.0), "hz"))


@query("hex2vec", "select event_id, array_to_string(list_transform(range(0, 12), lambda k: (event_id >> (11 - k)) & 1), '') as bits from events")
def hex2vec(spark, d):
    """MTH-10: the last twelve bits of each event's number in hexadecimal."""
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.array_join(F.transform(signal.hex_bits(F.hex("event_id"), 12), lambda b: b.cast("string")), "").alias("bits"))


@query("rep_seq", "select cast(vec_id as bigint) as vec, cast(k as bigint) as k, cast(embedding[k // 3 + 1] as double) as chip from (select vec_id, embedding, unnest(range(0, 192)) as k from embeddings)")
def rep_seq(spark, d):
    """ARR-03: each item of each vector three times."""
    code = signal.repeat_code(F.col("embedding").cast("array<double>"), 3)
    return vec(spark, d).select(F.col("vec_id").cast("long").alias("vec"), F.posexplode(code).alias("k", "chip")).select("vec", F.col("k").cast("long").alias("k"), "chip")


@query("unwrap_cumsum", "with p as (select sample_idx, atan2(im, re) as a from ev), s as (select sample_idx, a - lag(a) over (order by sample_idx) as d from p) select sample_idx, round(sum(coalesce(d - 2 * pi() * ceil((d - pi()) / (2 * pi())), 0)) over (order by sample_idx), 4) + 0.0 as phase from s", "ev")
def unwrap_cumsum(spark, d):
    """WIN-03, WIN-04."""
    p = ev(spark, d).select("sample_idx", signal.phase(F.col("re"), F.col("im")).alias("a"))
    total = filters.running_sum(filters.phase_steps(p, "a"), "step")
    return total.select("sample_idx", (F.round("total", 4) + 0.0).alias("phase"))


@query("s4_roll", f"select sample_idx, {s6('stddev_pop(x) over (order by sample_idx rows between 25 preceding and 24 following) / (select median(x) from ord)', 's4')} from ord", "ord")
def s4_roll(spark, d):
    """AGG-13, WIN-06."""
    return filters.rolling_s4(ord_(spark, d), 25).select("sample_idx", r6(F.col("s4"), "s4"))


@query("geometric_phase", f"select channel, {s6('exp(avg(ln(sqrt((re + 1) * (re + 1) + im * im))))', 'magnitude')}, {s6('avg(atan2(im, re + 1))', 'phase')} from ev group by channel", "ev")
def geometric_phase(spark, d):
    """AGG-12: magnitude and phase of the product of complex samples, each to the power 1/n."""
    z = ev(spark, d).withColumn("re", F.col("re") + 1)
    return spectral.geometric_mean(z, ["channel"]).select("channel", r6(F.col("magnitude"), "magnitude"), r6(F.col("phase"), "phase"))


@query("autoscale", "select channel, min(re) - 1 as lo, max(re) + 1 as hi, round(median(re), 6) as mid from ev group by channel", "ev")
def autoscale(spark, d):
    """AGG-08, AGG-09."""
    m = blocks.medians(ev(spark, d), "channel", "re", "sample_idx", scratch(spark))
    return m.select("channel", (F.col("low") - 1).alias("lo"), (F.col("high") + 1).alias("hi"), F.round("median", 6).alias("mid"))


@query("snr_filter", "with w as materialized (select cast(vec_id as bigint) as vec, list_transform(embedding, lambda x: cast(x as double) * cast(x as double) > 0.01) as ok from embeddings), pair as (select a.vec, a.ok as p, b.ok as q from w a join w b on b.vec = a.vec + 1 where a.vec % 2 = 0) select vec, cast(k as bigint) as pos from (select vec, unnest(range(0, len(p))) as k, p, q from pair) where p[k + 1] and q[k + 1]")
def snr_filter(spark, d):
    """PRJ-09."""
    v = raster.vectors(vec(spark, d), "vec_id", "embedding").where("x * x > 0.01")
    odd = v.where("vec % 2 = 1").select((F.col("vec") - 1).alias("vec"), "pos")
    return v.where("vec % 2 = 0").select("vec", "pos").join(odd, ["vec", "pos"])


# --- catalogue and retention -------------------------------------------------------------------------------------

_LO, _HI = 852076800000, 883612800000


@query("files_time_slice", f"select * from fil where key_ms between {_LO} and {_HI}", "fil")
def files_time_slice(spark, d):
    """PRJ-04."""
    return catalog.time_slice(fil(spark, d), _LO, _HI)


@query("files_ffill_slice", f"select grp, key_ms, size, path from fil where key_ms between {_LO} and {_HI} union all select grp, key_ms, size, path from (select *, row_number() over (partition by grp order by key_ms desc, path desc) as r from fil where key_ms < {_LO}) where r = 1", "fil")
def files_ffill_slice(spark, d):
    """PRJ-04 with look-back."""
    return catalog.time_slice_filled(fil(spark, d), _LO, _HI)


_NEWEST = "row_number() over (partition by grp order by key_ms desc, path desc)"


@query("expire_count", f"select grp, key_ms, size, path from (select *, {_NEWEST} as r from fil) where r > 50", "fil")
def expire_count(spark, d):
    """SRT-05."""
    return catalog.expired_by_count(fil(spark, d), 50)


@query("expire_duration", "select grp, key_ms, size, path from (select *, max(key_ms) over (partition by grp) as m from fil) where m - key_ms > 100000000000", "fil")
def expire_duration(spark, d):
    """SRT-06."""
    return catalog.expired_by_duration(fil(spark, d), 100_000_000_000)


@query("expire_size", f"with r as (select *, {_NEWEST} as r from fil), c as (select *, sum(size) over (order by key_ms desc, path desc) as t from r where r > 1) select grp, key_ms, size, path from c where t > 20000000 - (select sum(size) from r where r = 1)", "fil")
def expire_size(spark, d):
    """SRT-07: the batch form; each group's newest file stays."""
    return catalog.expired_by_size(fil(spark, d), 20_000_000)


@query("expire_combined", f"with a as (select *, {_NEWEST} as r, max(key_ms) over (partition by grp) as m from fil) select grp, key_ms, size, path from a where r > 300 or m - key_ms > 100000000000", "fil")
def expire_combined(spark, d):
    """SRT-08: count, then duration."""
    return catalog.expired(fil(spark, d), count=300, ms=100_000_000_000)


@query("ring_status", "select grp, count(*) as n_files, cast(sum(size) as bigint) as total_bytes, max(key_ms) - min(key_ms) as span_ms from fil group by grp", "fil")
def ring_status(spark, d):
    """AGG-10."""
    return catalog.status(fil(spark, d))


@query("reconcile", "select path, case when cast(path as bigint) % 2 > 0 then 'created' when cast(path as bigint) % 3 > 0 then 'deleted' else 'kept' end as state from fil where cast(path as bigint) % 2 = 0 or cast(path as bigint) % 3 = 0", "fil")
def reconcile(spark, d):
    """JOIN-06, SET-03: even paths are in the buffer, multiples of three on disk."""
    p = fil(spark, d).select("path")
    return catalog.reconcile(p.where("cast(path as bigint) % 2 = 0"), p.where("cast(path as bigint) % 3 = 0"))


@query("sort_files", "select path, row_number() over (order by key_ms, path) as place from fil", "fil")
def sort_files(spark, d):
    """SRT-01: every file with its place."""
    return catalog.places(fil(spark, d), ["key_ms", "path"], scratch(spark)).select("path", "place")


@query("disk_estimate", "select cast(floor(sum(size) * 0.5) as bigint) as bytes, count(*) as n_files from fil", "fil")
def disk_estimate(spark, d):
    """AGG-15."""
    return catalog.disk_estimate(fil(spark, d), 0.5)


@query("event_kinds", "select path, case when size % 2 = 0 and size % 3 = 0 then 'moved' when size % 3 = 0 then 'created' when size % 2 = 0 then 'deleted' end as event from fil", "fil")
def event_kinds(spark, d):
    """JOIN-05."""
    return fil(spark, d).select("path", catalog.event_kind(F.col("size") % 2 == 0, F.col("size") % 3 == 0).alias("event"))


# --- spectra -----------------------------------------------------------------------------------------------------

_DFT = "dft as (select vec, k.k, sum(x * cos(2 * pi() * k.k * pos / 64)) as re, -sum(x * sin(2 * pi() * k.k * pos / 64)) as im from vec, (select unnest(range(0, 64)) as k) k group by vec, k.k)"


def _windowed(w: str, n: int, source: str) -> str:
    """SQL of re and im of a DFT of n samples (key, k, at, x) with a window."""
    return f"select key, k.k as k, sum(x * ({w}) * cos(2 * pi() * k.k * p / {n})) as re, -sum(x * ({w}) * sin(2 * pi() * k.k * p / {n})) as im from ({source}), (select unnest(range(0, {n})) as k) k group by key, k.k"


@query("dft_power", f"with {_DFT} select vec as vec_id, k, {s6('re * re + im * im', 'power')} from dft", "vec")
def dft_power(spark, d):
    """DSP-01, DSP-22."""
    return spectral.power_spectrum(vec(spark, d), "vec_id", "embedding").select("vec_id", "k", r6(F.col("power"), "power"))


_BLACKMAN = "0.42 - 0.5 * cos(2 * pi() * p / 64) + 0.08 * cos(4 * pi() * p / 64)"


@query("psd_blackman", f"with f as ({_windowed(_BLACKMAN, 64, 'select vec as key, pos as p, x - avg(x) over (partition by vec) as x from vec')}) select key as vec_id, k, {s6('re * re + im * im', 'power')} from f", "vec")
def psd_blackman(spark, d):
    """DSP-01 with a window and mean removed."""
    return spectral.power_spectrum(vec(spark, d), "vec_id", "embedding", "blackman", detrend=True).select("vec_id", "k", r6(F.col("power"), "power"))


_HANN = "0.5 - 0.5 * cos(2 * pi() * p / 32)"


@query("welch", f"with f as ({_windowed(_HANN, 32, 'select vec * 3 + s.s as key, pos - s.s * 16 as p, x from vec, (select unnest(range(0, 3)) as s) s where pos between s.s * 16 and s.s * 16 + 31')}) select key // 3 as vec_id, k, {s6('avg(re * re + im * im) / 256', 'power')} from f group by key // 3, k", "vec")
def welch(spark, d):
    """AGG-07, DSP-05."""
    return spectral.welch(vec(spark, d), "vec_id", "embedding", 32, 16).select("vec_id", "k", r6(F.col("power"), "power"))


@query("specgram", f"with f as ({_windowed(_HANN, 32, 'select vec * 9 + s.s as key, pos - s.s * 4 as p, x from vec, (select unnest(range(0, 9)) as s) s where pos between s.s * 4 and s.s * 4 + 31')}) select key // 9 as vec_id, key % 9 as seg, k, {s6('(re * re + im * im) / 256', 'power')} from f", "vec")
def specgram(spark, d):
    """DSP-02, DSP-04, WIN-05: overlap int(0.9 * bins)."""
    return spectral.specgram(vec(spark, d), "vec_id", "embedding", 32, int(0.9 * 32)).select("vec_id", "seg", "k", r6(F.col("power"), "power"))


@query("sti", f"with f as ({_windowed('0.5 - 0.5 * cos(2 * pi() * p / 64)', 64, 'select (sample_idx // 256) * 7 + s.s as key, sample_idx % 256 - s.s * 32 as p, x / 1000 as x from ord, (select unnest(range(0, 7)) as s) s where sample_idx % 256 between s.s * 32 and s.s * 32 + 63 and sample_idx // 256 < (select count(*) from ord) // 256')}) select key // 7 as segment, k, round(10 * log10(avg(re * re + im * im) / 1024 + 1e-20), 4) as db from f group by key // 7, k", "ord")
def sti(spark, d):
    """DSP-05: stripes of 256 samples, Welch, dB."""
    stripes = spectral.segments(ord_(spark, d).withColumn("x", F.col("x") / 1000), 256)
    return spectral.welch(stripes, "segment", "x", 64, 32).select("segment", "k", F.round(signal.decibel(F.col("power"), 1e-20), 4).alias("db"))


@query("cross_spectrum", f"with {_DFT} select a.vec as vec_id, a.k, {s6('a.re * b.re + a.im * b.im', 're')}, {s6('a.im * b.re - a.re * b.im', 'im')} from dft a join dft b on b.vec = a.vec + 1 and a.k = b.k where a.vec % 2 = 0", "vec")
def cross_spectrum(spark, d):
    """DSP-07, DSP-18, JOIN-02: even vectors with the next one."""
    v = vec(spark, d)
    odd = v.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    both = v.where("vec_id % 2 = 0").select("vec_id", F.col("embedding").alias("x")).join(odd, "vec_id")
    return spectral.cross_spectrum(both, "vec_id", "x", "y").select("vec_id", "k", r6(F.col("re"), "re"), r6(F.col("im"), "im"))


@query("peak_bin", f"with {_DFT}, p as (select vec, k, re * re + im * im as power from dft), m as (select vec, median(power) / ln(2) as noise from p group by vec), t as (select vec, max(power) as peak_power, arg_max(k, power) as peak_k from p where k between 1 and 20 group by vec) select t.vec as vec_id, cast(peak_k as bigint) as peak_k, {s6('peak_power', 'peak_power')}, {s6('noise', 'noise')}, round(peak_power / noise, 4) as snr from t join m using (vec)", "vec")
def peak_bin(spark, d):
    """SRT-04, AGG-08, AGG-11."""
    p = spectral.peak(spectral.power_spectrum(vec(spark, d), "vec_id", "embedding"), "vec_id", 1, 20)
    return p.select("vec_id", F.col("peak_k").cast("long").alias("peak_k"), r6(F.col("peak_power"), "peak_power"), r6(F.col("noise"), "noise"), F.round("snr", 4).alias("snr"))


@query("beamform", f"select vec // 4 as grp, pos, {s6('sum(x * cos(radians(30.0 * (vec % 4))))', 're')}, {s6('sum(x * sin(radians(30.0 * (vec % 4))))', 'im')} from vec group by 1, 2", "vec")
def beamform(spark, d):
    """DSP-06."""
    v = raster.vectors(vec(spark, d), "vec_id", "embedding").select(div(F.col("vec"), 4).alias("grp"), (F.col("vec") % 4).alias("c"), "pos", "x")
    b = spectral.beamform(v, "grp", "c", 30.0)
    return b.select("grp", "pos", r6(F.col("re"), "re"), r6(F.col("im"), "im"))


# --- filters -----------------------------------------------------------------------------------------------------


def _taps_sql(taps: list[float]) -> str:
    return " + ".join(f"lead(x, {k}) over (order by sample_idx) * ({t!r})" for k, t in enumerate(taps))


_LOW = signal.lowpass(15, 0.1)


@query("matched_filter", f"select sample_idx, round(y, 4) + 0.0 as y from (select sample_idx, {_taps_sql(signal.barker(13))} as y from ord) where y is not null", "ord")
def matched_filter(spark, d):
    """DSP-08."""
    return filters.fir(ord_(spark, d), signal.barker(13)).select("sample_idx", (F.round("y", 4) + 0.0).alias("y"))


@query("fir_lowpass", f"select sample_idx, round(y, 4) + 0.0 as y from (select sample_idx, {_taps_sql(_LOW)} as y from ord) where y is not null", "ord")
def fir_lowpass(spark, d):
    """DSP-11."""
    return filters.fir(ord_(spark, d), _LOW).select("sample_idx", (F.round("y", 4) + 0.0).alias("y"))


@query("decimate", f"select sample_idx // 4 as sample_idx, round(y, 4) + 0.0 as y from (select sample_idx, {_taps_sql(_LOW)} as y from ord) where y is not null and sample_idx % 4 = 0", "ord")
def decimate(spark, d):
    """DSP-09, SNK-17."""
    return filters.decimate(ord_(spark, d), _LOW, 4).select("sample_idx", (F.round("y", 4) + 0.0).alias("y"))


@query("resample_rational", f"select m.m as sample_idx, round(sum(x * ({_LOW!r})[cast(m.m * 2 - ord.sample_idx * 3 + 1 as int)]), 4) + 0.0 as y from ord, lateral (select unnest(range((ord.sample_idx * 3 + 1) // 2, (ord.sample_idx * 3 + 14) // 2 + 1)) as m) m group by m.m", "ord")
def resample_rational(spark, d):
    """DSP-12: 3/2."""
    return filters.resample(ord_(spark, d), 3, 2, _LOW).select("sample_idx", (F.round("y", 4) + 0.0).alias("y"))


@query("channelize", "with p as (select sample_idx as i, x, unnest(range(greatest((sample_idx - 12 + 0) // 4, 0), sample_idx // 4 + 1)) as m from ord), " + f"q as (select m, i, x * ({_LOW!r})[cast(i - m * 4 + 1 as int)] as v from p where i - m * 4 < 15 and i - m * 4 >= 0) select m as sample_idx, cast(b.b as bigint) as band, round(sum(v * cos(-2 * pi() * b.b / 4 * (i % 4))), 3) + 0.0 as re, round(sum(v * sin(-2 * pi() * b.b / 4 * (i % 4))), 3) + 0.0 as im from q, (select unnest(range(0, 4)) as b) b group by m, b.b", "ord")
def channelize(spark, d):
    """DSP-13."""
    return filters.channelize(ord_(spark, d), 4, _LOW).select("sample_idx", "band", (F.round("re", 3) + 0.0).alias("re"), (F.round("im", 3) + 0.0).alias("im"))


# --- streams -----------------------------------------------------------------------------------------------------


@query("stream_ingest", "select channel, cast(min(sample_idx) as bigint) as first_sample, count(*) as n from ev group by channel", "ev")
def stream_ingest(spark, d):
    """SRC-23, SRC-24, SNK-11, SNK-12: events through a stream into a partitioned table, then counted."""
    at, back = scratch(spark), scratch(spark)
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = ingest.source(spark, f"{d}/event[s].parquet", schema).select(F.col("event_type").alias("channel"), F.col("event_id").alias("sample_idx"), F.col("value").alias("re"))
    ingest.sink(stream, at, back, ["channel"])
    return spark.read.parquet(at).groupBy("channel").agg(F.min("sample_idx").alias("first_sample"), F.count(F.lit(1)).alias("n"))


# --- domain pipelines --------------------------------------------------------------------------------------------


@query("prc_range_profile")
def prc_range_profile(spark, d):
    """DSP-14, DSP-15."""
    h = spectral.least_squares(vec(spark, d), "vec_id", "embedding", spectral.random_code(64, 0), 8)
    return h.select("vec_id", "k", r6(F.col("re"), "re"), r6(F.col("im"), "im"))


@query("prc_doppler")
def prc_doppler(spark, d):
    """DSP-15."""
    h = spectral.least_squares(vec(spark, d), "vec_id", "embedding", spectral.random_code(64, 0), 8).withColumnRenamed("vec_id", "segment")
    return spectral.doppler(h, "blackmanharris", 16).select("range", "block", "k", r6(F.col("power"), "power"))


@query("robust_line")
def robust_line(spark, d):
    """DSP-19: a line for each channel."""
    p = ev(spark, d).select("channel", (F.col("sample_idx") / 1000).alias("t"), F.col("re").alias("y"), F.lit(1.0).alias("w"))
    return filters.robust_lines(p).select("channel", r6(F.col("slope"), "slope"), r6(F.col("intercept"), "intercept"))


@query("relative_tec", f"with p as (select sample_idx, atan2(im, re) as a from ev), s as (select sample_idx, a - lag(a) over (order by sample_idx) as d from p) select sample_idx, round(sum(coalesce(d - 2 * pi() * ceil((d - pi()) / (2 * pi())), 0)) over (order by sample_idx) / (2 * pi()) * {signal.tec_per_cycle()!r}, 4) + 0.0 as tec from s", "ev")
def relative_tec(spark, d):
    """DSP-20, MTH-11: the carried phase as a prefix sum, scaled."""
    p = ev(spark, d).select("sample_idx", signal.phase(F.col("re"), F.col("im")).alias("a"))
    total = filters.running_sum(filters.phase_steps(p, "a"), "step")
    return total.select("sample_idx", (F.round(F.col("total") / (2 * math.pi) * signal.tec_per_cycle(), 4) + 0.0).alias("tec"))


__all__ = ["oracles", "queries"]
