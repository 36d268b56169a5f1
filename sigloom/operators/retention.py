"""Retention by thresholds: which files go is found from sums over ranges of time, so no window holds more than one short range's files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of time, in ms, that the search for a threshold narrows down by: a day, then a minute.
WIDTHS = (86_400_000, 60_000)


def beyond(files: DataFrame, weight: Column, room: DataFrame, by: list[str], ties: list[Column], widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """Files whose weight, with that of all newer ones of their group, exceeds the group's room (by..., room).

    Weights are not negative. Sums by range give the newest range where the room ends; older ranges go whole, newer ones stay whole, and only
    within that one range are the next shorter ranges, and at last its files, looked at. Files without a time are none's; equal times go by ties,
    an order from the newest on.
    """
    held = files.where(F.col("key_ms").isNotNull()).withColumn("_w", weight)
    at = [f"_at{k}" for k in range(len(widths))]
    held = held.withColumns({c: F.floor(F.col("key_ms") / w) for c, w in zip(at, widths, strict=True)})
    left, whole = room.select(*by, F.col("room").alias("_room")), F.lit(False)
    for k, c in enumerate(at):
        sums = (held if k == 0 else held.where(F.col(at[k - 1]) == F.col(f"_cut{k - 1}"))).groupBy(*by, c).agg(F.sum("_w").alias("_s"))
        newer = F.coalesce(F.sum("_s").over(Window.partitionBy(*by).orderBy(F.desc(c)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ends = sums.withColumn("_newer", newer).join(left, by).where(F.col("_newer") + F.col("_s") > F.col("_room"))
        # the newest such range of each group: one row a group
        cut = ends.groupBy(*by).agg(F.max(F.struct(F.col(c).alias("at"), (F.col("_room") - F.col("_newer")).alias("room"))).alias("_m"))
        cut = cut.select(*by, F.col("_m.at").alias(f"_cut{k}"), F.col("_m.room").alias("_room"))
        held = held.drop("_room").join(cut, by)
        whole, left = whole | (F.col(c) < F.col(f"_cut{k}")), cut.select(*by, "_room")
    own = F.sum("_w").over(Window.partitionBy(*by).orderBy(F.desc("key_ms"), *ties))
    last = held.where(F.col(at[-1]) == F.col(f"_cut{len(at) - 1}")).withColumn("_own", own).where(F.col("_own") > F.col("_room"))
    return held.where(whole).select(files.columns).unionByName(last.select(files.columns))


def by_count(files: DataFrame, count: int) -> DataFrame:
    """All but each group's newest count files; of equal times the greater paths are newer."""
    room = files.groupBy("grp").agg(F.lit(count).cast("long").alias("room"))
    return beyond(files, F.lit(1).cast("long"), room, ["grp"], [F.desc("path")])


def by_size(files: DataFrame, size: int, trigger: str | None = None) -> DataFrame:
    """The oldest files of all groups, until the rest is at most size bytes; a group's newest file stays.

    trigger names the group whose new or longer file started this: of equal times its files go first, and its newest goes too, in its turn, where
    the rest is still too long. Where nothing more may go, the rest stays longer than size.
    """
    newest = files.where(F.col("key_ms").isNotNull()).groupBy("grp").agg(F.max(F.struct("key_ms", "path", "size")).alias("_m"))
    own = F.lit(False) if trigger is None else F.col("grp").eqNullSafe(F.lit(trigger))
    kept = newest.where(~own)
    rest = files.join(kept.select(F.col("_m.path").alias("path")), "path", "left_anti").select(files.columns).withColumn("_all", F.lit(0))
    room = kept.agg((F.lit(size) - F.coalesce(F.sum("_m.size"), F.lit(0))).alias("room")).withColumn("_all", F.lit(0))
    return beyond(rest, F.col("size"), F.broadcast(room), ["_all"], [own.asc(), F.desc("path")]).select(files.columns)
