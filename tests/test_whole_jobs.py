"""Queries over whole tables, where the ones with fixed SQL see a part."""

from pyspark.sql import functions as F

from sigloom.operators import catalog, filters
from sigloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_every_file_has_its_place(spark, tmp_path):
    files = catalogue.fil(spark, SF)
    want = sorted((r.key_ms, r.path) for r in files.collect())
    got = catalog.places(files, ["key_ms", "path"], str(tmp_path / "ranges")).orderBy("place").collect()
    assert [(r.key_ms, r.path) for r in got] == want and [r.place for r in got] == list(range(1, len(want) + 1))
    assert catalogue.queries()["sort_files"](spark, SF).count() == len(want) > 100


def test_robust_line_of_every_channel(spark):
    points = catalogue.ev(spark, SF).select("channel", (F.col("sample_idx") / 1000).alias("t"), F.col("re").alias("y"), F.lit(1.0).alias("w")).cache()
    got = {r.channel: (r.slope, r.intercept) for r in catalogue.queries()["robust_line"](spark, SF).collect()}
    names = [r[0] for r in points.select("channel").distinct().collect()]
    assert len(names) > 1 and set(got) == set(names)
    for name in names[:2]:
        want = filters.robust_line(points.where(F.col("channel") == name))
        assert max(abs(a - b) for a, b in zip(got[name], want, strict=True)) < 2e-6


def test_whole_tables(spark):
    q, e = catalogue.queries(), catalogue.ev(spark, SF)
    want = sum(r[2] - r[1] + 1 for r in q["bounds"](spark, SF).collect())
    assert q["gap_fill"](spark, SF).count() == want
    assert q["vector_cast"](spark, SF).select("v").distinct().count() > 1
    assert q["store_blocks"](spark, SF).select("channel").distinct().count() == e.select("channel").distinct().count() > 1
    assert q["md_columnar"](spark, SF).count() == e.where("im < 10").count()
