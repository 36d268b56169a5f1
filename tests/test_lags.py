"""Correlation by lag without a join: stretches of any size, gaps, repeated indexes, nulls, lags without pairs."""

import pytest
from pyspark.sql import functions as F

from sigloom.operators import spectral

ROWS = [(k, float(k % 7), None if k % 5 == 0 else float(k % 3)) for k in range(-20, 60) if k % 4 != 1] + [(7, 2.0, 1.5), (7, None, 4.0), (None, 1.0, 1.0)]


@pytest.mark.parametrize("stretch", [3, 16, 1 << 16])
def test_lags(spark, stretch):
    x = spark.createDataFrame(ROWS, "sample_idx long, a double, b double")
    lag = F.explode(F.sequence(F.lit(-5), F.lit(5))).alias("lag")
    other = x.select(lag, F.col("sample_idx").alias("j"), F.col("b").alias("c")).withColumn("i", F.col("j") - F.col("lag"))
    want = {r.lag: r.r for r in x.join(other, F.col("sample_idx") == F.col("i")).groupBy("lag").agg(F.sum(F.col("a") * F.col("c")).alias("r")).collect()}
    got = spectral.lag_of(x, "a", "b", 5, stretch)
    assert "Join" not in got._jdf.queryExecution().toString()
    assert {r.lag: r.r for r in got.collect()} == pytest.approx(want)


def test_lags_without_pairs(spark):
    x = spark.createDataFrame([(0, 1.0, None), (10, 2.0, 3.0), (13, 1.0, 1.0)], "sample_idx long, a double, b double")
    assert sorted((r.lag, r.r) for r in spectral.lag_of(x, "a", "b", 4).collect()) == [(-3, 3.0), (0, 7.0), (3, 2.0)]
