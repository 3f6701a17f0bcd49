import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ecoframe.operators.quantiles import Quantile, exact_quantiles
from ecoframe.operators.skew import attach, rank_by_uniform, repeated


@pytest.fixture(scope="module")
def hot(spark):
    """One key with most of the rows, many small ones and a NULL key."""
    key = F.when(F.col("id") < 6000, F.lit(0)).when(F.col("id") < 6010, F.lit(None)).otherwise(F.col("id") % 500)
    return spark.range(10000).select("id", key.cast("int").alias("k"), F.pmod(F.xxhash64("id"), F.lit(997)).cast("double").alias("v"))


def test_attach_keeps_every_row_once(hot):
    stats = hot.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
    joined = attach(hot, stats, ["k"], "n")
    assert joined.count() == hot.count() and joined.select("id").distinct().count() == hot.count()
    wrong = joined.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n")).where("c <> n")
    assert wrong.isEmpty()


def test_attach_spreads_a_hot_key(hot):
    stats = hot.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert "_salt" in attach(hot, stats, ["k"], "n")._jdf.queryExecution().executedPlan().toString()


def test_left_attach_keeps_unmatched_rows(hot):
    stats = hot.where("k = 0").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = attach(hot, stats, ["k"], "n", how="left")
    assert joined.count() == hot.count() and joined.where("n is null").count() == 10000 - hot.where("k = 0").count()


def test_repeated_matches_windows(hot):
    w = Window.partitionBy("k").orderBy("id")
    later = {r.id for r in hot.withColumn("rn", F.row_number().over(w)).where("rn > 1").collect()}
    assert {r.id for r in repeated(hot, ["k"], ["id"]).collect()} == later
    every = {r.id for r in hot.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("k"))).where("n > 1").collect()}
    assert {r.id for r in repeated(hot, ["k"]).collect()} == every


@pytest.mark.parametrize("buckets", [1, 16])
def test_rank_by_uniform_is_row_number(hot, buckets):
    drawn = hot.where("k is not null").withColumn("u", (F.pmod(F.xxhash64("v"), F.lit(1000)) / 1000.0))
    expected = drawn.withColumn("e", F.row_number().over(Window.partitionBy("k").orderBy("u", "id")) - 1)
    got = rank_by_uniform(drawn, ["k"], "u", ["id"], "rank", buckets)
    assert got.join(expected, "id").where("rank <> e").isEmpty() and got.count() == drawn.count()


@pytest.mark.parametrize("accuracy", [10000, 200])
def test_exact_quantiles_equal_percentile(hot, accuracy):
    """A low accuracy forces the bracket path for the hot key; the result stays exact."""
    wanted = [Quantile("p50", F.col("v"), 0.5), Quantile("p90", F.col("v"), 0.9), Quantile("p10", F.when(F.col("k") < 250, F.col("v")), 0.1),
              Quantile("lowest", F.col("v"), 0.0), Quantile("highest", F.col("v"), 1.0)]
    got = {r.k: r for r in exact_quantiles(hot.where("k is not null"), ["k"], wanted, accuracy).collect()}
    expected = hot.where("k is not null").groupBy("k").agg(
        F.percentile("v", 0.5).alias("p50"), F.percentile("v", 0.9).alias("p90"),
        F.percentile(F.when(F.col("k") < 250, F.col("v")), 0.1).alias("p10"), F.min("v").alias("lowest"), F.max("v").alias("highest")).collect()
    assert len(got) == len(expected)
    for e in expected:
        for name in ("p50", "p90", "p10", "lowest", "highest"):
            assert got[e.k][name] == (None if e[name] is None else pytest.approx(e[name], abs=1e-9))


def test_exact_quantiles_of_distinct_values_in_one_hot_group(spark):
    rows = spark.range(50000).select(F.lit(1).alias("k"), (F.xxhash64("id") / 1e15).alias("v"))
    got = exact_quantiles(rows, ["k"], [Quantile("m", F.col("v"), 0.5), Quantile("t", F.col("v"), 0.95)], 500).first()
    expected = rows.agg(F.percentile("v", 0.5), F.percentile("v", 0.95)).first()
    assert (got.m, got.t) == (pytest.approx(expected[0], abs=1e-9), pytest.approx(expected[1], abs=1e-9))
