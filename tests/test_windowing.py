"""Properties of recency windows, apportionment and pools."""

import pytest
from pyspark.sql import functions as F

from yearloom.operators import windowing as W


@pytest.mark.parametrize("token", ["roll10", "exp5", "cum", "single", "roll1", "exp2.5"])
def test_spec_round_trip(token):
    assert str(W.parse_spec(token)) == token


@pytest.mark.parametrize("token", ["roll", "roll0", "exp-1", "nonsense", "roll10x", "roll0.5", ""])
def test_bad_spec(token):
    with pytest.raises(ValueError):
        W.parse_spec(token)


def _years(spark, first, last, name):
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias(name))


@pytest.mark.parametrize("token", ["roll10", "exp5", "cum", "single"])
def test_weights_sum_to_one_and_look_back(spark, token):
    w = W.year_weights(_years(spark, 1980, 1985, "model_year"), _years(spark, 1931, 2020, "source_year"), W.parse_spec(token))
    for r in w.groupBy("model_year").agg(F.sum("weight").alias("s"), F.max("source_year").alias("last"), F.count("*").alias("n")).collect():
        assert abs(r.s - 1) < 1e-9 and r["last"] == r.model_year
        assert token != "roll10" or r.n == 10
        assert token != "single" or r.n == 1


def test_early_window_is_cut_and_half_life(spark):
    pools = _years(spark, 1931, 2020, "source_year")
    assert W.year_weights(_years(spark, 1933, 1933, "model_year"), pools, W.parse_spec("roll10")).count() == 3
    w = {r.source_year: r.weight for r in W.year_weights(_years(spark, 1980, 1980, "model_year"), pools, W.parse_spec("exp5")).collect()}
    assert abs(w[1975] / w[1980] - 0.5) < 1e-9


def test_budget_is_exact_ties_to_latest_and_clipped(spark):
    models, pools = _years(spark, 1933, 1933, "model_year"), _years(spark, 1931, 1933, "source_year")
    w = W.year_weights(models, pools, W.parse_spec("roll3"))
    got = {r.source_year: r.n_rows for r in W.allocate(w, pools.withColumn("n", F.lit(1000)), total=100).collect()}
    assert got == {1931: 33, 1932: 33, 1933: 34}
    clipped = W.allocate(w, pools.withColumn("n", F.lit(10)), per_year=50).agg(F.sum("n_rows")).first()[0]
    assert clipped == 30
    with pytest.raises(ValueError):
        W.allocate(w, pools, total=1, per_year=1)
    with pytest.raises(ValueError):
        W.allocate(w, pools)


def test_pools_nest_resample_and_do_not_depend_on_partitions(spark):
    rows = spark.range(13).selectExpr("1950 AS year", "id AS k").union(spark.range(100).selectExpr("1951", "id"))
    pool = W.build_pool(rows, "year", "k", 40)
    got = {r.year: (r.n_distinct, r.n_total, r.n_resampled) for r in W.pool_manifest(pool, "year", 40).collect()}
    assert got == {1950: (13, 40, 27), 1951: (40, 40, 0)}
    assert pool.where("year = 1950 AND pos < 13").select("k").distinct().count() == 13
    again = W.build_pool(rows.repartition(7), "year", "k", 40)
    assert sorted(map(tuple, pool.collect())) == sorted(map(tuple, again.collect()))
    small, large = ({r.k for r in W.stable_order(rows, "year", "k").where(f"year = 1951 AND pos < {n}").collect()} for n in (5, 20))
    assert small < large


def test_empty_tables(spark):
    none = spark.createDataFrame([], "year int, k long")
    assert W.build_pool(none, "year", "k", 5).count() == 0
    weights = W.year_weights(spark.createDataFrame([], "model_year int"), spark.createDataFrame([], "source_year int"), W.parse_spec("cum"))
    assert weights.count() == 0


def test_name():
    assert W.experiment_name(1950, "nanochat", W.parse_spec("roll10"), 40000) == "policy_1950_nanochat_roll10_n40000"
    assert W.experiment_name(1935, "talkie", W.parse_spec("exp2.5"), 5000, True) == "policy_1935_talkie_exp2.5_n5000_sft"
