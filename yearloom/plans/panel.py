"""Panel queries. Lens: a nation is a policy, an order one scored variant of it in the year of the order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yearloom.operators import panel as P
from yearloom.plans.registry import query
from yearloom.session import table

_VARIANT = """variant AS (
  SELECT c.c_nationkey AS policy_id, 1996 + c.c_nationkey % 4 AS enactment_year, CAST(year(o.o_orderdate) AS INTEGER) AS year_model,
         o.o_orderkey AS variant_idx, least(o.o_totalprice / 500000, 1.0) AS p_yes
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""
_PANEL = f"""{_VARIANT},
panel AS (
  SELECT policy_id, enactment_year, year_model, CAST(year_model - enactment_year AS INTEGER) AS rel_year, avg(p_yes) AS p_yes, stddev_pop(p_yes) AS p_sd, count(*) AS n_variants
  FROM variant GROUP BY ALL)"""
_Z = f"""{_PANEL},
scored AS (SELECT *, count(p_yes) OVER w AS cn, avg(p_yes) OVER w AS m, stddev_pop(p_yes) OVER w AS sd FROM panel WINDOW w AS (PARTITION BY policy_id)),
z AS (SELECT *, (p_yes - m) / sd AS z FROM scored WHERE cn >= 5 AND sd > 0)"""
_CURVE = f"{_Z}, curve AS (SELECT rel_year, avg(z) AS mean_z FROM z GROUP BY rel_year)"
_ERF = "(1 - (t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))) * exp(-a * a))"


def variants(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("policy_id"), (1996 + F.col("c_nationkey") % 4).alias("enactment_year"), F.year("o_orderdate").alias("year_model"),
        F.col("o_orderkey").alias("variant_idx"), F.least(F.col("o_totalprice") / 500000, F.lit(1.0)).alias("p_yes"),
    )


def panel(spark: SparkSession, d: str) -> DataFrame:
    scored = variants(spark, d).groupBy("policy_id", "enactment_year", "year_model").agg(
        F.avg("p_yes").alias("p_yes"), F.stddev_pop("p_yes").alias("p_sd"), F.count("*").alias("n_variants")
    )
    return P.tidy(scored)


@query(f"WITH {_PANEL} SELECT policy_id, enactment_year, year_model, rel_year, round(p_yes, 6) AS p_yes, n_variants, n_name AS category FROM panel LEFT JOIN nation ON n_nationkey = policy_id")
def panel_tidy(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("policy_id"), F.col("n_name").alias("category"))
    return panel(spark, d).join(names, "policy_id", "left").select("policy_id", "enactment_year", "year_model", "rel_year", F.round("p_yes", 6).alias("p_yes"), "n_variants", F.coalesce("category", F.lit("UNKNOWN")).alias("category"))


@query(f"WITH {_Z} SELECT rel_year, round(avg(z), 6) AS mean_z, count(*) AS n FROM z GROUP BY rel_year")
def panel_z_curve(spark: SparkSession, d: str) -> DataFrame:
    return P.z_curve(panel(spark, d))


@query(f"WITH {_PANEL} SELECT CAST(s.r AS INTEGER) AS rel_year, round(avg(p_yes), 6) AS mean_p_yes, count(p_yes) AS n FROM range(-10, 11) s(r) LEFT JOIN panel ON rel_year = s.r GROUP BY s.r")
def panel_raw_curve_dense(spark: SparkSession, d: str) -> DataFrame:
    return P.raw_curve(panel(spark, d), -10, 10)


@query(f"WITH {_PANEL} SELECT count(DISTINCT policy_id) AS n_policies, min(rel_year) AS first_rel, max(rel_year) AS last_rel, count(*) FILTER (rel_year NOT BETWEEN -20 AND 20) AS n_outside FROM panel")
def panel_rel_bounds(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).agg(F.count_distinct("policy_id").alias("n_policies"), F.min("rel_year").alias("first_rel"), F.max("rel_year").alias("last_rel"), F.count_if(~F.col("rel_year").between(-20, 20)).alias("n_outside"))


_SLOPE = f"""{_PANEL}, slopes AS (SELECT policy_id, count(*) AS n, round(CASE WHEN var_pop(rel_year) > 0 THEN regr_slope(p_yes, rel_year) ELSE 0 END, 6) AS slope,
  round(arg_max(p_yes, rel_year) - arg_min(p_yes, rel_year), 6) AS delta FROM panel WHERE rel_year BETWEEN -10 AND 10 GROUP BY policy_id HAVING count(*) >= 5)"""


@query(f"WITH {_SLOPE} SELECT * FROM slopes")
def panel_slope(spark: SparkSession, d: str) -> DataFrame:
    return P.slopes(panel(spark, d), -10, 10)


@query(f"""WITH {_SLOPE}, s AS (SELECT count(slope) AS n, count(*) FILTER (slope > 0) AS n_positive FROM slopes),
 e AS (SELECT *, ((n_positive - n / 2.0) / sqrt(n / 4.0)) / sqrt(2.0) AS x FROM s), f AS (SELECT *, abs(x) AS a, 1 / (1 + 0.3275911 * abs(x)) AS t FROM e)
 SELECT n, n_positive, round(n_positive / n, 6) AS fraction, round(0.5 * (1 - sign(x) * {_ERF}), 6) AS p_value FROM f""")
def panel_sign_test(spark: SparkSession, d: str) -> DataFrame:
    return P.sign_test(P.slopes(panel(spark, d), -10, 10))


@query(f"""WITH {_SLOPE} SELECT r_name AS region, count(*) AS n, count(*) FILTER (slope > 0) AS n_positive, round(avg(delta), 6) AS mean_delta, round(avg(slope), 6) AS mean_slope
 FROM slopes JOIN nation ON n_nationkey = policy_id JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def panel_slope_summary(spark: SparkSession, d: str) -> DataFrame:
    place = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("policy_id"), F.col("r_name").alias("region"))
    return P.slopes(panel(spark, d), -10, 10).join(place, "policy_id").groupBy("region").agg(
        F.count("*").alias("n"), F.count_if(F.col("slope") > 0).alias("n_positive"), F.round(F.avg("delta"), 6).alias("mean_delta"), F.round(F.avg("slope"), 6).alias("mean_slope")
    )


@query(f"""WITH {_SLOPE}, e AS (SELECT s.*, 1996 + policy_id % 4 AS year FROM slopes s)
 SELECT CAST((year // 10) * 10 AS INTEGER) AS decade, round(count(*) FILTER (slope > 0 AND policy_id % 2 = 0) / nullif(count(*) FILTER (policy_id % 2 = 0), 0), 6) AS even,
 round(count(*) FILTER (slope > 0 AND policy_id % 2 = 1) / nullif(count(*) FILTER (policy_id % 2 = 1), 0), 6) AS odd FROM e GROUP BY 1""")
def panel_decade_pivot(spark: SparkSession, d: str) -> DataFrame:
    each = P.slopes(panel(spark, d), -10, 10).withColumn("decade", F.expr("((1996 + policy_id % 4) DIV 10) * 10").cast("int"))
    each = each.withColumn("side", F.when(F.col("policy_id") % 2 == 0, "even").otherwise("odd"))
    return each.groupBy("decade").pivot("side", ["even", "odd"]).agg(F.round(F.avg((F.col("slope") > 0).cast("double")), 6))


_FIT = f"""{_PANEL}, sums AS (SELECT policy_id, CAST(count(*) AS DOUBLE) AS n, count(DISTINCT rel_year) AS nx, avg(p_yes) AS mean, sum(rel_year::DOUBLE) AS x1, sum(pow(rel_year, 2)) AS x2, sum(pow(rel_year, 3)) AS x3, sum(pow(rel_year, 4)) AS x4,
  sum(p_yes) AS y0, sum(rel_year * p_yes) AS y1, sum(pow(rel_year, 2) * p_yes) AS y2 FROM panel GROUP BY policy_id),
det AS (SELECT *, x4*(x2*n - x1*x1) - x3*(x3*n - x1*x2) + x2*(x3*x1 - x2*x2) AS dd FROM sums),
fit AS (SELECT policy_id, CAST(n AS BIGINT) AS n,
  CASE WHEN nx < 3 THEN 0 ELSE (y2*(x2*n - x1*x1) - x3*(y1*n - x1*y0) + x2*(y1*x1 - x2*y0)) / dd END AS a,
  CASE WHEN nx < 3 THEN 0 ELSE (x4*(y1*n - x1*y0) - y2*(x3*n - x1*x2) + x2*(x3*y0 - y1*x2)) / dd END AS b,
  CASE WHEN nx < 3 THEN mean ELSE (x4*(x2*y0 - x1*y1) - x3*(x3*y0 - x2*y1) + y2*(x3*x1 - x2*x2)) / dd END AS c FROM det)"""


@query(f"WITH {_FIT} SELECT policy_id, n, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c FROM fit")
def panel_quadratic(spark: SparkSession, d: str) -> DataFrame:
    fits = P.quadratic(panel(spark, d), ["policy_id"])
    return fits.select("policy_id", "n", *[F.round(c, 6).alias(c) for c in "abc"])


@query(f"WITH {_FIT} SELECT count(*) AS n, count(*) FILTER (a < 0 AND abs(-b / (2 * a)) <= 3) AS n_shape, round(count(*) FILTER (a < 0 AND abs(-b / (2 * a)) <= 3) / count(*), 3) AS fraction FROM fit")
def panel_nshape(spark: SparkSession, d: str) -> DataFrame:
    shaped = P.n_shaped(P.quadratic(panel(spark, d), ["policy_id"]))
    return shaped.agg(F.count("*").alias("n"), F.count_if("n_shape").alias("n_shape"), F.round(F.try_divide(F.count_if("n_shape"), F.count("*")), 3).alias("fraction"))


@query(f"""WITH {_PANEL}, v AS (SELECT *, p_yes - avg(p_yes) OVER (PARTITION BY policy_id) AS v, CAST((enactment_year // 10) * 10 AS INTEGER) AS decade FROM panel)
 SELECT decade, rel_year, count(*) AS n, round(avg(v), 6) AS mean, round(CASE WHEN count(*) > 1 THEN 1.96 * stddev_samp(v) / sqrt(count(*)) ELSE 0 END, 6) AS half_width FROM v GROUP BY decade, rel_year""")
def panel_ci(spark: SparkSession, d: str) -> DataFrame:
    return P.centred_interval(panel(spark, d))


@query(f"WITH {_PANEL} SELECT policy_id, rel_year, round(p_yes - avg(p_yes) OVER (PARTITION BY policy_id), 6) AS centred FROM panel")
def panel_center(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    return panel(spark, d).select("policy_id", "rel_year", F.round(F.col("p_yes") - F.avg("p_yes").over(Window.partitionBy("policy_id")), 6).alias("centred"))


_DELTA = f"{_PANEL}, delta AS (SELECT a.policy_id, b.p_yes - a.p_yes AS delta FROM panel a JOIN panel b USING (policy_id) WHERE a.rel_year = -1 AND b.rel_year = 1)"


@query(f"WITH {_DELTA} SELECT policy_id, round(delta, 6) AS delta FROM delta")
def panel_delta(spark: SparkSession, d: str) -> DataFrame:
    return P.anchored_deltas(panel(spark, d), -1, 1).select("policy_id", F.round("delta", 6).alias("delta"))


@query(f"""WITH {_DELTA}, s AS (SELECT count(*) AS n, avg(delta) AS mean, stddev_samp(delta) AS sd, count(*) FILTER (delta > 0) AS n_positive, count(*) FILTER (delta < 0) AS n_negative FROM delta),
 e AS (SELECT *, sd / sqrt(n) AS sem, mean / (sd / sqrt(n)) AS tt FROM s), f AS (SELECT *, abs(tt) / sqrt(2.0) AS a, 1 / (1 + 0.3275911 * abs(tt) / sqrt(2.0)) AS t FROM e)
 SELECT n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(sem, 6) AS sem, round(tt, 6) AS t, round(1 - {_ERF}, 6) AS p_value, n_positive, n_negative FROM f""")
def panel_delta_stats(spark: SparkSession, d: str) -> DataFrame:
    return P.delta_statistics(P.anchored_deltas(panel(spark, d), -1, 1))


@query(f"""WITH {_DELTA}, e AS (SELECT min(delta) AS lo, max(delta) AS hi, greatest(20, CAST(2 * floor(sqrt(count(*))) AS INTEGER)) AS bins FROM delta)
 SELECT CAST(least(floor((delta - lo) * bins / (hi - lo)), bins - 1) AS INTEGER) AS bin, count(*) AS n FROM delta, e GROUP BY 1""")
def panel_hist(spark: SparkSession, d: str) -> DataFrame:
    return P.histogram(P.anchored_deltas(panel(spark, d), -1, 1), "delta")


@query(f"""WITH {_DELTA}, r AS (SELECT *, row_number() OVER (ORDER BY delta DESC, policy_id) AS up, row_number() OVER (ORDER BY delta, policy_id) AS down FROM delta)
 SELECT 'up' AS side, up AS place, policy_id, round(delta, 6) AS delta FROM r WHERE up <= 5 UNION ALL SELECT 'down', down, policy_id, round(delta, 6) FROM r WHERE down <= 5""")
def panel_top_movers(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    deltas = P.anchored_deltas(panel(spark, d), -1, 1)
    ups = deltas.orderBy(F.desc("delta"), "policy_id").limit(5).withColumn("place", F.row_number().over(Window.orderBy(F.desc("delta"), "policy_id")).cast("long"))
    downs = deltas.orderBy("delta", "policy_id").limit(5).withColumn("place", F.row_number().over(Window.orderBy("delta", "policy_id")).cast("long"))
    both = ups.withColumn("side", F.lit("up")).unionByName(downs.withColumn("side", F.lit("down")))
    return both.select("side", "place", "policy_id", F.round("delta", 6).alias("delta"))


@query(f"WITH {_CURVE} SELECT count(*) AS n_points, round(arg_max(mean_z, rel_year) - arg_min(mean_z, rel_year), 6) AS rise FROM curve WHERE rel_year BETWEEN -10 AND 0 HAVING count(*) >= 2")
def panel_pre_rise(spark: SparkSession, d: str) -> DataFrame:
    curve = P.z_scored(panel(spark, d)).groupBy("rel_year").agg(F.avg("z").alias("mean_z"))
    return P.rise(curve.withColumn("_all", F.lit(1)), ["_all"]).drop("_all")


@query(f"""WITH {_Z}, c AS (SELECT r_name AS region, rel_year, avg(z) AS mean_z FROM z JOIN nation ON n_nationkey = policy_id JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
 SELECT region, count(*) AS n_points, round(arg_max(mean_z, rel_year) - arg_min(mean_z, rel_year), 6) AS rise FROM c WHERE rel_year BETWEEN -10 AND 0 GROUP BY region HAVING count(*) >= 2""")
def panel_rise_by_category(spark: SparkSession, d: str) -> DataFrame:
    place = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("policy_id"), F.col("r_name").alias("region"))
    curve = P.z_scored(panel(spark, d)).join(place, "policy_id").groupBy("region", "rel_year").agg(F.avg("z").alias("mean_z"))
    return P.rise(curve, ["region"])


@query(f"WITH {_VARIANT} SELECT policy_id, year_model, count(*) AS n_variants, round(avg(p_yes), 6) AS mean_p_yes, round(stddev_pop(p_yes), 6) AS std_p_yes FROM variant GROUP BY policy_id, year_model")
def variant_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return variants(spark, d).groupBy("policy_id", "year_model").agg(F.count("*").alias("n_variants"), F.round(F.avg("p_yes"), 6).alias("mean_p_yes"), F.round(F.stddev_pop("p_yes"), 6).alias("std_p_yes"))


@query(f"WITH {_VARIANT}, r AS (SELECT *, row_number() OVER (PARTITION BY policy_id, year_model ORDER BY variant_idx) AS k FROM variant) SELECT policy_id, year_model, count(*) AS n, round(avg(p_yes), 6) AS mean_p_yes FROM r WHERE k <= 12 GROUP BY 1, 2")
def variant_cap(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("policy_id", "year_model").orderBy("variant_idx"))
    return variants(spark, d).withColumn("k", nth).where("k <= 12").groupBy("policy_id", "year_model").agg(F.count("*").alias("n"), F.round(F.avg("p_yes"), 6).alias("mean_p_yes"))


@query(f"""WITH {_PANEL} SELECT rel_year, round(avg(p_yes) FILTER (policy_id < 12), 6) AS control, round(avg(p_yes) FILTER (policy_id >= 12), 6) AS treated,
 round(avg(p_yes) FILTER (policy_id >= 12) - avg(p_yes) FILTER (policy_id < 12), 6) AS difference FROM panel GROUP BY rel_year""")
def panel_condition_pivot(spark: SparkSession, d: str) -> DataFrame:
    sides = panel(spark, d).withColumn("run", F.when(F.col("policy_id") < 12, "control").otherwise("treated"))
    wide = sides.groupBy("rel_year").pivot("run", ["control", "treated"]).agg(F.avg("p_yes"))
    return wide.select("rel_year", F.round("control", 6).alias("control"), F.round("treated", 6).alias("treated"), F.round(F.col("treated") - F.col("control"), 6).alias("difference"))


@query(f"""WITH {_PANEL}, o AS (SELECT r_name AS region, min(p_yes) AS lo, max(p_yes) AS hi FROM panel JOIN nation ON n_nationkey = policy_id JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
 SELECT region, round(lo - CASE WHEN hi > lo THEN 0.2 * (hi - lo) ELSE 0.1 END, 6) AS y_low, round(hi + CASE WHEN hi > lo THEN 0.2 * (hi - lo) ELSE 0.1 END, 6) AS y_high FROM o""")
def panel_axis_limits(spark: SparkSession, d: str) -> DataFrame:
    place = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("policy_id"), F.col("r_name").alias("region"))
    spans = panel(spark, d).join(place, "policy_id").groupBy("region").agg(F.min("p_yes").alias("lo"), F.max("p_yes").alias("hi"))
    pad = F.when(F.col("hi") > F.col("lo"), 0.2 * (F.col("hi") - F.col("lo"))).otherwise(0.1)
    return spans.select("region", F.round(F.col("lo") - pad, 6).alias("y_low"), F.round(F.col("hi") + pad, 6).alias("y_high"))
