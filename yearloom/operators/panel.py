"""Panels of entities by year: relative years, normalised curves, slopes, shape tests, intervals, deltas.

Every operator takes a tidy table (policy_id, enactment_year, year_model, rel_year, p_yes) and keeps to declarative
aggregation, so the only shuffles are on policy_id and on rel_year. Rows without an enactment year or a value are
dropped when the table is made; groups with fewer than `least` points drop out where a statistic needs them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from yearloom.functions.statistics import slope, upper_tail

LEAST_POINTS = 5


def tidy(scores: DataFrame) -> DataFrame:
    """Adds rel_year and drops rows that have no enactment year or no value."""
    kept = scores.where(F.col("enactment_year").isNotNull() & F.col("p_yes").isNotNull())
    return kept.withColumn("rel_year", (F.col("year_model") - F.col("enactment_year")).cast("int"))


def z_scored(panel: DataFrame, least: int = LEAST_POINTS) -> DataFrame:
    """z of p_yes within its policy (population deviation); policies with few points or no spread are dropped."""
    own = Window.partitionBy("policy_id")
    scored = panel.withColumns({"_n": F.count("p_yes").over(own), "_mean": F.avg("p_yes").over(own), "_sd": F.stddev_pop("p_yes").over(own)})
    return scored.where((F.col("_n") >= least) & (F.col("_sd") > 0)).withColumn("z", (F.col("p_yes") - F.col("_mean")) / F.col("_sd")).drop("_n", "_mean", "_sd")


def z_curve(panel: DataFrame, least: int = LEAST_POINTS) -> DataFrame:
    """Mean z and number of policies by relative year."""
    return z_scored(panel, least).groupBy("rel_year").agg(F.round(F.avg("z"), 6).alias("mean_z"), F.count("*").alias("n"))


def raw_curve(panel: DataFrame, first: int, last: int) -> DataFrame:
    """Mean p_yes for every relative year of a range, null where there is none."""
    means = panel.groupBy("rel_year").agg(F.round(F.avg("p_yes"), 6).alias("mean_p_yes"), F.count("*").alias("n"))
    spine = panel.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("rel_year"))
    return spine.join(means, "rel_year", "left").select("rel_year", "mean_p_yes", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def slopes(panel: DataFrame, first: int = -10, last: int = 0, least: int = LEAST_POINTS) -> DataFrame:
    """Per policy over a range of relative years: points, slope, and last less first available value."""
    inside = panel.where(F.col("rel_year").between(first, last))
    each = inside.groupBy("policy_id").agg(
        F.count("*").alias("n"),
        F.round(slope(F.col("p_yes"), F.col("rel_year").cast("double")), 6).alias("slope"),
        F.round(F.max_by("p_yes", "rel_year") - F.min_by("p_yes", "rel_year"), 6).alias("delta"),
    )
    return each.where(F.col("n") >= least)


def sign_test(each: DataFrame, value: str = "slope") -> DataFrame:
    """One-sided sign test by normal approximation: n, positive, fraction, p; nulls for no rows."""
    n, pos = F.count(value), F.count_if(F.col(value) > 0)
    out = each.agg(n.alias("n"), pos.alias("n_positive"))
    z = (F.col("n_positive") - F.col("n") / 2) / F.sqrt(F.col("n") / 4)
    safe = F.when(F.col("n") > 0, F.round(upper_tail(z), 6))
    return out.select("n", "n_positive", F.round(F.try_divide("n_positive", "n"), 6).alias("fraction"), safe.alias("p_value"))


def quadratic(panel: DataFrame, keys: list[str], x: str = "rel_year", y: str = "p_yes") -> DataFrame:
    """Least-squares parabola a x^2 + b x + c from power sums and Cramer's rule; (0, 0, mean) if it is not determined."""
    v = F.col(x).cast("double")
    sums = panel.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        F.count("*").cast("double").alias("n"), F.count_distinct(x).alias("nx"), F.avg(y).alias("mean"),
        *[F.sum(F.pow(v, F.lit(float(k)))).alias(f"x{k}") for k in (1, 2, 3, 4)],
        *[F.sum(F.pow(v, F.lit(float(k))) * F.col(y)).alias(f"y{k}") for k in (0, 1, 2)],
    )
    det = "(x4*(x2*n - x1*x1) - x3*(x3*n - x1*x2) + x2*(x3*x1 - x2*x2))"
    parts = {
        "a": f"(y2*(x2*n - x1*x1) - x3*(y1*n - x1*y0) + x2*(y1*x1 - x2*y0)) / {det}",
        "b": f"(x4*(y1*n - x1*y0) - y2*(x3*n - x1*x2) + x2*(x3*y0 - y1*x2)) / {det}",
        "c": f"(x4*(x2*y0 - x1*y1) - x3*(x3*y0 - x2*y1) + y2*(x3*x1 - x2*x2)) / {det}",
    }
    fitted = sums.select(*keys, F.col("n").cast("long").alias("n"), *[
        F.when(F.col("nx") < 3, F.col("mean") if k == "c" else F.lit(0.0)).otherwise(F.expr(f"CASE WHEN nx >= 3 THEN {e} END")).alias(k) for k, e in parts.items()
    ])
    return fitted


def n_shaped(fits: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Whether a parabola opens downwards with its top within tolerance of 0."""
    top = F.expr("try_divide(-b, 2 * a)")
    return fits.withColumn("n_shape", (F.col("a") < 0) & F.coalesce(F.abs(top) <= tolerance, F.lit(False)))


def centred_interval(panel: DataFrame) -> DataFrame:
    """By decade of enactment and relative year: mean of values centred per policy and half of the 95 % interval."""
    own = Window.partitionBy("policy_id")
    centred = panel.withColumn("v", F.col("p_yes") - F.avg("p_yes").over(own)).withColumn("decade", F.expr("(enactment_year DIV 10) * 10").cast("int"))
    half = F.when(F.count("*") > 1, 1.96 * F.stddev_samp("v") / F.sqrt(F.count("*"))).otherwise(0.0)
    return centred.groupBy("decade", "rel_year").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(half, 6).alias("half_width"))


def anchored_deltas(panel: DataFrame, first: int, last: int) -> DataFrame:
    """Value at one relative year less the value at another, for policies that have both; one pass, no self join."""
    at = [F.max(F.when(F.col("rel_year") == r, F.col("p_yes"))) for r in (first, last)]
    both = panel.where(F.col("rel_year").isin(first, last)).groupBy("policy_id").agg(at[0].alias("v0"), at[1].alias("v1"))
    return both.where("v0 IS NOT NULL AND v1 IS NOT NULL").select("policy_id", (F.col("v1") - F.col("v0")).alias("delta"))


def delta_statistics(deltas: DataFrame) -> DataFrame:
    """n, mean, sample deviation, standard error, t, two-sided normal p, and the signs."""
    d = F.col("delta")
    out = deltas.agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"), F.count_if(d > 0).alias("n_positive"), F.count_if(d < 0).alias("n_negative"))
    sem = F.col("sd") / F.sqrt("n")
    t = F.try_divide(F.col("mean"), sem)
    return out.select("n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round(sem, 6).alias("sem"), F.round(t, 6).alias("t"), F.round(2 * upper_tail(F.abs(t)), 6).alias("p_value"), "n_positive", "n_negative")


def histogram(values: DataFrame, column: str) -> DataFrame:
    """Equal-width bins, max(20, 2 floor(sqrt n)) of them; the greatest value falls into the last bin."""
    edge = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.greatest(F.lit(20), 2 * F.floor(F.sqrt(F.count(column))).cast("int")).alias("bins"))
    cell = F.least(F.floor(F.coalesce(F.try_divide((F.col(column) - F.col("lo")) * F.col("bins"), F.col("hi") - F.col("lo")), F.lit(0.0))), F.col("bins") - 1)
    return values.where(F.col(column).isNotNull()).join(F.broadcast(edge)).groupBy(cell.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def rise(curve: DataFrame, keys: list[str], first: int = -10) -> DataFrame:
    """Last value at or before 0 less the first value from `first` on; at least two points."""
    before = curve.where(F.col("rel_year").between(first, 0) & F.col("mean_z").isNotNull())
    made = before.groupBy(*keys).agg(F.count("*").alias("n_points"), F.round(F.max_by("mean_z", "rel_year") - F.min_by("mean_z", "rel_year"), 6).alias("rise"))
    return made.where("n_points >= 2")
