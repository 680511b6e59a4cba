"""Recency windows over years: weights, exact apportionment, pools with nested prefixes, assembly, manifests."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from yearloom.operators.selection import hash_order, hash_position


@dataclass(frozen=True)
class Spec:
    """A window over the years up to a model year: roll (latest W), exp (half-life H), cum (all), single (latest)."""

    kind: str
    size: float | None = None

    def __str__(self) -> str:
        return self.kind if self.size is None else f"{self.kind}{self.size:g}"


def parse_spec(token: str) -> Spec:
    """roll10, exp2.5, cum or single; anything else, and sizes below 1 year for roll or not above 0, is an error."""
    if token in ("cum", "single"):
        return Spec(token)
    found = re.fullmatch(r"(roll|exp)(\d+(?:\.\d+)?)", token)
    if not found or float(found[2]) <= 0 or (found[1] == "roll" and (float(found[2]) < 1 or "." in found[2])):
        raise ValueError(f"unknown window spec: {token!r}")
    return Spec(found[1], float(found[2]))


def year_weights(model_years: DataFrame, pools: DataFrame, spec: Spec) -> DataFrame:
    """model_year, source_year, weight: no later source than the model year, weights of a model year sum to 1.

    model_years: model_year; pools: source_year. Both hold one row a year, so the theta join stays small.
    """
    pairs = model_years.select("model_year").distinct().join(pools.select("source_year").distinct(), F.col("source_year") <= F.col("model_year"))
    latest = F.row_number().over(Window.partitionBy("model_year").orderBy(F.desc("source_year")))
    if spec.kind in ("roll", "single"):
        pairs = pairs.withColumn("_k", latest).where(F.col("_k") <= (1 if spec.kind == "single" else int(spec.size)))
    raw = F.pow(F.lit(0.5), (F.col("model_year") - F.col("source_year")) / F.lit(float(spec.size))) if spec.kind == "exp" else F.lit(1.0)
    return pairs.withColumn("_w", raw).select("model_year", "source_year", (F.col("_w") / F.sum("_w").over(Window.partitionBy("model_year"))).alias("weight"))


def allocate(weights: DataFrame, sizes: DataFrame, per_year: int | None = None, total: int | None = None) -> DataFrame:
    """Whole counts by largest remainder, ties to the latest year; then clipped to the pool without redistribution.

    A source year that has no row in sizes is not clipped.

    weights: model_year, source_year, weight; sizes: source_year, n. Exactly one budget must be given.
    """
    if (per_year is None) == (total is None):
        raise ValueError("give per_year or total")
    of_model = Window.partitionBy("model_year")
    budget = F.lit(total).cast("long") if total is not None else F.count("*").over(of_model) * F.lit(per_year)
    shared = weights.withColumn("_budget", budget).withColumn("_exact", F.round(F.col("weight") * F.col("_budget"), 9))
    shared = shared.withColumn("_floor", F.floor("_exact")).withColumn("_left", F.col("_budget") - F.sum("_floor").over(of_model))
    nth = F.row_number().over(of_model.orderBy(F.desc(F.col("_exact") - F.col("_floor")), F.desc("source_year")))
    shared = shared.withColumn("_want", F.col("_floor") + (nth <= F.col("_left")).cast("long"))
    return shared.join(sizes, "source_year", "left").select("model_year", "source_year", "weight", F.col("_want").alias("wanted"), F.least("_want", "n").alias("n_rows"))


def stable_order(rows: DataFrame, year: str, key: str, seed: int = 0) -> DataFrame:
    """Position of each row in the shuffle of its year; adding rows keeps the order of the others, so prefixes nest."""
    return hash_position(rows, [year], hash_order(str(seed), F.col(year), F.col(key)), [F.col(key)])


def build_pool(rows: DataFrame, year: str, key: str, target: int, seed: int = 0) -> DataFrame:
    """target rows of each year: its distinct rows in stable order, then repeats drawn by hash until the target.

    Columns: year, pos, key, resampled. Years without rows have no pool.
    """
    ordered = stable_order(rows.select(year, key).distinct(), year, key, seed)
    held = ordered.where(F.col("pos") < target).select(year, "pos", key, F.lit(False).alias("resampled"))
    counts = ordered.groupBy(year).agg(F.count("*").alias("n")).where(F.col("n") < target)
    extra = counts.withColumn("pos", F.explode(F.sequence(F.col("n"), F.lit(target - 1).cast("long"))))
    draw = F.conv(F.substring(hash_order(str(seed), F.lit("draw"), F.col(year), F.col("pos")), 1, 8), 16, 10).cast("long")
    extra = extra.withColumn("source_pos", F.pmod(draw, F.col("n"))).drop("n")
    drawn = extra.join(ordered.withColumnRenamed("pos", "source_pos"), [year, "source_pos"])
    return held.unionByName(drawn.select(year, "pos", key, F.lit(True).alias("resampled")))


def pool_manifest(pool: DataFrame, year: str, target: int) -> DataFrame:
    """n_distinct, n_total, resampled and target of each pool."""
    return pool.groupBy(year).agg(
        F.count_if(~F.col("resampled")).alias("n_distinct"), F.count("*").alias("n_total"), F.count_if("resampled").alias("n_resampled"), F.lit(target).cast("long").alias("target")
    )


def assemble(pool: DataFrame, counts: DataFrame, year: str, key: str, seed: int = 0) -> DataFrame:
    """The records of each model year: the first n_rows of every source year's pool, in one shuffled order."""
    picked = pool.join(counts.select("model_year", F.col("source_year").alias(year), "n_rows"), year).where(F.col("pos") < F.col("n_rows"))
    picked = picked.select("model_year", F.col(year).alias("source_year"), F.col("pos").alias("source_pos"), key)
    return hash_position(picked, ["model_year"], hash_order(str(seed), F.col("model_year"), F.col("source_year"), F.col("source_pos")), [F.col("source_year"), F.col("source_pos")])


def assembly_manifest(assembled: DataFrame, manifest: DataFrame, weights: DataFrame, year: str) -> DataFrame:
    """Per model and source year: rows, effective unique rows and the weight."""
    held = assembled.groupBy("model_year", "source_year").agg(F.count("*").alias("n"))
    joined = held.join(manifest.select(F.col(year).alias("source_year"), "n_distinct"), "source_year", "left").join(weights, ["model_year", "source_year"])
    return joined.select("model_year", "source_year", "n", F.least("n", F.coalesce("n_distinct", "n")).alias("effective_unique"), F.round("weight", 6).alias("weight"))


def experiment_name(year: int, backend: str, spec: Spec, x: int, sft: bool = False) -> str:
    return f"policy_{year}_{backend}_{spec}_n{x}{'_sft' if sft else ''}"
