"""Selections that do not depend on partitioning: order comes from a hash of the key, never from rand or file order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: str, *keys: Column) -> Column:
    """The sort key of the deterministic shuffle: md5 of seed and keys. Same order in every engine that has md5."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in keys]))


def first_per_group(df: DataFrame, groups: list[str], order: list[Column], most: Column | int, bound: int | None = None) -> DataFrame:
    """At most so many rows of each group in the given order.

    Spark stops a group early, before the shuffle (window group limit), if it can see a number: give the greatest number as
    bound where `most` is a column.
    """
    nth = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    ranked = df.withColumn("_nth", nth)
    ranked = ranked if bound is None else ranked.where(F.col("_nth") <= bound)
    return ranked.where(F.col("_nth") <= most).drop("_nth")


def with_position(df: DataFrame, groups: list[str], order: list[Column], into: str = "pos") -> DataFrame:
    """0-based position of each row in its group."""
    return df.withColumn(into, (F.row_number().over(Window.partitionBy(*groups).orderBy(*order)) - 1).cast("long"))


def hash_position(df: DataFrame, groups: list[str], digest: Column, ties: list[Column], into: str = "pos", digits: int = 3) -> DataFrame:
    """0-based position of each row in its group by a hex digest, ties by the given columns.

    Ranked in two levels: cells of equal leading digits in parallel, then the rows of earlier cells are added, one row for each
    group and cell. No task holds a whole group. Groups may be null.
    """
    celled = df.withColumn("_digest", digest).withColumn("_cell", F.substring("_digest", 1, digits))
    inside = F.row_number().over(Window.partitionBy(*groups, "_cell").orderBy("_digest", *ties)) - 1
    before = Window.partitionBy(*groups).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    ahead = celled.groupBy(*groups, "_cell").agg(F.count("*").alias("_n")).withColumn("_n", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    on = F.col("x._cell") == F.col("y._cell")
    for key in groups:
        on = on & F.col(f"x.{key}").eqNullSafe(F.col(f"y.{key}"))
    placed = celled.withColumn("_inside", inside).alias("x").join(ahead.alias("y"), on)
    return placed.select(*[F.col(f"x.{c}") for c in df.columns], (F.col("x._inside") + F.col("y._n")).cast("long").alias(into))


def quota_fill(df: DataFrame, groups: list[str], priority: Column, order: list[Column], target: int) -> DataFrame:
    """Rows of first priority up to the target, the others filling what is left; shortfalls stay."""
    return first_per_group(df.withColumn("_priority", priority), groups, [F.col("_priority"), *order], target).drop("_priority")


def even_split(total: int, labels: list[str]) -> dict[str, int]:
    """A total over labels, the remainder to the first ones."""
    return {x: total // len(labels) + (i < total % len(labels)) for i, x in enumerate(labels)}


def stride(df: DataFrame, position: str, start: int, stop: int, step: int) -> DataFrame:
    """Rows at start, start + step, ... before stop of a stored position."""
    at = F.col(position)
    return df.where((at >= start) & (at < stop) & (F.pmod(at - start, F.lit(step)) == 0))


def interleaved(tasks: dict[str, DataFrame], repeats: dict[str, int], key: str, seed: str) -> DataFrame:
    """A shuffled mixture of tasks, each repeated; columns task, key, copy, ordered by hash."""
    parts = []
    for name, df in tasks.items():
        copies = F.explode(F.sequence(F.lit(0), F.lit(repeats.get(name, 1) - 1)))
        parts.append(df.select(F.lit(name).alias("task"), F.col(key).cast("string").alias("key"), copies.alias("copy")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.withColumn("shuffle_key", hash_order(seed, F.col("task"), F.col("key"), F.col("copy")))
