"""Ranks and running sums inside groups of any size, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cells_for(df: DataFrame, rows: int = 500_000, least: int = 64) -> int:
    """Cells so that none holds many more than `rows` rows, whatever the number of rows; df is counted, so it should be cheap to read."""
    return max(least, -(-df.count() // rows))


def spread_rank(df: DataFrame, keys: list[str], order: Column, weight: Column | None = None, cells: int = 64, into: str = "rank") -> DataFrame:
    """Adds a 0-based rank inside the groups of keys and, with a weight, the sum of the weights before the row.

    The rows of a group are ordered by a hash of `order` (which must be unique in the group) and dealt into cells by
    the leading part of that hash. Cells are ranked in parallel; the totals of earlier cells, one row for each group
    and cell, are added. The hash order is the same for every partitioning.
    """
    hashed = df.withColumn("_h", F.xxhash64(order)).withColumn("_cell", F.floor((F.col("_h").cast("double") / 2.0**64 + 0.5) * cells).cast("int"))
    measure = [F.count("*").alias("_n")] + ([F.sum(weight).alias("_w")] if weight is not None else [])
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = hashed.groupBy(*keys, "_cell").agg(*measure).withColumn("_n", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = Window.partitionBy(*keys, "_cell").orderBy("_h", order)
    out = hashed.withColumn(into, F.row_number().over(inside) - 1)
    if weight is not None:
        totals = totals.withColumn("_w", F.coalesce(F.sum("_w").over(before), F.lit(0)))
        out = out.withColumn(f"{into}_sum", F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in [*keys, "_cell"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    joined = out.alias("x").join(totals.alias("y"), on)
    kept = [F.col(f"x.{c}") for c in df.columns]
    kept.append((F.col(f"x.{into}") + F.col("y._n")).alias(into))
    if weight is not None:
        kept.append((F.coalesce(F.col(f"x.{into}_sum"), F.lit(0)) + F.col("y._w")).alias(f"{into}_sum"))
    return joined.select(*kept)
