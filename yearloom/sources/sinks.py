"""Sinks: partitioned parquet, JSON lines with dead letters, tidy CSV, markdown tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_years(df: DataFrame, folder: str, year: str = "year", done: DataFrame | None = None) -> None:
    """One partition folder a year; years of `done` are skipped, late rows of other years are kept."""
    fresh = df if done is None else df.join(done.select(year).distinct(), year, "left_anti")
    fresh.write.mode("append").partitionBy(year).parquet(folder)


def write_parquet(df: DataFrame, path: str, force: bool = False) -> None:
    """Overwrites with force, else leaves what exists."""
    df.write.mode("overwrite" if force else "ignore").parquet(path)


def write_records(df: DataFrame, folder: str, status: str) -> None:
    """Rows of status ok to records, all others with their status to failures; both as JSON lines."""
    df.where(F.col(status) == "ok").drop(status).write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/records")
    df.where(F.col(status) != "ok").write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/failures")


def write_tidy(df: DataFrame, path: str, columns: list[str], digits: int = 6) -> None:
    """CSV with a fixed order of columns; doubles with a fixed number of digits, null as an empty field."""
    kinds = dict(df.dtypes)
    df.select(*[F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", c)).alias(c) if kinds[c] == "double" else F.col(c) for c in columns]).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def markdown(df: DataFrame, most_rows: int = 500) -> str:
    """A result table as markdown; tables above most_rows are an error, not cut."""
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("-" if v is None else str(v) for v in r) + " |" for r in rows])


def write_pool(pool: DataFrame, manifest: DataFrame, folder: str) -> None:
    """A pool with its positions, by year, and beside it the manifest of the years as JSON lines."""
    pool.write.mode("overwrite").partitionBy("year").parquet(f"{folder}/pool")
    manifest.write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/manifest")


def write_results(results: DataFrame, folder: str, experiment: str, evaluator: str) -> None:
    """Measures of an evaluator as JSON lines, each in an envelope that names the experiment and the evaluator."""
    enveloped = results.select(F.lit(experiment).alias("experiment"), F.lit(evaluator).alias("evaluator"), F.struct(*results.columns).alias("results"))
    enveloped.write.mode("overwrite").option("ignoreNullFields", False).json(folder)
