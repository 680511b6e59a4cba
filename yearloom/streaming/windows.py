"""Event-time windows, deduplication and year buckets as Structured Streaming queries."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yearloom.session import cut_lineage


def event_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream, with the schema of the files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16)
    path = f"{sf_dir}/{name}.parquet"
    if os.path.isfile(path):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(path)


def _folder(spark: SparkSession) -> str:
    """A new folder beside the session's checkpoints, which all executors share."""
    if spark.sparkContext.getCheckpointDir() is None:
        cut_lineage(spark.range(1))  # sets the folder from the session's setting, or the local fallback
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a streaming query over all that is there and returns its result table.

    The sink writes each micro-batch under its number, so a batch that is run again replaces itself. In complete mode
    the last batch is the result, in append mode all batches together.
    """
    spark, folder = stream.sparkSession, _folder(stream.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{number if mode == 'append' else 'last'}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = stream.schema
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")


def windowed(events: DataFrame, at: str, keys: list[str], size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Count and sum of value by window and keys; with `late`, state of windows older than that is dropped."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp"))
    timed = timed.withWatermark("_at", late) if late else timed
    window = F.window("_at", size, slide) if slide else F.window("_at", size)
    grouped = timed.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, at: str, keys: list[str], gap: str, late: str = "1 day") -> DataFrame:
    """Sessions of events no further apart than the gap."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    grouped = timed.groupBy(F.session_window("_at", gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def first_deliveries(events: DataFrame, at: str, key: str, late: str) -> DataFrame:
    """Each key once, whatever often it is delivered within the watermark."""
    return events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark([key]).drop("_at")


def year_buckets(events: DataFrame, year: str) -> DataFrame:
    """Rows by year, late rows included: state is one row a year, so nothing needs to be evicted."""
    return events.groupBy(year).agg(F.count("*").alias("n"))


def upsert_state(state: DataFrame, updates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest row of each key of a state table and its updates; an older update changes nothing."""
    both = state.unionByName(updates, allowMissingColumns=True)
    return both.groupBy(key).agg(F.max_by(F.struct(*[c for c in both.columns if c != key]), F.struct(*order)).alias("s")).select(key, "s.*")


def kept_state(stream: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Runs a stream over all that is there into a state table with one row a key, and returns the table.

    Each micro-batch writes a new version from the one before it, under its number: a batch that is run again after a failure
    replaces its own version, so the table is right whatever was lost.
    """
    spark, folder = stream.sparkSession, _folder(stream.sparkSession)

    def merge(batch: DataFrame, number: int) -> None:
        before = spark.createDataFrame([], stream.schema) if number == 0 else spark.read.schema(stream.schema).parquet(f"{folder}/version/{number - 1}")
        upsert_state(before, batch, key, order).select(*stream.columns).write.mode("overwrite").parquet(f"{folder}/version/{number}")
        merged.append(number)

    merged: list[int] = []
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/version/{max(merged)}") if merged else spark.createDataFrame([], stream.schema)
