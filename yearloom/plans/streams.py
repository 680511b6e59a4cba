"""Streaming queries over the files of events and run; each equals its batch result once all files are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yearloom.plans.registry import query
from yearloom.session import table
from yearloom.streaming import windows as S


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    made = S.run_available(S.windowed(S.event_stream(spark, d, "events"), "ts", ["event_type"], "1 day"))
    return made.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL (6 * k) HOUR AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events, range(0, 4) r(k) GROUP BY 1, 2")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    made = S.run_available(S.windowed(S.event_stream(spark, d, "events"), "ts", ["event_type"], "24 hours", "6 hours"))
    return made.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    made = S.run_available(S.sessions(S.event_stream(spark, d, "events"), "ts", ["user_id"], "2 hours"))
    return made.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT DISTINCT msg_id FROM run WHERE created_at IS NOT NULL")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    messages = S.event_stream(spark, d, "run").select("msg_id", "created_at").where("created_at IS NOT NULL")
    return S.run_available(S.first_deliveries(messages, "created_at", "msg_id", "3650 days"), "append").select("msg_id")


@query("SELECT year, count(*) AS n FROM run GROUP BY year")
def stream_year_buckets(spark: SparkSession, d: str) -> DataFrame:
    return S.run_available(S.year_buckets(S.event_stream(spark, d, "run").select("year"), "year")).select("year", "n")


@query("SELECT user_id, event_type, count(*) AS n FROM events JOIN customer ON c_custkey = user_id WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2")
def stream_static_join(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    joined = S.event_stream(spark, d, "events").join(customers, "user_id").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return S.run_available(joined)


@query("SELECT year, count(*) AS n_requests, count(content) AS n_answered, CASE WHEN count(content) = count(*) THEN 'completed' ELSE 'partial' END AS status FROM run WHERE lower(trim(role)) = 'assistant' GROUP BY year")
def batch_state(spark: SparkSession, d: str) -> DataFrame:
    replies = table(spark, d, "run").where(F.lower(F.trim("role")) == "assistant")
    return replies.groupBy("year").agg(F.count("*").alias("n_requests"), F.count("content").alias("n_answered")).withColumn("status", F.when(F.col("n_answered") == F.col("n_requests"), "completed").otherwise("partial"))


@query("""WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2)
 SELECT * FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)""")
def stream_closed_days(spark: SparkSession, d: str) -> DataFrame:
    """Days that the watermark has passed, each given out once and then forgotten; the last two days stay open."""
    made = S.run_available(S.windowed(S.event_stream(spark, d, "events"), "ts", ["event_type"], "1 day", late="2 days"), "append")
    return made.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("SELECT msg_id, arg_max(role, ingested_at) AS role, max(ingested_at) AS ingested_at FROM run GROUP BY msg_id")
def stream_state(spark: SparkSession, d: str) -> DataFrame:
    """The latest delivery of each message in a state table."""
    messages = S.event_stream(spark, d, "run").select("msg_id", "role", "ingested_at")
    return S.kept_state(messages, "msg_id", ["ingested_at"])
