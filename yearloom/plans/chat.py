"""Conversation queries on the messages of run and the rendered pairs of train."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from yearloom.operators import chat as C
from yearloom.plans.registry import query
from yearloom.session import table

_TURNS = """turns AS (SELECT DISTINCT record_id, turn, lower(trim(role)) AS role, coalesce(trim(content, ' '), '') AS content FROM run WHERE record_id IS NOT NULL)"""
_RENDER = f"""{_TURNS}, ren AS (SELECT record_id, string_agg(upper(role[1]) || role[2:] || ': ' || content, chr(10) || chr(10) ORDER BY turn, role, content) AS body FROM turns GROUP BY record_id)"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    return C.messages(table(spark, d, "run"), "record_id", "turn", "role", "content")


@query(f"WITH {_RENDER} SELECT record_id, md5(body) AS digest, length(body) AS n_chars FROM ren")
def chat_render(spark: SparkSession, d: str) -> DataFrame:
    body = _records(spark, d).select("record_id", C.rendered(F.col("messages")).alias("body"))
    return body.select("record_id", F.md5("body").alias("digest"), F.length("body").cast("long").alias("n_chars"))


@query(f"""WITH {_RENDER}, cut AS (SELECT record_id, body, contains(body, chr(10) || chr(10) || 'Assistant:') AS has, string_split(body, chr(10) || chr(10) || 'Assistant:')[-1] AS tail FROM ren)
 SELECT record_id, CASE WHEN has THEN length(body) - length(tail) ELSE 0 END AS prompt_chars, length(tail) AS response_chars FROM cut""")
def completion_view(spark: SparkSession, d: str) -> DataFrame:
    parts = _records(spark, d).select("record_id", C.split_prompt(C.rendered(F.col("messages"))).alias("p"))
    return parts.select("record_id", F.length("p.prompt").cast("long").alias("prompt_chars"), F.length("p.response").cast("long").alias("response_chars"))


@query(f"""WITH {_TURNS}, pos AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY turn, role, content) AS i FROM turns), lead AS (SELECT record_id, max(CASE WHEN i = 1 AND role = 'system' THEN 1 ELSE 0 END) AS sys FROM pos GROUP BY record_id),
 chk AS (SELECT record_id, count(*) AS n, bool_and(role = CASE WHEN (i - 1 - sys) % 2 = 0 THEN 'user' ELSE 'assistant' END) AS ok FROM pos JOIN lead USING (record_id) WHERE i > sys GROUP BY record_id),
 st AS (SELECT l.record_id, CASE WHEN coalesce(n, 0) < 2 THEN 'too_short' WHEN NOT ok THEN 'bad_roles' ELSE 'ok' END AS status FROM lead l LEFT JOIN chk USING (record_id)) SELECT status, count(*) AS n FROM st GROUP BY status""")
def chat_validate(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).groupBy(C.conversation_status(F.col("messages")).alias("status")).agg(F.count("*").alias("n"))


@query(rf"""WITH {_TURNS}, tok AS (SELECT record_id, role, len(list_filter(string_split_regex(content, '\s+'), lambda x: x <> '')) AS n FROM turns)
 SELECT record_id, sum(n)::BIGINT AS n_tokens, (coalesce(sum(n) FILTER (role = 'assistant'), 0))::BIGINT AS n_trained FROM tok GROUP BY record_id""")
def train_mask(spark: SparkSession, d: str) -> DataFrame:
    tokens = _records(spark, d).select("record_id", C.token_mask(F.col("messages")).alias("tokens"))
    return tokens.select("record_id", F.size("tokens").cast("long").alias("n_tokens"), F.aggregate(F.transform("tokens", lambda t: t["mask"].cast("long")), F.lit(0).cast("long"), lambda s, x: s + x).alias("n_trained"))


@query(f"""WITH {_TURNS}, pos AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY turn, role, content) AS i FROM turns),
 lead AS (SELECT record_id, max(CASE WHEN i = 1 AND role = 'system' THEN content END) AS sys, bool_or(i = 1 AND role = 'system') AND bool_or(i = 2 AND role = 'user') AS merge FROM pos GROUP BY record_id),
 m AS (SELECT record_id, i, role, CASE WHEN merge AND i = 2 THEN sys || chr(10) || chr(10) || content ELSE content END AS content FROM pos JOIN lead USING (record_id) WHERE NOT (merge AND i = 1)),
 z AS (SELECT record_id, max(i) AS last_i, arg_max(role, i) AS last_role FROM m GROUP BY record_id)
 SELECT record_id, md5(string_agg(upper(role[1]) || role[2:] || ': ' || content, chr(10) || chr(10) ORDER BY i)) AS digest FROM m JOIN z USING (record_id) WHERE last_role = 'assistant' AND i < last_i GROUP BY record_id""")
def completion_prompts(spark: SparkSession, d: str) -> DataFrame:
    """What stands before the last answer of each record, its system turn merged into the first question."""
    before = C.completion_messages(C.merged_system(F.col("messages")))
    prompts = _records(spark, d).select("record_id", before.alias("before")).where(F.size("before") > 0)
    return prompts.select("record_id", F.md5(C.rendered(F.col("before"))).alias("digest"))


_DOC = r"doc AS (SELECT doc_id, CAST(CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END AS BIGINT) AS n_tokens FROM documents WHERE text IS NOT NULL)"


def _counted(spark: SparkSession, d: str) -> DataFrame:
    from yearloom.functions.text import word_count

    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", word_count(F.col("text")).cast("long").alias("n_tokens"))


@query(f"""WITH {_DOC}, st AS (SELECT doc_id, n_tokens + 1 AS len, sum(n_tokens + 1) OVER (ORDER BY doc_id) - n_tokens - 1 AS start FROM doc), tot AS (SELECT (sum(len) // 512)::BIGINT AS whole FROM st),
 sp AS (SELECT doc_id, start, len, unnest(range((start // 512)::BIGINT, ((start + len - 1) // 512)::BIGINT + 1)) AS seq_id FROM st)
 SELECT doc_id, seq_id, (greatest(start, seq_id * 512) - start)::BIGINT AS first, (greatest(start, seq_id * 512) - seq_id * 512)::BIGINT AS "offset", (least(start + len, (seq_id + 1) * 512) - greatest(start, seq_id * 512))::BIGINT AS n FROM sp, tot WHERE seq_id < whole""")
def pack_tokens(spark: SparkSession, d: str) -> DataFrame:
    return C.packed_sequences(_counted(spark, d), "doc_id", "n_tokens", 512)


@query(f"""WITH {_DOC}, st AS (SELECT doc_id, n_tokens + 1 AS len, (sum(n_tokens + 1) OVER (ORDER BY doc_id) - n_tokens - 1)::BIGINT AS start FROM doc), tot AS (SELECT ((sum(len) - 1) // 512)::BIGINT AS whole FROM st),
 sp AS (SELECT doc_id, start, len, unnest(range(greatest(start - 1, 0) // 512, (start + len - 1) // 512 + 1)) AS seq_id FROM st)
 SELECT doc_id, seq_id, greatest(start, seq_id * 512) - start AS first, greatest(start, seq_id * 512) - seq_id * 512 AS "offset", least(start + len, seq_id * 512 + 513) - greatest(start, seq_id * 512) AS n FROM sp, tot WHERE seq_id < whole AND greatest(start, seq_id * 512) < least(start + len, seq_id * 512 + 513)""")
def pack_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Sequences of 513 tokens every 512, the last token being the next one's first."""
    return C.packed_sequences(_counted(spark, d), "doc_id", "n_tokens", 512, overlap=1)


@query(f"""WITH {_DOC}, st AS (SELECT doc_id, n_tokens + 1 AS len, sum(n_tokens + 1) OVER (ORDER BY doc_id) - n_tokens - 1 AS start FROM doc)
 SELECT (start // 4096)::BIGINT AS batch, count(*) AS n_docs, sum(len)::BIGINT AS n_tokens FROM st GROUP BY 1""")
def pack_stride(spark: SparkSession, d: str) -> DataFrame:
    placed = C.running_start(_counted(spark, d).withColumn("len", F.col("n_tokens") + 1), "doc_id", "len")
    return placed.groupBy(F.expr("start DIV 4096").alias("batch")).agg(F.count("*").alias("n_docs"), F.sum("len").alias("n_tokens"))


@query("SELECT record_id, turn, msg_id, lead(msg_id) OVER (PARTITION BY record_id ORDER BY turn, msg_id) AS next_msg FROM (SELECT DISTINCT record_id, turn, msg_id FROM run)")
def next_message_shift(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "run").select("record_id", "turn", "msg_id").distinct()
    return rows.withColumn("next_msg", F.lead("msg_id").over(Window.partitionBy("record_id").orderBy("turn", "msg_id")))


@query("SELECT msg_id, any_value(record_id) AS record_id, max(ingested_at) AS ingested_at, count(*) AS n_deliveries FROM run GROUP BY msg_id")
def run_latest_delivery(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "run").groupBy("msg_id").agg(F.max("record_id").alias("record_id"), F.max("ingested_at").alias("ingested_at"), F.count("*").alias("n_deliveries"))
