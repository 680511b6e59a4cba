"""Replies of a generator: JSON made from the stored texts, parsed back; work lists of replies and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from yearloom.operators import parsing as P
from yearloom.operators import selection as S
from yearloom.plans.registry import query
from yearloom.session import table


@query("""SELECT DISTINCT synth_id, metadata.doc_type AS doc_type, 'idea ' || metadata.idea_idx AS concept, coalesce(metadata.tone, '') AS tone
 FROM synth WHERE metadata.doc_type IS NOT NULL AND metadata.idea_idx IS NOT NULL""")
def parse_ideas(spark: SparkSession, d: str) -> DataFrame:
    """Ideas of the records' metadata, written as replies and read again."""
    rows = table(spark, d, "synth").select("synth_id", "metadata").distinct()
    idea = F.struct(F.col("metadata.doc_type").alias("doc_type"), F.concat(F.lit("idea "), F.col("metadata.idea_idx")).alias("concept"), F.col("metadata.tone").alias("tone"))
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(idea).alias("ideas"))), F.lit("\n```"))
    return rows.select("synth_id", F.explode(P.ideas(reply)).alias("i")).select("synth_id", "i.*")


@query("SELECT DISTINCT synth_id, md5(text) AS digest, length(text) AS n_chars FROM synth WHERE text <> ''")
def parse_single_document(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts under one of three keys or as a JSON string, by the record's number."""
    rows = table(spark, d, "synth").where("text IS NOT NULL").select("synth_id", "text").distinct()
    kind = F.pmod("synth_id", F.lit(4))
    keyed = [F.to_json(F.struct(F.col("text").alias(key))) for key in ("document", "text", "content")]
    quoted = F.regexp_replace(F.to_json(F.array("text")), r"(?s)^\[(.*)\]$", "$1")
    reply = F.when(kind == 0, keyed[0]).when(kind == 1, keyed[1]).when(kind == 2, keyed[2]).otherwise(quoted)
    parsed = rows.select("synth_id", P.single_document(reply).alias("t")).where("t <> ''")
    return parsed.select("synth_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n_chars"))


@query("SELECT item_id, question, expected AS answer FROM heldout WHERE question IS NOT NULL AND contains(expected, '####')")
def parse_problems(spark: SparkSession, d: str) -> DataFrame:
    pair = F.struct(F.col("question"), F.col("expected").alias("answer"))
    reply = F.to_json(F.struct(F.array(pair).alias("questions")))
    return table(spark, d, "heldout").select("item_id", F.explode(P.problems(reply)).alias("p")).select("item_id", "p.*")


@query("SELECT event_id, trim(v) AS variant FROM (SELECT event_id, unnest([benchmark_question, adoption_object, '']) AS v FROM battery) WHERE trim(v) <> ''")
def parse_variants(spark: SparkSession, d: str) -> DataFrame:
    reply = F.to_json(F.struct(F.array("benchmark_question", F.concat(F.lit("  "), "adoption_object"), F.lit(" ")).alias("variants")))
    return table(spark, d, "battery").select("event_id", F.explode(P.variants(reply)).alias("variant"))


@query("SELECT s.synth_id, s.metadata.idea_idx AS idea_idx, d.doc_id AS seed_id, d.source FROM (SELECT DISTINCT synth_id, metadata FROM synth WHERE metadata.idea_idx IS NOT NULL) s JOIN documents d ON d.doc_id = s.metadata.seed_idx")
def write_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Ideas with the seed document that they came from."""
    ideas = table(spark, d, "synth").where("metadata.idea_idx IS NOT NULL").select("synth_id", F.col("metadata.idea_idx").alias("idea_idx"), F.col("metadata.seed_idx").cast("long").alias("seed_id")).distinct()
    seeds = table(spark, d, "documents").select(F.col("doc_id").alias("seed_id"), "source")
    return ideas.join(seeds, "seed_id").select("synth_id", "idea_idx", "seed_id", "source")


@query(r"""WITH m AS (SELECT DISTINCT msg_id, lower(trim(role)) AS role, content, TRY_CAST(regexp_extract(custom_id, '(?:^|;)year=([^;]*)', 1) AS INTEGER) AS year, TRY_CAST(regexp_extract(custom_id, '(?:^|;)seed=([^;]*)', 1) AS INTEGER) AS seed FROM run),
 q AS (SELECT year, seed, count(*) AS n_requests FROM m WHERE role = 'user' AND year IS NOT NULL AND seed IS NOT NULL GROUP BY 1, 2), a AS (SELECT year, seed, count(*) AS n_replies, count(content) AS n_filled FROM m WHERE role = 'assistant' GROUP BY 1, 2)
 SELECT year, seed, n_requests, coalesce(n_replies, 0) AS n_replies, coalesce(n_filled, 0) AS n_filled, CASE WHEN coalesce(n_filled, 0) = 0 THEN 'missing' WHEN n_filled < n_requests THEN 'partial' ELSE 'complete' END AS status FROM q LEFT JOIN a USING (year, seed)""")
def replies_to_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests and their replies by the key inside custom_id; both sides are counted before they meet, so no pair of messages is made."""
    rows = table(spark, d, "run").select("msg_id", F.lower(F.trim("role")).alias("role"), "content", P.request_key(F.col("custom_id")).alias("k")).distinct()
    keyed = rows.select("role", "content", "k.*")
    asked = keyed.where("role = 'user' AND year IS NOT NULL AND seed IS NOT NULL").groupBy("year", "seed").agg(F.count("*").alias("n_requests"))
    given = keyed.where("role = 'assistant'").groupBy("year", "seed").agg(F.count("*").alias("n_replies"), F.count("content").alias("n_filled"))
    both = asked.join(given, ["year", "seed"], "left").na.fill(0, ["n_replies", "n_filled"])
    return both.withColumn("status", F.when(F.col("n_filled") == 0, "missing").when(F.col("n_filled") < F.col("n_requests"), "partial").otherwise("complete"))


_SCALE = ["Strongly agree", "Agree", "Uncertain", "Disagree", "Strongly disagree"]


@query(r"""WITH a AS (SELECT DISTINCT msg_id, content, target_label FROM run WHERE lower(trim(role)) = 'assistant')
 SELECT CASE WHEN content IS NULL OR NOT rtrim(content, ' ') LIKE '%?' THEN CASE WHEN coalesce(target_label IN ('Yes', 'No'), false) THEN 'bad_question' ELSE 'bad_both' END WHEN NOT coalesce(target_label IN ('Yes', 'No'), false) THEN 'bad_label' ELSE 'ok' END AS status, count(*) AS n FROM a GROUP BY 1""")
def record_status(spark: SparkSession, d: str) -> DataFrame:
    replies = table(spark, d, "run").where(F.lower(F.trim("role")) == "assistant").select("msg_id", "content", "target_label").distinct()
    first = P.text_record_status(F.col("content"), F.col("target_label"), ["Yes", "No"])
    status = F.when((first == "bad_question") & ~F.coalesce(F.col("target_label").isin("Yes", "No"), F.lit(False)), "bad_both").otherwise(first)
    return replies.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(r"""WITH a AS (SELECT DISTINCT record_id, turn, msg_id, lower(trim(role)) AS role, content, target_label FROM run WHERE record_id IS NOT NULL),
 p AS (SELECT *, lag(content) OVER w AS question, lag(role) OVER w AS before FROM a WINDOW w AS (PARTITION BY record_id ORDER BY turn, msg_id)),
 s AS (SELECT CASE WHEN coalesce(NOT rtrim(split_part(question, chr(10), 1), ' ') LIKE '%?', true) THEN 'bad_question' WHEN NOT coalesce(target_label IN ('Yes', 'No', 'Ja', 'Nein'), false) THEN 'bad_verdict'
  WHEN coalesce(trim(content, ' '), '') = '' THEN 'no_reasoning' ELSE 'ok' END AS status FROM p WHERE role = 'assistant' AND before = 'user') SELECT status, count(*) AS n FROM s GROUP BY 1""")
def answered_record_status(spark: SparkSession, d: str) -> DataFrame:
    """Answered questions of the chats: the question, its label and the reasoning."""
    rows = table(spark, d, "run").where("record_id IS NOT NULL").select("record_id", "turn", "msg_id", F.lower(F.trim("role")).alias("role"), "content", "target_label").distinct()
    w = Window.partitionBy("record_id").orderBy("turn", "msg_id")
    pairs = rows.withColumn("question", F.lag("content").over(w)).withColumn("before", F.lag("role").over(w)).where("role = 'assistant' AND before = 'user'")
    status = P.written_record_status(F.substring_index("question", "\n", 1), F.col("target_label"), F.lit("Agree"), F.col("content"), ["Yes", "No", "Ja", "Nein"], _SCALE)
    return pairs.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


_BLOCKS = """case_block AS (SELECT year, doc_id FROM (SELECT year, doc_id, row_number() OVER (PARTITION BY year ORDER BY md5('7:' || doc_id), doc_id) AS k FROM documents WHERE year IS NOT NULL AND source LIKE 'bulk_corpus:%') WHERE k <= 5),
speech AS (SELECT year, doc_id FROM documents WHERE year IS NOT NULL AND source LIKE 'gst:%'), wire AS (SELECT year, doc_id FROM documents WHERE year IS NOT NULL AND source LIKE 'newswire:%')"""


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of a discourse pool: the first cases of a year by hash, all speeches, all wire reports."""
    docs = table(spark, d, "documents").where("year IS NOT NULL").select("year", "doc_id", "source")
    kind = F.when(F.col("source").startswith("bulk_corpus:"), "case").when(F.col("source").startswith("gst:"), "speech").when(F.col("source").startswith("newswire:"), "wire")
    kinds = docs.select("year", "doc_id", kind.alias("block")).where("block IS NOT NULL")
    case = S.first_per_group(kinds.where("block = 'case'"), ["year"], [S.hash_order("7", F.col("doc_id")), F.col("doc_id")], 5)
    return case.unionByName(kinds.where("block <> 'case'"))


@query(f"""WITH {_BLOCKS}, kept AS (SELECT year FROM case_block INTERSECT SELECT year FROM speech),
 pool AS (SELECT year, doc_id, 'case' AS block FROM case_block UNION ALL SELECT year, doc_id, 'speech' FROM speech UNION ALL SELECT year, doc_id, 'wire' FROM wire)
 SELECT year, doc_id, block, row_number() OVER (PARTITION BY year ORDER BY md5('11:' || year || ':' || doc_id), doc_id) - 1 AS pos FROM pool JOIN kept USING (year)""")
def discourse_pool(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of a year joined and shuffled; a year without cases or without speeches has no pool."""
    blocks = _blocks(spark, d)
    years = blocks.groupBy("year").agg(F.count_if(F.col("block") == "case").alias("c"), F.count_if(F.col("block") == "speech").alias("s")).where("c > 0 AND s > 0").select("year")
    return S.hash_position(blocks.join(years, "year"), ["year"], S.hash_order("11", F.col("year"), F.col("doc_id")), [F.col("doc_id")]).select("year", "doc_id", "block", "pos")


@query(f"""WITH {_BLOCKS}, y AS (SELECT DISTINCT year FROM documents WHERE year IS NOT NULL)
 SELECT year, year NOT IN (SELECT year FROM case_block) AS no_case, year NOT IN (SELECT year FROM speech) AS no_speech, year NOT IN (SELECT year FROM wire) AS no_wire FROM y
 WHERE year NOT IN (SELECT year FROM case_block) OR year NOT IN (SELECT year FROM speech) OR year NOT IN (SELECT year FROM wire)""")
def missing_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Years that lack a block, with the blocks that they lack."""
    held = _blocks(spark, d).groupBy("year").agg(*[F.count_if(F.col("block") == b).alias(b) for b in ("case", "speech", "wire")])
    years = table(spark, d, "documents").where("year IS NOT NULL").select("year").distinct().join(held, "year", "left").na.fill(0, ["case", "speech", "wire"])
    return years.select("year", *[(F.col(b) == 0).alias(f"no_{b}") for b in ("case", "speech", "wire")]).where("no_case OR no_speech OR no_wire")
