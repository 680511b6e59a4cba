"""Corpus queries: selection, cleaning, tagging, screening, parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from yearloom.functions import text as X
from yearloom.operators import joins as J
from yearloom.operators import parsing as R
from yearloom.plans.registry import query
from yearloom.session import table

_FLAT = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_WORDS = r"CAST(CASE WHEN trim(regexp_replace({0}, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace({0}, '\s+', ' ', 'g')), ' ')) END AS INTEGER)"
_CORPUS = f"corpus AS (SELECT doc_id, source, lang, year, text, {_WORDS.format('text')} AS word_count FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '\\S'))"


def corpus(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.col("text").rlike(r"\S"))
    return docs.select("doc_id", "source", "lang", "year", "text", X.word_count(F.col("text")).alias("word_count"))


@query(f"WITH {_CORPUS} SELECT doc_id, 'corpus:' || source AS source, year, word_count FROM corpus WHERE lang IN ('en') AND word_count BETWEEN 100 AND 3000 AND year IS NOT NULL")
def corpus_select(spark: SparkSession, d: str) -> DataFrame:
    kept = corpus(spark, d).where(F.col("lang").isin("en") & F.col("word_count").between(100, 3000) & F.col("year").isNotNull())
    return kept.select("doc_id", F.concat(F.lit("corpus:"), "source").alias("source"), "year", "word_count")


@query(f"WITH {_CORPUS} SELECT source, count(*) AS n_docs, CAST(median(word_count) AS DOUBLE) AS median_words, CAST(round(sum(word_count) * 1.3, 3) AS DOUBLE) AS est_tokens FROM corpus WHERE source LIKE 'bulk_corpus:%' AND word_count >= 200 GROUP BY source")
def corpus_legal_slice_stats(spark: SparkSession, d: str) -> DataFrame:
    kept = corpus(spark, d).where(F.col("source").startswith("bulk_corpus:") & (F.col("word_count") >= 200))
    return kept.groupBy("source").agg(F.count("*").alias("n_docs"), F.median("word_count").alias("median_words"), F.round(F.sum("word_count") * F.lit(1.3), 3).alias("est_tokens"))


@query(r"SELECT doc_id, round(length(regexp_replace(text, '[^\p{L}\p{N}\s]', '', 'g')) / length(text), 6) AS clean_share, length(regexp_replace(text, '[^\p{L}\p{N}\s]', '', 'g')) / length(text) < 0.5 AS garbage FROM documents WHERE length(text) > 0")
def corpus_garbage(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.length("text") > 0)
    return docs.select("doc_id", F.round(X.clean_share(F.col("text")), 6).alias("clean_share"), X.is_garbage(F.col("text")).alias("garbage"))


@query("""WITH l AS (SELECT 'lang' AS field, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents UNION ALL SELECT 'year', CAST(year AS VARCHAR) FROM documents),
 c AS (SELECT field, value, count(*) AS n, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, value NULLS FIRST) AS k, count(*) OVER (PARTITION BY field) AS n_values FROM l GROUP BY field, value)
 SELECT field, value, n, greatest(n_values - 20, 0) AS n_more FROM c WHERE k <= 20""")
def corpus_value_counts(spark: SparkSession, d: str) -> DataFrame:
    long = table(spark, d, "documents").select(F.expr("stack(3, 'lang', lang, 'source', source, 'year', CAST(year AS STRING)) AS (field, value)"))
    counts = long.groupBy("field", "value").agg(F.count("*").alias("n"))
    own = Window.partitionBy("field")
    ranked = counts.withColumn("k", F.row_number().over(own.orderBy(F.desc("n"), F.asc_nulls_first("value")))).withColumn("n_values", F.count("*").over(own))
    return ranked.where("k <= 20").select("field", "value", "n", F.greatest(F.col("n_values") - 20, F.lit(0)).alias("n_more"))


@query("""SELECT origin, count(*) AS n, count(text) AS n_text, coalesce(sum(length(text)), 0)::BIGINT AS n_chars FROM (SELECT 'documents:' || source AS origin, text FROM documents
 UNION ALL SELECT 'synth:' || metadata.generator, text FROM synth UNION ALL SELECT 'run:' || generator, content FROM run) GROUP BY origin""")
def corpus_union(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.concat(F.lit("documents:"), "source").alias("origin"), "text")
    synth = table(spark, d, "synth").select(F.concat(F.lit("synth:"), "metadata.generator").alias("origin"), "text")
    run = table(spark, d, "run").select(F.concat(F.lit("run:"), "generator").alias("origin"), F.col("content").alias("text"))
    return docs.unionByName(synth).unionByName(run).groupBy("origin").agg(F.count("*").alias("n"), F.count("text").alias("n_text"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def corpus_by_source(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))


@query(r"SELECT synth_id, ingested_at, trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM synth WHERE text LIKE '%<%'")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "synth").where(F.col("text").contains("<")).select("synth_id", "ingested_at", X.squash(X.without_tags(F.col("text"))).alias("plain"))


@query(f"""WITH w AS (SELECT doc_id, string_split({_FLAT.format('text')}, ' ') AS w FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, unnest(range(0, len(w), 400)) AS a, w FROM w)
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS INTEGER) AS chunk, len(w[a + 1:a + 400]) AS n_words, md5(array_to_string(w[a + 1:a + 400], ' ')) AS digest FROM c WHERE len(w[a + 1:a + 400]) >= 200""")
def word_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(X.chunks(F.col("text"), 400, 200)).alias("chunk", "body"))
    return docs.select("doc_id", "chunk", F.size(F.split("body", " ")).cast("long").alias("n_words"), F.md5("body").alias("digest"))


@query(f"SELECT doc_id, CASE WHEN length({_FLAT.format('text')}) > 120 THEN {_FLAT.format('text')}[1:120] || ' ...' ELSE {_FLAT.format('text')} END AS short FROM documents WHERE text IS NOT NULL")
def squash_truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.cut_to(X.squash(F.col("text")), 120, " ...").alias("short"))


_WORK = "SELECT o_orderkey, 'first #### ' || o_custkey || ',000 then #### ' || o_orderkey || '.0' AS work FROM orders"


@query(f"SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS answer FROM ({_WORK})")
def gsm_answer_last(spark: SparkSession, d: str) -> DataFrame:
    work = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("first #### "), "o_custkey", F.lit(",000 then #### "), "o_orderkey", F.lit(".0")).alias("work"))
    return work.select("o_orderkey", X.last_marked_number(F.col("work")).alias("answer"))


@query(f"SELECT o_orderkey, replace(regexp_extract(work, '#### (-?[0-9.,]+)', 1), ',', '') AS answer FROM ({_WORK})")
def gsm_answer_first(spark: SparkSession, d: str) -> DataFrame:
    work = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("first #### "), "o_custkey", F.lit(",000 then #### "), "o_orderkey", F.lit(".0")).alias("work"))
    return work.select("o_orderkey", X.first_marked_number(F.col("work")).alias("answer"))


@query(r"SELECT DISTINCT synth_id, trim(regexp_replace(regexp_replace(text, '[^()\[\]<>{}]', '', 'g'), '(.)', '\1 ', 'g')) AS brackets FROM synth WHERE regexp_matches(text, '[()\[\]<>{}]')")
def bracket_norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "synth").where(F.col("text").rlike(r"[()\[\]<>{}]")).select("synth_id", X.brackets_only(F.col("text")).alias("brackets")).distinct()


_PHRASES = r"""phrase AS (SELECT DISTINCT trim(p) AS phrase FROM (SELECT unnest(string_split(regexp_replace(lower(policy_or_case), ' of [0-9]{4}$', ''), ' v. ')) AS p FROM battery WHERE policy_or_case IS NOT NULL) WHERE length(trim(p)) >= 5)"""


def _phrases(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "battery").where("policy_or_case IS NOT NULL")
    part = F.explode(F.split(F.regexp_replace(F.lower("policy_or_case"), r" of [0-9]{4}$", ""), r" v\. "))
    return names.select(part.alias("phrase")).select(F.trim("phrase").alias("phrase")).where(F.length("phrase") >= 5).distinct()


@query(f"WITH {_PHRASES} SELECT phrase FROM phrase")
def catalog_phrases(spark: SparkSession, d: str) -> DataFrame:
    return _phrases(spark, d)


@query(f"WITH {_PHRASES} SELECT doc_id, (SELECT min(phrase) FROM phrase WHERE contains(lower(text), phrase)) AS term FROM documents WHERE text IS NOT NULL AND EXISTS (SELECT 1 FROM phrase WHERE contains(lower(text), phrase))")
def banned_first_term(spark: SparkSession, d: str) -> DataFrame:
    phrases = sorted(r[0] for r in _phrases(spark, d).collect())
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", J.first_phrase(F.col("text"), phrases).alias("term")).where("term IS NOT NULL")


@query(f"WITH {_PHRASES} SELECT count(*) AS n_kept, sum(length(text))::BIGINT AS n_chars FROM documents WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM phrase WHERE contains(lower(text), phrase))")
def banned_screen(spark: SparkSession, d: str) -> DataFrame:
    phrases = sorted(r[0] for r in _phrases(spark, d).collect())
    kept = table(spark, d, "documents").where(F.col("text").isNotNull()).where(J.first_phrase(F.col("text"), phrases).isNull())
    return kept.agg(F.count("*").alias("n_kept"), F.sum(F.length("text")).alias("n_chars"))


_TOPICS = {"money": ["tax", "tariff", "bank"], "work": ["labor", "wage", "union"], "land": ["crop", "timber", "water"], "home": ["housing", "rent"]}
_TOPIC_SQL = "topic(topic, kw) AS (VALUES " + ", ".join(f"('{t}', '{k}')" for t, ks in _TOPICS.items() for k in ks) + ")"


@query(f"WITH {_TOPIC_SQL} SELECT DISTINCT doc_id, topic FROM documents, topic WHERE contains(lower(text), kw)")
def keyword_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(J.matched_topics(F.col("text"), _TOPICS)).alias("topic"))


@query(f"WITH {_TOPIC_SQL}, t AS (SELECT DISTINCT doc_id, lang, topic, n_chars FROM documents, topic WHERE contains(lower(text), kw)) SELECT topic, coalesce(lang, 'UNKNOWN') AS lang, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM t GROUP BY 1, 2")
def topic_table(spark: SparkSession, d: str) -> DataFrame:
    tagged = table(spark, d, "documents").select(F.coalesce("lang", F.lit("UNKNOWN")).alias("lang"), "n_chars", F.explode(J.matched_topics(F.col("text"), _TOPICS)).alias("topic"))
    return tagged.groupBy("topic", "lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


@query("""SELECT doc_id, string_split(source, ':')[1] AS prefix, CASE string_split(source, ':')[1] WHEN 'gst' THEN 'speech' WHEN 'fomc' THEN 'minutes' WHEN 'bulk_corpus' THEN 'law' WHEN 'newswire' THEN 'press' WHEN 'weekly' THEN 'press' ELSE 'UNKNOWN' END AS taxon FROM documents""")
def taxonomy_join(spark: SparkSession, d: str) -> DataFrame:
    return _with_taxon(spark, d).select("doc_id", "prefix", F.coalesce("taxon", F.lit("UNKNOWN")).alias("taxon"))


@query("SELECT DISTINCT string_split(source, ':')[1] AS prefix FROM documents WHERE string_split(source, ':')[1] NOT IN ('gst', 'fomc', 'bulk_corpus', 'newswire', 'weekly')")
def taxonomy_unmapped(spark: SparkSession, d: str) -> DataFrame:
    return _with_taxon(spark, d).where("taxon IS NULL").select("prefix").distinct()


def _with_taxon(spark: SparkSession, d: str) -> DataFrame:
    taxa = spark.createDataFrame([("gst", "speech"), ("fomc", "minutes"), ("bulk_corpus", "law"), ("newswire", "press"), ("weekly", "press")], "prefix string, taxon string")
    return table(spark, d, "documents").select("doc_id", F.substring_index("source", ":", 1).alias("prefix")).join(F.broadcast(taxa), "prefix", "left")


@query("SELECT event_id, coalesce(nullif(trim(benchmark_question), ''), 'Should the United States have ' || adoption_object || '?') AS question FROM battery")
def battery_question(spark: SparkSession, d: str) -> DataFrame:
    fallback = F.concat(F.lit("Should the United States have "), "adoption_object", F.lit("?"))
    return table(spark, d, "battery").select("event_id", F.coalesce(F.nullif(F.trim("benchmark_question"), F.lit("")), fallback).alias("question"))


_MODELS = "models AS (SELECT DISTINCT year AS model_year FROM train WHERE year IS NOT NULL), policies AS (SELECT event_id, event_year AS enactment_year FROM battery WHERE event_year IS NOT NULL)"


def _windowed(spark: SparkSession, d: str, **bounds: int) -> DataFrame:
    models = table(spark, d, "train").where("year IS NOT NULL").select(F.col("year").alias("model_year")).distinct()
    policies = table(spark, d, "battery").where("event_year IS NOT NULL").select("event_id", F.col("event_year").alias("enactment_year"))
    before, after = J.window_bounds(**bounds)
    return J.year_window(models, policies, before, after).select("model_year", "event_id", "enactment_year", "rel_year")


@query(f"WITH {_MODELS} SELECT model_year, event_id, enactment_year, model_year - enactment_year AS rel_year FROM models JOIN policies ON enactment_year BETWEEN model_year - 10 AND model_year + 10")
def battery_window_symmetric(spark: SparkSession, d: str) -> DataFrame:
    return _windowed(spark, d, window_years=10)


@query(f"WITH {_MODELS} SELECT model_year, event_id, enactment_year, model_year - enactment_year AS rel_year FROM models JOIN policies ON model_year - enactment_year BETWEEN -10 AND 20")
def battery_window_rel(spark: SparkSession, d: str) -> DataFrame:
    return _windowed(spark, d, rel_max=20)


@query(f"WITH {_MODELS} SELECT model_year, event_id, enactment_year, model_year - enactment_year AS rel_year FROM models JOIN policies ON enactment_year BETWEEN model_year AND model_year + 10")
def battery_window_lookback(spark: SparkSession, d: str) -> DataFrame:
    return _windowed(spark, d, lookback_years=10)


_NAME = r"'^policy_(\d{4})_([a-z]+)_((?:roll|exp)\d+(?:\.\d+)?|cum|single)_n(\d+)((?:_[a-z]+)?)$'"


@query(f"""SELECT experiment, count(*) AS n, TRY_CAST(regexp_extract(experiment, {_NAME}, 1) AS INTEGER) AS year, nullif(regexp_extract(experiment, {_NAME}, 2), '') AS backend,
 nullif(regexp_extract(experiment, {_NAME}, 3), '') AS spec, TRY_CAST(regexp_extract(experiment, {_NAME}, 4) AS INTEGER) AS x, CASE WHEN regexp_matches(experiment, {_NAME}) THEN regexp_extract(experiment, {_NAME}, 5) = '_sft' END AS sft
 FROM train WHERE experiment IS NOT NULL GROUP BY experiment""")
def experiment_names(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "train").where("experiment IS NOT NULL").groupBy("experiment").agg(F.count("*").alias("n"))
    return counts.withColumn("p", X.experiment_parts(F.col("experiment"))).select("experiment", "n", "p.*")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


_REPLY = r"""reply AS (SELECT DISTINCT msg_id, content, regexp_replace(regexp_replace(content, '^\s*```[A-Za-z]*\s*', ''), '\s*```\s*$', '') AS body FROM run WHERE lower(trim(role)) = 'assistant' AND contains(content, '"documents"')),
parsed AS (SELECT msg_id, CASE WHEN json_valid(body) THEN json_extract_string(body, '$.documents[*]') END AS docs FROM reply)"""


def _replies(spark: SparkSession, d: str) -> DataFrame:
    run = table(spark, d, "run").where((F.lower(F.trim("role")) == "assistant") & F.col("content").contains('"documents"'))
    return run.select("msg_id", "content").distinct()


@query(f"WITH {_REPLY} SELECT msg_id, CAST(generate_subscripts(docs, 1) - 1 AS INTEGER) AS doc_idx, md5(unnest(docs)) AS digest FROM parsed WHERE docs IS NOT NULL")
def json_documents(spark: SparkSession, d: str) -> DataFrame:
    return R.exploded_documents(_replies(spark, d), "content", ["msg_id"]).select("msg_id", "doc_idx", F.md5("text").alias("digest"))


@query(f"WITH {_REPLY} SELECT CASE WHEN docs IS NULL OR len(docs) = 0 THEN 'parse_failed' ELSE 'ok' END AS status, count(*) AS n FROM parsed GROUP BY 1")
def dead_letters(spark: SparkSession, d: str) -> DataFrame:
    return _replies(spark, d).groupBy(R.reply_status(F.col("content")).alias("status")).agg(F.count("*").alias("n"))


@query(r"""SELECT year, seed, count(DISTINCT record_id) AS n_records FROM (SELECT record_id, TRY_CAST(regexp_extract(custom_id, '(?:^|;)year=([^;]*)', 1) AS INTEGER) AS year, TRY_CAST(regexp_extract(custom_id, '(?:^|;)seed=([^;]*)', 1) AS INTEGER) AS seed FROM run) GROUP BY ALL""")
def request_key_decode(spark: SparkSession, d: str) -> DataFrame:
    keyed = table(spark, d, "run").select("record_id", R.request_key(F.col("custom_id")).alias("k"))
    return keyed.groupBy(F.col("k.year").alias("year"), F.col("k.seed").alias("seed")).agg(F.count_distinct("record_id").alias("n_records"))


@query("SELECT o_orderkey AS fact_id, l_linenumber AS line, year(o_orderdate)::INTEGER AS year, l_quantity AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE year(o_orderdate) BETWEEN 1996 AND 1997 AND o_orderpriority = '1-URGENT'")
def pipe_join_facts(spark: SparkSession, d: str) -> DataFrame:
    """The filtered index decides which facts are read on; AQE broadcasts the index if it is small, else both are shuffled once."""
    index = table(spark, d, "orders").where(F.year("o_orderdate").between(1996, 1997) & (F.col("o_orderpriority") == "1-URGENT"))
    index = index.select(F.col("o_orderkey").alias("fact_id"), F.year("o_orderdate").alias("year"))
    facts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("fact_id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"))
    return facts.join(index, "fact_id").select("fact_id", "line", "year", "quantity")
