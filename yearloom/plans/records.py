"""Record-level queries: labels, options, calendars, schedules, token arrays, evaluators end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from yearloom.functions import records as R
from yearloom.functions.statistics import argmax
from yearloom.operators import bestfit
from yearloom.operators import evaluation as E
from yearloom.plans.registry import query
from yearloom.session import table


@query("SELECT vec_id, CASE WHEN label BETWEEN 0 AND 3 THEN substr('ABCD', label + 1, 1) END AS letter FROM embeddings")
def label_decode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", R.decoded_label(F.col("label")).alias("letter"))


@query("SELECT o_orderkey, 5 AS n, CAST(o_custkey AS VARCHAR) AS first_value FROM orders")
def options_parse(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("a ) "), "o_custkey", F.lit(" , b ) 2 , c ) "), "o_orderkey", F.lit(" , d ) 4 , e ) none"))
    made = table(spark, d, "orders").select("o_orderkey", R.options(text).alias("v"))
    return made.select("o_orderkey", F.size("v").alias("n"), F.col("v")[0].alias("first_value"))


@query("""SELECT event_id, kind, benchmark_question || CASE kind WHEN 'yes_no' THEN ' Answer Yes or No.' ELSE ' How far do you agree?' END AS prompt, CASE kind WHEN 'yes_no' THEN institution ELSE domain END AS answer
 FROM battery, (VALUES ('yes_no'), ('scale')) k(kind)""")
def two_records(spark: SparkSession, d: str) -> DataFrame:
    pair = R.two_records(F.col("benchmark_question"), F.col("institution"), F.col("domain"))
    return table(spark, d, "battery").select("event_id", F.explode(pair).alias("r")).select("event_id", "r.*")


@query("SELECT o_orderkey, CAST(o_custkey + 1 AS VARCHAR) AS last_result, 2 AS n_tags FROM orders")
def calculator_tags(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("so <<"), "o_orderkey", F.lit("*1="), "o_orderkey", F.lit(">> then <<"), "o_custkey", F.lit("+1="), F.col("o_custkey") + 1, F.lit(">> done"))
    made = table(spark, d, "orders").select("o_orderkey", R.calculator_results(text).alias("v"))
    return made.select("o_orderkey", F.element_at("v", -1).alias("last_result"), F.size("v").alias("n_tags"))


@query("SELECT event_year AS year, CAST(floor((event_year - 1789) / 2) + 1 AS INTEGER) AS congress, CASE WHEN event_year >= 2011 THEN 'daily' ELSE 'bound' END AS edition, count(*) AS n FROM battery WHERE event_year IS NOT NULL GROUP BY 1, 2, 3")
def congress_years(spark: SparkSession, d: str) -> DataFrame:
    years = table(spark, d, "battery").where("event_year IS NOT NULL").groupBy(F.col("event_year").alias("year")).agg(F.count("*").alias("n"))
    return years.select("year", R.congress(F.col("year")).alias("congress"), R.edition(F.col("year")).alias("edition"), "n")


@query("""WITH t AS (SELECT max(pos) + 1 AS total, greatest(1.0, floor((max(pos) + 1) * 0.03::DOUBLE + 0.5)) AS warm FROM train), p AS (SELECT DISTINCT pos FROM train WHERE pos IS NOT NULL)
 SELECT pos, round(CASE WHEN pos < warm THEN 0.001::DOUBLE * (pos + 1) / warm ELSE 0.001::DOUBLE * (0.1::DOUBLE + 0.9::DOUBLE * 0.5::DOUBLE * (1 + cos(3.141592653589793::DOUBLE * least(1.0, (pos - warm) / greatest(1.0, total - warm))))) END, 9) AS rate FROM p, t""")
def learning_rates(spark: SparkSession, d: str) -> DataFrame:
    """The rate at every position that a row of train stands at; the schedule ends with the last one."""
    steps = table(spark, d, "train").where("pos IS NOT NULL").select("pos").distinct()
    total = table(spark, d, "train").agg((F.max("pos") + 1).alias("total"))
    return steps.join(F.broadcast(total)).select("pos", F.round(R.learning_rate(F.col("pos"), F.col("total"), 0.001), 9).alias("rate"))


@query("""WITH c AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) SELECT user_id, k AS step, event_id FROM c WHERE k IN (5, 10, 20, 40)""")
def ladder_milestones(spark: SparkSession, d: str) -> DataFrame:
    steps = [s for s, _ in R.ladder_steps("0.125:a,0.25:b,0.5:c,1:d", 40)]
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select("user_id", "event_id", nth.cast("long").alias("step")).where(F.col("step").isin(steps))


@query("SELECT p_partkey, CAST(length(p_name) - length(replace(p_name, 'e', '')) AS INTEGER) AS n_letters, replace(lower(p_name), ' ', '-') AS slug FROM part")
def letter_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", R.letter_count(F.col("p_name"), "e").alias("n_letters"), R.slug(F.col("p_name")).alias("slug"))


_TOK = "tok AS (SELECT item_id, string_split(question, ' ') AS t, lead(string_split(question, ' ')) OVER (ORDER BY item_id) AS u FROM heldout)"


@query(f"WITH {_TOK} SELECT item_id, CAST(coalesce(list_position(list_transform(range(1, least(len(t), len(u)) + 1), lambda i: t[i] <> u[i]), true) - 1, least(len(t), len(u))) AS INTEGER) AS n_common, CAST(len(t[-8:]) AS INTEGER) AS n_crop FROM tok WHERE u IS NOT NULL")
def prefix_and_crop(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "heldout").select("item_id", F.split("question", " ").alias("t"))
    paired = items.withColumn("u", F.lead("t").over(Window.orderBy("item_id"))).where("u IS NOT NULL")
    return paired.select("item_id", R.common_prefix(F.col("t"), F.col("u")).alias("n_common"), F.size(R.cropped(F.col("t"), 8)).alias("n_crop"))


@query("SELECT msg_id, md5(CASE WHEN contains(content, 'Answer:') THEN split_part(content, 'Answer:', 1) || 'Answer:' ELSE rtrim(content, ' ') || chr(10) || 'Answer:' END) AS digest FROM (SELECT DISTINCT msg_id, content FROM run WHERE sft_variant = 'cot' AND lower(trim(role)) = 'assistant' AND content IS NOT NULL)")
def reasoning_prefix(spark: SparkSession, d: str) -> DataFrame:
    run = table(spark, d, "run").where((F.col("sft_variant") == "cot") & (F.lower(F.trim("role")) == "assistant") & F.col("content").isNotNull())
    return run.select("msg_id", "content").distinct().select("msg_id", F.md5(R.reasoned_prefix(F.col("content"))).alias("digest"))


_SCORED = "s AS (SELECT item_id, expected, subset, [-1.0 - (length(question) % 7) / 10.0 - (length(question) % 4 = i)::INTEGER * -1 FOR i IN [0, 1, 2, 3]] AS lp FROM heldout WHERE expected IN ('A', 'B', 'C', 'D'))"


@query(f"""WITH {_SCORED}, p AS (SELECT *, substr('ABCD', CAST(list_position(lp, list_max(lp)) AS INTEGER), 1) = expected AS ok FROM s)
 SELECT split_part(item_id, '-', 1) AS suite, count(*) AS n, count(*) FILTER (ok) AS n_correct, round(count(*) FILTER (ok) / count(*), 6) AS accuracy FROM p GROUP BY 1""")
def choice_evaluator(spark: SparkSession, d: str) -> DataFrame:
    """Items, prompt, injected scorer, argmax, accuracy by suite."""

    def scorer(prompts: list[str], options: list[list[str]]) -> list[list[float]]:
        return [[-1.0 - (len(p) % 7) / 10 + (len(p) % 4 == i) for i in range(len(o))] for p, o in zip(prompts, options)]

    items = table(spark, d, "heldout").where(F.col("expected").isin("A", "B", "C", "D")).withColumn("options", F.array(*[F.lit(x) for x in "ABCD"]))
    scored = E.score_options(items, "item_id", "question", "options", scorer).join(items.select("item_id", "expected"), "item_id")
    named = scored.withColumn("suite", F.substring_index("item_id", "-", 1))
    return E.accuracy(named, R.decoded_label(argmax(F.col("logprobs"))) == F.col("expected"), ["suite"])


@query()
def pack_best_fit(spark: SparkSession, d: str) -> DataFrame:
    from yearloom.functions.text import word_count

    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", word_count(F.col("text")).alias("n_tokens"))
    return bestfit.best_fit_rows(docs, "doc_id", "n_tokens", 512)


@query("""SELECT generator, count(*) FILTER (year < 1960) AS before_1960, count(*) FILTER (year BETWEEN 1960 AND 1989) AS to_1989, count(*) FILTER (year > 1989) AS after_1989 FROM run WHERE year IS NOT NULL GROUP BY generator""")
def stage_pivot(spark: SparkSession, d: str) -> DataFrame:
    stage = F.when(F.col("year") < 1960, "before_1960").when(F.col("year") < 1990, "to_1989").otherwise("after_1989")
    staged = table(spark, d, "run").where("year IS NOT NULL").withColumn("stage", stage)
    return staged.groupBy("generator").pivot("stage", ["before_1960", "to_1989", "after_1989"]).count().na.fill(0)


_ASK = "Respond to the following question by rating your agreement"


@query(f"""SELECT event_id, k AS kind, md5(CASE k WHEN 'yes_no' THEN q || chr(10) || chr(10) || 'Answer:' WHEN 'scale' THEN '{_ASK}:' || chr(10) || chr(10) || q || chr(10) || chr(10) || 'Answer:'
 WHEN 'yes_no_chat' THEN 'User: ' || q || chr(10) || chr(10) || 'Think step by step about the reasons, then answer Yes or No.' || chr(10) || chr(10) || 'Assistant:'
 ELSE 'User: {_ASK}.' || chr(10) || chr(10) || q || chr(10) || chr(10) || 'Think step by step about the reasons, then give your rating.' || chr(10) || chr(10) || 'Assistant:' END) AS digest
 FROM (SELECT event_id, benchmark_question AS q FROM battery WHERE benchmark_question IS NOT NULL), (VALUES ('yes_no'), ('scale'), ('yes_no_chat'), ('scale_chat')) v(k)""")
def probe_prompts(spark: SparkSession, d: str) -> DataFrame:
    """All forms of each policy question."""
    q = F.col("benchmark_question")
    forms = {"yes_no": R.probe_prompt(q, "yes_no"), "scale": R.probe_prompt(q, "scale"), "yes_no_chat": R.probe_prompt(q, "yes_no", True, True), "scale_chat": R.probe_prompt(q, "scale", True, True)}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.md5(v).alias("digest")) for k, v in forms.items()]))
    return table(spark, d, "battery").where("benchmark_question IS NOT NULL").select("event_id", each.alias("p")).select("event_id", "p.*")


@query("SELECT o_orderkey, o_orderpriority AS answer, CASE WHEN substr('ABCDE', CAST(o_orderpriority[1] AS INTEGER), 1) = 'E' THEN NULL ELSE substr('QXZJ', CAST(o_orderpriority[1] AS INTEGER), 1) END AS letter FROM orders")
def moved_letters(spark: SparkSession, d: str) -> DataFrame:
    """The first figure of a priority as a letter of A to E, moved to four other letters; the fifth has none."""
    native = F.substring(F.lit("ABCDE"), F.substring("o_orderpriority", 1, 1).cast("int"), F.lit(1))
    return table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("answer"), R.moved_letter(native, "ABCD", "QXZJ").alias("letter"))


@query("SELECT congress, y AS year, count(*) AS n FROM (SELECT CAST(floor((event_year - 1789) / 2) + 1 AS INTEGER) AS congress FROM battery WHERE event_year IS NOT NULL), range(-1, 3) r(k), LATERAL (SELECT CAST(1789 + 2 * (congress - 1) + k AS INTEGER) AS y) GROUP BY 1, 2")
def congress_reach(spark: SparkSession, d: str) -> DataFrame:
    """Years that a Congress may have sat in, one more on both sides, with the policies of that Congress."""
    of = table(spark, d, "battery").where("event_year IS NOT NULL").select(R.congress(F.col("event_year")).alias("congress"))
    return of.select("congress", F.explode(R.congress_years(F.col("congress"), 1)).alias("year")).groupBy("congress", "year").agg(F.count("*").alias("n"))


@query("SELECT lab AS label, count(m.target_label) AS n FROM (VALUES ('Yes'), ('No'), ('Strongly agree'), ('Agree'), ('Uncertain'), ('Disagree'), ('Strongly disagree')) l(lab) LEFT JOIN (SELECT DISTINCT msg_id, target_label FROM run WHERE lower(trim(role)) = 'assistant') m ON m.target_label = lab GROUP BY lab")
def label_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Counts of all stated labels, those that never occur with 0."""
    labels = spark.createDataFrame([(x,) for x in ("Yes", "No", "Strongly agree", "Agree", "Uncertain", "Disagree", "Strongly disagree")], "label string")
    counts = table(spark, d, "run").where(F.lower(F.trim("role")) == "assistant").select("msg_id", "target_label").distinct().groupBy(F.col("target_label").alias("label")).agg(F.count("*").alias("n"))
    return F.broadcast(labels).join(counts, "label", "left").na.fill(0, ["n"])
