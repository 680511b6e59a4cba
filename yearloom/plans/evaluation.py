"""Scoring queries. Lens: the first numbers of an embedding are option logits, the label picks the gold option."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yearloom.functions.statistics import argmax, softmax
from yearloom.operators import evaluation as E
from yearloom.plans.registry import query
from yearloom.session import table


def _scores(spark: SparkSession, d: str, k: int) -> DataFrame:
    raw = table(spark, d, "embeddings")
    return raw.select("vec_id", "label", F.slice("embedding", 1, k).cast("array<double>").alias("logits"), (F.col("label") % k).alias("gold"))


def _logits(k: int) -> str:
    return f"s AS (SELECT vec_id, label, list_transform(embedding[1:{k}], lambda x: CAST(x AS DOUBLE)) AS logits, label % {k} AS gold FROM embeddings), p AS (SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM s)"


@query(f"WITH {_logits(2)} SELECT vec_id, round(e[1] / list_sum(e), 6) AS p_yes FROM p")
def softmax_yesno(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d, 2).select("vec_id", F.round(softmax(F.col("logits"))[0], 6).alias("p_yes"))


@query(f"WITH {_logits(5)} SELECT vec_id, round((e[1] + 0.5 * e[2] - 0.5 * e[4] - e[5]) / list_sum(e), 6) AS score FROM p")
def softmax_likert(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d, 5).select("vec_id", F.round(E.likert_score(F.col("logits")), 6).alias("score"))


@query(f"WITH {_logits(4)} SELECT count(*) AS n, count(*) FILTER (list_position(logits, list_max(logits)) - 1 = gold) AS n_correct, round(count(*) FILTER (list_position(logits, list_max(logits)) - 1 = gold) / count(*), 6) AS accuracy FROM p")
def argmax_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return E.accuracy(_scores(spark, d, 4), argmax(F.col("logits")) == F.col("gold"))


@query(f"""WITH {_logits(4)}, c AS (SELECT CASE WHEN label % 3 = 0 THEN 'unknown' WHEN label % 3 = 1 THEN 'middle' ELSE 'high' END AS part, (list_position(logits, list_max(logits)) - 1 = gold)::INTEGER AS ok FROM p)
 SELECT part, count(*) AS n, round(avg(ok), 6) AS accuracy FROM c GROUP BY part UNION ALL SELECT 'overall', count(*), round(avg(ok), 6) FROM c""")
def accuracy_rollup(spark: SparkSession, d: str) -> DataFrame:
    subset = F.when(F.col("label") % 3 == 1, "middle").when(F.col("label") % 3 == 2, "high")
    return E.accuracy_rollup(_scores(spark, d, 4).withColumn("subset", subset), argmax(F.col("logits")) == F.col("gold"), "subset")


@query(f"WITH {_logits(4)} SELECT label, vec_id, round(avg((list_position(logits, list_max(logits)) - 1 = gold)::INTEGER) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING), 6) AS running_accuracy FROM p")
def running_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return E.running_accuracy(_scores(spark, d, 4), "vec_id", ["label"], argmax(F.col("logits")) == F.col("gold")).select("label", "vec_id", "running_accuracy")


@query(f"""WITH {_logits(3)} SELECT label, [round(avg(e[1] / list_sum(e)), 6), round(avg(e[2] / list_sum(e)), 6), round(avg(e[3] / list_sum(e)), 6)] AS mean_probs FROM p GROUP BY label""")
def variant_mean_probs(spark: SparkSession, d: str) -> DataFrame:
    return E.mean_distribution(_scores(spark, d, 3).withColumn("probs", softmax(F.col("logits"))), ["label"], "probs")


@query("SELECT round(sum(CASE WHEN l_linenumber > 0 THEN l_discount * 10 ELSE 0 END) / (ln(2) * sum(l_quantity)), 6) AS bits_per_byte FROM lineitem WHERE l_partkey >= 0")
def bits_per_byte(spark: SparkSession, d: str) -> DataFrame:
    losses = table(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("nats"), F.col("l_quantity").alias("n_bytes"), F.col("l_partkey").alias("target"))
    return E.bits_per_byte(losses, "nats", "n_bytes", "target")


@query(f"""WITH {_logits(2)}, y AS (SELECT vec_id, e[1] / list_sum(e) AS p FROM p), q AS (SELECT vec_id, exp(CAST(embedding[3] AS DOUBLE)) / (exp(CAST(embedding[3] AS DOUBLE)) + exp(CAST(embedding[4] AS DOUBLE))) AS q FROM embeddings)
 SELECT count(*) AS n, round(max(abs(p - q)), 6) AS max_delta, max(abs(p - q)) > 0.05 AS changed FROM y JOIN q USING (vec_id)""")
def probe_delta(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "embeddings").select(softmax(F.slice("embedding", 1, 2).cast("array<double>"))[0].alias("p"), softmax(F.slice("embedding", 3, 2).cast("array<double>"))[0].alias("q"))
    return both.agg(F.count("*").alias("n"), F.round(F.max(F.abs(F.col("p") - F.col("q"))), 6).alias("max_delta"), (F.max(F.abs(F.col("p") - F.col("q"))) > 0.05).alias("changed"))


@query("SELECT item_id, question || chr(10) || '- Yes=A' || chr(10) || '- No=B' || chr(10) || 'Answer:' AS prompt, CASE WHEN expected IN ('A', 'B', 'C', 'D') THEN translate(expected, 'ABCD', 'QXZJ') END AS letter FROM heldout")
def choice_prompt(spark: SparkSession, d: str) -> DataFrame:
    letter = F.when(F.col("expected").isin("A", "B", "C", "D"), F.translate("expected", "ABCD", "QXZJ"))
    return table(spark, d, "heldout").select("item_id", F.concat_ws("\n", "question", F.lit("- Yes=A"), F.lit("- No=B"), F.lit("Answer:")).alias("prompt"), letter.alias("letter")).where("prompt IS NOT NULL")


@query("SELECT coalesce(subset, 'unknown') AS part, count(*) AS n, count(expected) AS n_expected FROM heldout WHERE item_id LIKE 'race%' GROUP BY 1")
def race_subset_counts(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "heldout").where(F.col("item_id").startswith("race"))
    return items.groupBy(F.coalesce("subset", F.lit("unknown")).alias("part")).agg(F.count("*").alias("n"), F.count("expected").alias("n_expected"))


@query("SELECT train_id, round(-2 - (length(prompt_str) % 7) / 10.0, 6)::DOUBLE AS no_logprob, round(-3 - (length(prompt_str) % 7) / 10.0, 6)::DOUBLE AS yes_logprob FROM (SELECT DISTINCT train_id, prompt_str FROM train WHERE prompt_str IS NOT NULL)")
def score_stub(spark: SparkSession, d: str) -> DataFrame:
    prompts = table(spark, d, "train").where("prompt_str IS NOT NULL").select("train_id", "prompt_str").distinct().withColumn("options", F.array(F.lit("Yes"), F.lit("No")))
    scored = E.score_options(prompts, "train_id", "prompt_str", "options", E.stub_scorer)
    return scored.select("train_id", F.round(F.col("logprobs")[1], 6).alias("no_logprob"), F.round(F.col("logprobs")[0], 6).alias("yes_logprob"))
