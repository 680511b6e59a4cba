"""Queries of the numbered problems and, where SQL can say them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yearloom.llm import leakage, mixing, neardup, packing, pairs, residue, tokens, truncation
from yearloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _items(spark: SparkSession, d: str) -> DataFrame:
    battery = table(spark, d, "battery").select(F.col("event_id").alias("item_id"), F.col("benchmark_question").alias("item_text"))
    return battery.unionByName(table(spark, d, "heldout").select("item_id", F.col("question").alias("item_text")))


def _p4_corpus(spark: SparkSession, d: str) -> DataFrame:
    synth = leakage.corpus("synth", table(spark, d, "synth"), "synth_id", "text")
    return synth.unionByName(leakage.corpus("run", table(spark, d, "run"), "msg_id", "content"))


def p4_passages(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(_p4_corpus(spark, d), _items(spark, d)).distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_rows(leakage.leaked_passages(_p4_corpus(spark, d), _items(spark, d)))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "synth"), "synth_id", "text").select(F.col("id").alias("synth_id")).distinct()


def p1_residue(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "synth"), "synth_id", "text").withColumnRenamed("id", "synth_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neardup.near_duplicate_pairs(table(spark, d, "synth"), "synth_id", "text")
    return pairs.select(F.col("a").alias("synth_id_a"), F.col("b").alias("synth_id_b"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    groups = neardup.near_duplicate_groups(table(spark, d, "synth"), "synth_id", "text")
    return groups.select(F.col("id").alias("synth_id"), "group_id", "n_links")


def _p3_broken(spark: SparkSession, d: str) -> DataFrame:
    both = pairs.rendered_pairs(table(spark, d, "train")).unionByName(pairs.message_pairs(table(spark, d, "run")))
    return pairs.broken_pairs(both)


def p3_all_defects(spark: SparkSession, d: str) -> DataFrame:
    return _p3_broken(spark, d).select("tab", "pair_id", F.explode("defects").alias("defect")).distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.named_defect(_p3_broken(spark, d))


def _p5_placed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"), table(spark, d, "pack_spec"), "doc_id", tokens.n_tokens(F.col("text")))


def p5_packing(spark: SparkSession, d: str) -> DataFrame:
    return _p5_placed(spark, d).withColumnRenamed("item_id", "doc_id")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_p5_placed(spark, d), table(spark, d, "pack_spec"))


def _p6_mixed(spark: SparkSession, d: str) -> DataFrame:
    sized = mixing.sized(table(spark, d, "documents"), "doc_id", "source", tokens.n_tokens(F.col("text")))
    return mixing.mixed(sized, table(spark, d, "mix_target"))


def p6_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _p6_mixed(spark, d)


def p6_uses(spark: SparkSession, d: str) -> DataFrame:
    return mixing.uses(_p6_mixed(spark, d))


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(_p6_mixed(spark, d), table(spark, d, "mix_target"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_texts(table(spark, d, "documents")).where("is_cut").select("doc_id").distinct()


def p7_limits(spark: SparkSession, d: str) -> DataFrame:
    return truncation.limits(truncation.measured(table(spark, d, "documents"), "doc_id", "text", "source"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_shares(truncation.cut_texts(table(spark, d, "documents")))


def queries() -> dict[str, Query]:
    named = [p1_found, p1_residue, p2_found, p2_groups, p3_found, p3_all_defects, p4_found, p4_passages, p5_packing, p5_report, p6_mixture, p6_uses, p6_shares, p7_found, p7_limits, p7_shares]
    return {f.__name__: f for f in named}


_WORDS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_P4_FOUND = f"""
WITH item AS (
  SELECT event_id AS item_id, {_WORDS.format('benchmark_question')} AS w FROM battery WHERE benchmark_question IS NOT NULL
  UNION ALL SELECT item_id, {_WORDS.format('question')} FROM heldout WHERE question IS NOT NULL),
item_window AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM item WHERE len(w) >= 12)),
body AS (
  SELECT 'synth' AS tab, synth_id AS row_id, {_WORDS.format('text')} AS w FROM synth WHERE text IS NOT NULL
  UNION ALL SELECT 'run', msg_id, {_WORDS.format('content')} FROM run WHERE content IS NOT NULL),
body_window AS (
  SELECT tab, row_id, array_to_string(w[i:i + 11], ' ') AS g
  FROM (SELECT tab, row_id, w, unnest(range(1, len(w) - 10)) AS i FROM body WHERE len(w) >= 12))
SELECT DISTINCT tab, row_id, item_id FROM body_window JOIN item_window USING (g)
"""


_P2_FOUND = f"""
WITH body AS (
  SELECT synth_id, any_value({_WORDS.format('text')}) AS w FROM synth WHERE text IS NOT NULL GROUP BY synth_id, text),
gram AS (
  SELECT DISTINCT synth_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT synth_id, w, unnest(range(1, len(w) - 1)) AS i FROM body WHERE len(w) >= 100)),
size AS (SELECT synth_id, count(*) AS n FROM gram GROUP BY synth_id),
common AS (
  SELECT a.synth_id AS x, b.synth_id AS y, count(*) AS c FROM gram a JOIN gram b ON a.g = b.g AND a.synth_id < b.synth_id GROUP BY 1, 2)
SELECT x AS synth_id_a, y AS synth_id_b FROM common JOIN size s ON s.synth_id = x JOIN size t ON t.synth_id = y
WHERE c >= 0.5 * (s.n + t.n - c)
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": _P2_FOUND, "p4_found": _P4_FOUND}
