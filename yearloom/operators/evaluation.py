"""Scoring: accuracies, distributions of options, bits per byte, pluggable scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yearloom.functions.statistics import dot, softmax

#: Weights of the five agreement options, strongest agreement first.
LIKERT_WEIGHTS = [1.0, 0.5, 0.0, -0.5, -1.0]
Scorer = Callable[[list[str], list[list[str]]], list[list[float]]]


def accuracy(scored: DataFrame, correct: Column, groups: list[str] | None = None) -> DataFrame:
    """n, correct and accuracy, 0.0 for no rows; by groups if given."""
    n, good = F.count("*"), F.count_if(correct)
    aggs = [n.alias("n"), good.alias("n_correct"), F.round(F.coalesce(F.try_divide(good, n), F.lit(0.0)), 6).alias("accuracy")]
    return scored.groupBy(*groups).agg(*aggs) if groups else scored.agg(*aggs)


def accuracy_rollup(scored: DataFrame, correct: Column, group: str) -> DataFrame:
    """Accuracy by group, null as 'unknown', and over all as 'overall', in one pass."""
    named = scored.select(F.coalesce(F.col(group).cast("string"), F.lit("unknown")).alias("part"), correct.cast("int").alias("ok"))
    rolled = named.rollup("part").agg(F.grouping("part").alias("_all"), F.count("*").alias("n"), F.round(F.avg("ok"), 6).alias("accuracy"))
    return rolled.select(F.when(F.col("_all") == 1, "overall").otherwise(F.col("part")).alias("part"), "n", "accuracy")


def running_accuracy(scored: DataFrame, order: str, groups: list[str], correct: Column) -> DataFrame:
    so_far = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return scored.withColumn("running_accuracy", F.round(F.avg(correct.cast("double")).over(so_far), 6))


def mean_distribution(scored: DataFrame, groups: list[str], probs: str) -> DataFrame:
    """Element-wise mean of option distributions, an ordered array for each group."""
    flat = scored.select(*groups, F.posexplode(probs).alias("option", "p")).groupBy(*groups, "option").agg(F.avg("p").alias("p"))
    return flat.groupBy(*groups).agg(F.transform(F.array_sort(F.collect_list(F.struct("option", F.round("p", 6).alias("p")))), lambda s: s["p"]).alias("mean_probs"))


def likert_score(logits: Column) -> Column:
    return dot(softmax(logits), LIKERT_WEIGHTS)


def bits_per_byte(losses: DataFrame, nats: str, n_bytes: str, target: str) -> DataFrame:
    """Sum of nats over ln 2 times the bytes; ignored targets are negative, special tokens have no bytes; infinite if there are none."""
    kept = losses.where(F.col(target) >= 0)
    total = F.sum(n_bytes)
    return kept.agg(F.when(total > 0, F.round(F.sum(F.when(F.col(n_bytes) > 0, F.col(nats)).otherwise(0.0)) / (F.log(F.lit(2.0)) * total), 6)).otherwise(F.lit(float("inf"))).alias("bits_per_byte"))


def score_options(prompts: DataFrame, key: str, prompt: str, options: str, scorer: Scorer) -> DataFrame:
    """Log-probabilities of each option from an injected scorer, a batch at a time; a failed batch gives nulls."""
    schema = f"{key} {dict(prompts.dtypes)[key]}, logprobs array<double>, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                scores, error = scorer(list(batch[prompt]), [list(o) for o in batch[options]]), None
            except Exception as problem:  # noqa: BLE001 - a scorer may fail in any way; the row keeps the reason
                scores, error = [None] * len(batch), str(problem)
            yield pd.DataFrame({key: batch[key], "logprobs": scores, "error": error})

    return prompts.select(key, prompt, options).mapInPandas(run, schema)


def stub_scorer(prompts: list[str], options: list[list[str]]) -> list[list[float]]:
    """A deterministic stand-in for a model: minus the length of an option, shifted by the prompt's length."""
    return [[-float(len(o)) - (len(p) % 7) / 10 for o in os] for p, os in zip(prompts, options)]
