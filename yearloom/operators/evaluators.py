"""Evaluators by name: scored items in, measures out. Scores and replies are tables that a model's run has left, joined by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yearloom.functions.statistics import argmax, softmax
from yearloom.functions.text import first_marked_number, last_marked_number
from yearloom.operators.evaluation import accuracy, likert_score

Evaluator = Callable[..., DataFrame]
_EVALUATORS: dict[str, Evaluator] = {}


def evaluator(name: str) -> Callable[[Evaluator], Evaluator]:
    def register(run: Evaluator) -> Evaluator:
        _EVALUATORS[name] = run
        return run

    return register


def get(name: str) -> Evaluator:
    if name not in _EVALUATORS:
        raise KeyError(f"unknown evaluator {name!r}; known: {', '.join(sorted(_EVALUATORS))}")
    return _EVALUATORS[name]


def names() -> list[str]:
    return sorted(_EVALUATORS)


def mean_logprob(logprobs: Column, start: Column, stop: Column) -> Column:
    """Mean log-probability of the tokens from start to before stop; null if there are none."""
    part = F.slice(logprobs, start + 1, F.greatest(stop - start, F.lit(0)))
    return F.try_divide(F.aggregate(part, F.lit(0.0), lambda s, v: s + v), F.size(part))


def argmin(values: Column) -> Column:
    """0-based index of the least value; the lowest index wins a tie."""
    return (F.array_position(values, F.array_min(values)) - 1).cast("int")


@evaluator("policy_battery")
def policy_battery(items: DataFrame, scores: DataFrame, keys: list[str], only: list[str] | None = None) -> DataFrame:
    """p_yes and the agreement score of each policy and model.

    items: event_id; scores: the keys, event_id, yes_no (two logits) and scale (five logits). only keeps stated policies. A policy
    without scores has no row, a null logit array gives null measures.
    """
    asked = items if only is None else items.where(F.col("event_id").isin(only))
    joined = scores.join(asked.select("event_id").distinct(), "event_id", "left_semi")
    return joined.select(*keys, "event_id", F.round(softmax(F.col("yes_no"))[0], 6).alias("p_yes"), F.round(likert_score(F.col("scale")), 6).alias("score"))


@evaluator("policy_battery_variants")
def policy_battery_variants(items: DataFrame, scores: DataFrame, keys: list[str], only: list[str] | None = None) -> DataFrame:
    """Mean and spread over the wordings of each policy; scores has one row for each wording."""
    asked = items if only is None else items.where(F.col("event_id").isin(only))
    joined = scores.join(asked.select("event_id").distinct(), "event_id", "left_semi")
    each = joined.select(*keys, "event_id", softmax(F.col("yes_no"))[0].alias("p"), likert_score(F.col("scale")).alias("s"))
    spread = F.when(F.count("p") > 1, F.stddev_samp("p")).otherwise(0.0)
    return each.groupBy(*keys, "event_id").agg(
        F.round(F.avg("p"), 6).alias("mean_p_yes"), F.round(spread, 6).alias("std_p_yes"), F.count("p").alias("n_variants"), F.round(F.avg("s"), 6).alias("mean_score")
    )


@evaluator("gsm8k")
def gsm8k(items: DataFrame, replies: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Accuracy of the last marked number of a reply against the answer's first; an item without a reply is wrong."""
    gold = items.select("item_id", *(groups or []), first_marked_number(F.col("expected")).try_cast("double").alias("gold")).where("gold IS NOT NULL")
    given = gold.join(replies.select("item_id", last_marked_number(F.col("reply")).try_cast("double").alias("given")), "item_id", "left")
    return accuracy(given, F.coalesce(F.col("given") == F.col("gold"), F.lit(False)), groups)


@evaluator("policy_probe")
def policy_probe(items: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Share of True between the log-probabilities of True and False; one half where both are missing."""
    joined = scores.join(items.select("event_id").distinct(), "event_id", "left_semi")
    return joined.select(*keys, "event_id", F.round(F.coalesce(softmax(F.array("log_true", "log_false"))[0], F.lit(0.5)), 6).alias("p_true"))


@evaluator("choice")
def choice(items: DataFrame, scores: DataFrame, groups: list[str] | None = None, letters: str = "ABCD") -> DataFrame:
    """Accuracy of the option of greatest log-probability; items whose expected letter is no option do not count."""
    asked = items.where(F.col("expected").isin(list(letters))).join(scores.select("item_id", "logprobs"), "item_id")
    return accuracy(asked, argmax(F.col("logprobs")) == F.instr(F.lit(letters), F.col("expected")) - 1, groups)


@evaluator("core_task")
def core_task(items: DataFrame, scores: DataFrame, groups: list[str] | None = None, letters: str = "ABCD") -> DataFrame:
    """Accuracy of the option of least mean loss over its own tokens.

    scores: item_id, losses (token losses of each option) and start (first token that the options do not share).
    """
    mean = F.transform("losses", lambda o: mean_logprob(o, F.col("start"), F.size(o)))
    asked = items.where(F.col("expected").isin(list(letters))).join(scores.select("item_id", mean.alias("mean")), "item_id")
    return accuracy(asked, argmin(F.col("mean")) == F.instr(F.lit(letters), F.col("expected")) - 1, groups)


def rendered_template(template: str, **slots: Column) -> Column:
    """A template with {name} slots filled; slots that are not given stay."""
    out = F.lit(template)
    for name, value in slots.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def few_shot_prompts(items: DataFrame, shots: DataFrame, question: str = "question", answer: str = "expected") -> DataFrame:
    """item_id and prompt: the shots in their order with answers, then the item without. shots: item_id, shot, place."""
    told = shots.join(items.select(F.col("item_id").alias("shot"), F.concat_ws("\nAnswer: ", question, answer).alias("told")), "shot")
    before = told.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "told"))), lambda s: s["told"]), "\n\n").alias("before"))
    own = F.concat(F.col(question), F.lit("\nAnswer:"))
    return items.join(before, "item_id", "left").select("item_id", F.when(F.col("before").isNull(), own).otherwise(F.concat("before", F.lit("\n\n"), own)).alias("prompt"))
