"""Joins the built-in ones do not name: ranges, phrases, positions, chains of years."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Phrases of one automaton; more make more automata.
PHRASES = 50_000


def year_window(models: DataFrame, policies: DataFrame, before: int, after: int) -> DataFrame:
    """Models with the policies enacted from model_year - before to model_year + after.

    The offsets are exploded on the model side and the join is an equi-join on the year, which stays partitioned where
    a condition on a range would become a nested loop.
    """
    years = models.withColumn("enactment_year", F.explode(F.sequence(F.col("model_year") - before, F.col("model_year") + after)))
    return years.join(policies, "enactment_year").withColumn("rel_year", F.col("model_year") - F.col("enactment_year"))


def window_bounds(rel_min: int | None = None, rel_max: int | None = None, window_years: int | None = None, lookback_years: int | None = None) -> tuple[int, int]:
    """Years before and after a model year; relative bounds win over a symmetric window, that over a lookback.

    rel = model year less enactment year, so rel_max years before and -rel_min after; one bound alone gets -10 or +10.
    """
    if rel_min is not None or rel_max is not None:
        lo, hi = -10 if rel_min is None else rel_min, 10 if rel_max is None else rel_max
        return hi, -lo
    if window_years is not None:
        return window_years, window_years
    if lookback_years is not None:
        return 0, lookback_years
    raise ValueError("no bounds given")


def as_of(left: DataFrame, right: DataFrame, on: list[str], left_at: str, right_at: str, value: str) -> DataFrame:
    """The latest right row at or before each left row, by one sorted pass over the union; no pair is made."""
    a = left.withColumns({"_side": F.lit(1), "_at": F.col(left_at), "_v": F.lit(None)})
    b = right.select(*on, F.lit(0).alias("_side"), F.col(right_at).alias("_at"), F.struct(F.col(right_at).alias("at"), F.col(value).alias("value")).alias("_v"))
    w = Window.partitionBy(*on).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.drop("_v").unionByName(b, allowMissingColumns=True).withColumn("_last", F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 1").select(*left.columns, F.col("_last.at").alias(right_at), F.col("_last.value").alias(value))


def matched_topics(text: Column, topics: dict[str, list[str]]) -> Column:
    """Topics any of whose keywords a text holds, without regard to case; an array in the order given."""

    def hits(low: Column) -> Column:
        found = []
        for topic, words in topics.items():
            any_word = F.lit(False)
            for word in words:
                any_word = any_word | low.contains(word.lower())
            found.append(F.when(any_word, F.lit(topic)))
        return F.array_compact(F.array(*found))

    # The text is lowered once, whatever the number of keywords.
    return F.transform(F.array(F.lower(text)), hits)[0]


def first_phrase(text: Column, phrases: list[str], block: int = PHRASES) -> Column:
    """The first of any number of phrases, in their order, that a text holds without regard to case; null if none.

    A text is read once for each block of phrases, by one automaton, so the work does not grow with the phrases of a block.
    """
    parts = [_first_of(phrases[at : at + block])(text) for at in range(0, len(phrases), block)]
    return F.coalesce(*parts) if parts else F.lit(None).cast("string")


def _first_of(phrases: list[str]):
    lowered = [p.lower() for p in phrases]

    @F.pandas_udf("string")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i in range(len(lowered) - 1, -1, -1):
            if lowered[i]:
                found.add_word(lowered[i], i)
        if len(found):
            found.make_automaton()
        empty = min((i for i, p in enumerate(lowered) if not p), default=None)

        def first(text: str | None) -> str | None:
            if text is None:
                return None
            least = min((i for _, i in found.iter(text.lower())), default=None) if len(found) else None
            least = empty if least is None else least if empty is None else min(least, empty)
            return None if least is None else phrases[least]

        for batch in batches:
            yield batch.map(first, na_action=None)

    return find


def zipped(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """The i-th row of one small table with the i-th of another, each in its own order."""
    a = left.withColumn("_i", F.row_number().over(Window.orderBy(left_order)))
    b = right.withColumn("_i", F.row_number().over(Window.orderBy(right_order)))
    return a.join(b, "_i").drop("_i")


def unbroken_chain(years: DataFrame, groups: list[str], year: str, done: Column) -> DataFrame:
    """Years of each group up to the first that is not done."""
    so_far = F.min(done.cast("int")).over(Window.partitionBy(*groups).orderBy(year).rowsBetween(Window.unboundedPreceding, 0))
    return years.withColumn("_ok", so_far).where("_ok = 1").drop("_ok")
