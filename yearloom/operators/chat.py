"""Conversations: rendering, validation, masks, packing into fixed-length sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yearloom.session import cut_lineage


def messages(turns: DataFrame, record: str, turn: str, role: str, content: str) -> DataFrame:
    """One row for each record: its messages in turn order. A record is bounded by its conversation, not by the data."""
    item = F.struct(F.col(turn).alias("turn"), F.lower(F.trim(F.col(role))).alias("role"), F.coalesce(F.trim(F.col(content)), F.lit("")).alias("content"))
    return turns.where(F.col(record).isNotNull()).groupBy(record).agg(F.array_sort(F.collect_set(item)).alias("messages"))


def rendered(items: Column) -> Column:
    """Messages as 'Role: content', a blank line between them."""
    return F.array_join(F.transform(items, lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), m["content"])), "\n\n")


def split_prompt(text: Column) -> Column:
    """prompt and response, parted after the last assistant mark; without one everything is response."""
    mark = "\n\nAssistant:"
    behind = F.length(text) - F.length(F.substring_index(text, mark, -1))
    has = text.contains(mark)
    return F.struct(
        F.when(has, F.substring(text, F.lit(1), behind)).otherwise("").alias("prompt"),
        F.when(has, F.substring_index(text, mark, -1)).otherwise(text).alias("response"),
    )


def conversation_status(items: Column) -> Column:
    """ok, too_short or bad_roles: after an optional system turn, user and assistant take turns."""
    rest = F.when(items[0]["role"] == "system", F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))).otherwise(items)
    turns = F.forall(F.transform(rest, lambda m, i: m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda ok: ok)
    return F.when(F.size(rest) < 2, "too_short").when(~turns, "bad_roles").otherwise("ok")


def token_mask(items: Column) -> Column:
    """White-space tokens of all messages with their mask: 1 for what the assistant says, 0 for the rest."""
    parts = F.transform(items, lambda m: F.transform(F.filter(F.split(m["content"], r"\s+"), lambda t: t != ""), lambda t: F.struct(t.alias("token"), (m["role"] == "assistant").cast("int").alias("mask"))))
    return F.flatten(parts)


def merged_system(items: Column) -> Column:
    """Messages with the system turn put before the first user turn's content; without a user turn after it they stay."""
    both = F.concat(items[0]["content"], F.lit("\n\n"), F.try_element_at(items, F.lit(2))["content"])
    merged = F.concat(F.array(F.struct(F.try_element_at(items, F.lit(2))["turn"].alias("turn"), F.lit("user").alias("role"), both.alias("content"))), F.slice(items, F.lit(3), F.greatest(F.size(items) - 2, F.lit(0))))
    return F.when((items[0]["role"] == "system") & (F.try_element_at(items, F.lit(2))["role"] == "user"), merged).otherwise(items)


def completion_messages(items: Column) -> Column:
    """The messages before the last assistant message, to be completed; null if the last one is no assistant's."""
    last = F.try_element_at(items, F.lit(-1))
    return F.when(last["role"] == "assistant", F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0))))


def cropped_mask(tokens: Column, most: int = 2048) -> Column:
    """The first `most` tokens of a masked sequence, what a trainer of that length sees."""
    return F.slice(tokens, F.lit(1), F.lit(most))


def running_start(df: DataFrame, order: str, size: str, into: str = "start") -> DataFrame:
    """Sum of the sizes before each row in a global order of any type, in two levels: inside ranges of the order and over ranges.

    The ranges are those of a range partitioning, kept in a checkpoint as they come from a sample; they decide the balance
    of the tasks and not the result. The only single-task window runs over one row a range.
    """
    celled = cut_lineage(df.repartitionByRange(order).withColumn("_cell", F.spark_partition_id()))
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = celled.groupBy("_cell").agg(F.sum(size).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = F.coalesce(F.sum(size).over(Window.partitionBy("_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return celled.withColumn("_inside", inside).join(totals, "_cell").withColumn(into, (F.col("_before") + F.col("_inside")).cast("long")).drop("_cell", "_inside", "_before")


def packed_sequences(documents: DataFrame, order: str, n_tokens: str, seq_len: int, overlap: int = 0) -> DataFrame:
    """Pieces of documents in sequences of seq_len + overlap tokens that begin every seq_len tokens; the incomplete tail goes.

    One separator stands after each document. With an overlap of 1 a sequence ends with the first token of the next one,
    so inputs and targets are read from the same row. Columns: order, seq_id, first token of the piece in the document,
    offset in the sequence, tokens.
    """
    placed = running_start(documents.withColumn("_len", F.col(n_tokens) + 1), order, "_len")
    total = placed.agg(F.expr(f"greatest(0L, (coalesce(sum(_len), 0) - {overlap})) DIV {seq_len}").alias("_full"))
    first_seq = f"greatest(0L, start - {overlap}) DIV {seq_len}"
    spread = placed.withColumn("seq_id", F.explode(F.expr(f"sequence({first_seq}, (start + _len - 1) DIV {seq_len})")))
    lo, hi = F.greatest(F.col("start"), F.col("seq_id") * seq_len), F.least(F.col("start") + F.col("_len"), (F.col("seq_id") + 1) * seq_len + overlap)
    kept = spread.join(F.broadcast(total)).where((F.col("seq_id") < F.col("_full")) & (lo < hi))
    return kept.select(order, "seq_id", (lo - F.col("start")).alias("first"), (lo - F.col("seq_id") * seq_len).alias("offset"), (hi - lo).alias("n"))
