"""Sources mixed to target shares of the tokens, along a curriculum (problem 6).

Each source has a weight that moves linearly over training, from a start nearer to the corpus's own shares to an end
as far on the other side; its mean over training is the target share. The cumulative token demand of a source is the
integral of its weight. The documents of a source stand in hash order, repeated in whole passes up to the cap; the
tokens before a copy, put into the inverse of the demand, give the training time of that copy. A range sort by time
gives the positions.

The budget is the largest at which every source that has documents reaches its share within its cap on repeats.

Defined cases: documents without tokens and sources without a target are left out; a document delivered again counts
once, if with another text then with the shorter one; a target source without documents, with a null or negative share or no allowed use gets nothing, is reported
with an actual share of 0, and the shares of the others are scaled to sum to 1; a null max_repeats means 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yearloom.operators.ranking import cells_for, spread_rank
from yearloom.session import cut_lineage

#: How far the weights move: part of the greatest move at which none is negative.
MOVE = 0.5


def sized(documents: DataFrame, doc_id: str, source: str, size: Column) -> DataFrame:
    """doc_id, source, n_tokens of the documents that have tokens, each once."""
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source), F.lit("(none)")).alias("source"), size.cast("long").alias("n_tokens"))
    return rows.where("n_tokens > 0").groupBy("doc_id").agg(F.min(F.struct("n_tokens", "source")).alias("d")).select("doc_id", "d.source", "d.n_tokens")


def demands(sized: DataFrame, targets: DataFrame, budget: int | None = None, move: float = MOVE) -> DataFrame:
    """One row for each mix and source: supply, scaled share, start and end weight, budget and demand in tokens."""
    supply = sized.groupBy("source").agg(F.sum("n_tokens").alias("supply"))
    want = targets.groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    joined = want.join(supply, "source", "left").withColumn("supply", F.coalesce("supply", F.lit(0)))
    usable = (F.col("target_share") > 0) & (F.col("supply") > 0) & (F.col("max_repeats") > 0)
    mix = Window.partitionBy("mix_name")
    joined = joined.withColumn("share", F.when(usable, F.col("target_share")).otherwise(0.0))
    joined = joined.withColumn("share", F.expr("try_divide(share, sum(share) OVER (PARTITION BY mix_name))"))
    joined = joined.withColumn("own", F.when(usable, F.col("supply")).otherwise(0))
    joined = joined.withColumn("away", F.expr("try_divide(own, sum(own) OVER (PARTITION BY mix_name))") - F.col("share"))
    reach = F.min(F.when(F.abs("away") > 1e-12, F.col("share") / F.abs("away"))).over(mix)
    lean = F.col("away") * F.least(F.lit(1.0), F.coalesce(reach, F.lit(0.0))) * move
    most = F.min(F.when(usable, F.col("supply") * F.col("max_repeats") / F.col("share"))).over(mix)
    total = F.floor(most) if budget is None else F.least(F.lit(budget).cast("long"), F.floor(most))
    return joined.withColumn("budget", total).select(
        "mix_name", "source", "target_share", "max_repeats", "supply", "share", "budget",
        (F.col("share") + lean).alias("start_weight"), (F.col("share") - lean).alias("end_weight"),
        (F.col("budget") * F.col("share")).alias("demand"),
    )


def _time(tokens: Column) -> Column:
    """The training time, from 0 to 1, at which a source's demand has reached so many tokens."""
    first, slope, share = F.col("start_weight"), F.col("end_weight") - F.col("start_weight"), tokens / F.col("budget")
    bent = 2 * share / (first + F.sqrt(F.greatest(F.lit(0.0), first * first + 2 * slope * share)))
    return F.least(F.lit(1.0), bent)


def mixed(sized: DataFrame, targets: DataFrame, budget: int | None = None) -> DataFrame:
    """mix_name, doc_id, source, repeat_no, n_tokens, training_time, position of every chosen copy."""
    sized = cut_lineage(sized)
    want = demands(sized, targets, budget).where("demand > 0")
    before = spread_rank(sized, ["source"], F.col("doc_id"), weight=F.col("n_tokens"), cells=cells_for(sized))
    copies = before.join(want, "source")
    middle = F.col("rank_sum") + F.col("n_tokens") / 2
    last = F.floor((F.col("demand") - middle) / F.col("supply")).cast("int")
    copies = copies.withColumn("last", F.least(last, F.col("max_repeats") - 1)).where("last >= 0")
    copies = copies.withColumn("repeat_no", F.explode(F.sequence(F.lit(0), F.col("last"))))
    copies = copies.withColumn("training_time", _time(F.col("repeat_no") * F.col("supply") + middle))
    copies = copies.select("mix_name", "doc_id", "source", "repeat_no", "n_tokens", "training_time")
    # Range sort: equal ranges of time hold about equal tokens, whatever the source. A document is used a few times at most.
    ranges = cells_for(sized)
    ranged = copies.withColumn("_range", F.least(F.floor(F.col("training_time") * ranges), F.lit(ranges - 1)))
    earlier = Window.partitionBy("mix_name").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("mix_name", "_range").agg(F.count("*").alias("_n")).withColumn("_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    inside = Window.partitionBy("mix_name", "_range").orderBy("training_time", "source", "doc_id", "repeat_no")
    placed = ranged.withColumn("position", F.row_number().over(inside) - 1).join(offsets, ["mix_name", "_range"])
    return placed.withColumn("position", F.col("position") + F.col("_n")).drop("_range", "_n")


def uses(mixed: DataFrame) -> DataFrame:
    """The chosen documents with the number of their uses."""
    return mixed.groupBy("mix_name", "doc_id", "source").agg(F.count("*").alias("n_uses"), F.max("n_tokens").alias("n_tokens"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual share of every source of every mix, with documents, greatest use and tokens."""
    used = mixed.groupBy("mix_name", "source").agg(
        F.sum("n_tokens").alias("n_tokens"), F.count_distinct("doc_id").alias("n_docs"), (F.max("repeat_no") + 1).alias("most_uses")
    )
    want = targets.groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    joined = want.join(used, ["mix_name", "source"], "left").na.fill(0, ["n_tokens", "n_docs", "most_uses"])
    return joined.withColumn("actual_share", F.expr("round(coalesce(try_divide(n_tokens, sum(n_tokens) OVER (PARTITION BY mix_name)), 0.0), 6)"))
