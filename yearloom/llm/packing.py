"""Items of varying length into containers of fixed capacity (problem 5).

Lengths are counted in tokens; only the length histogram is optimised, so the size of the optimisation is bounded by
the capacity whatever the number of items. The configuration linear program (fewest containers whose contents cover the
histogram) is solved by multiplicative weights: each length has a weight, the knapsack recursion gives the mean contents
of all containers, each in proportion to the product of its weights, and a length that this mean covers beyond its need
loses weight while one that it leaves short gains. The containers are LP value * (1 + gap) in number, for the least stated
gap at which all lengths are covered. The solution is rounded by drawing whole containers from it (with a fixed seed) and
taking those that the need still holds; the program is solved again for what they leave, and the last few are filled first-fit
from the longest. Every item then finds its place by its rank inside its length.

Defined cases: null and empty texts have length 0 and go to container 0 at offset 0; a text longer than the capacity
fills containers of its own and its last piece is packed with the rest; equal lengths are ranked by a hash of the id;
an id that occurs twice with the same text is packed once; without items there are no containers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yearloom.operators.ranking import cells_for, spread_rank
from yearloom.session import cut_lineage

#: Gaps over the least number of containers (all tokens by the capacity) that are tried, and rounds of the weights for each.
GAPS, ROUNDS = tuple(0.001 * 2**k for k in range(12)), 60
#: Share of the need of every length that a solution covers, times that the program is solved, and containers drawn a length.
COVERED, PASSES, DRAWS = 0.99, 6, 2
#: Specs that are packed in one pass; more make more passes over the lengths.
SPECS_AT_ONCE = 100
SLOTS = "spec_name string, config long, copies long, base long, size long, per long, skip long, start long"


def _filled(sizes: np.ndarray, weight: np.ndarray, capacity: int) -> np.ndarray:
    """Total weight of all fillings of each room, by the knapsack recursion with a sum in the place of the maximum."""
    held = np.zeros(capacity + 1)
    held[0] = 1.0
    for room in range(int(sizes[0]), capacity + 1):
        fit = np.searchsorted(sizes, room, side="right")
        held[room] = weight[:fit] @ held[room - sizes[:fit]]
    return held


def _normal(sizes: np.ndarray, log_weight: np.ndarray) -> np.ndarray:
    """Weights times a power for each token so that they sum to 1; the fillings of a full container keep their proportions."""
    low, high = -np.max(log_weight / sizes) - 40.0, -np.max(log_weight / sizes)
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if np.exp(log_weight + middle * sizes).sum() < 1 else (low, middle)
    return np.exp(log_weight + low * sizes)


def _ends(held: np.ndarray, mean: float) -> np.ndarray:
    """Chances of the used room of a container, a power of the unused room, with the wanted mean if it can be had."""
    room = np.flatnonzero(held)
    low, high = -1.0, 50.0
    for _ in range(60):
        middle = (low + high) / 2
        log = np.log(held[room]) + middle * room
        chance = np.exp(log - log.max())
        low, high = (middle, high) if chance @ room < mean * chance.sum() else (low, middle)
    out = np.zeros(len(held))
    out[room] = chance / chance.sum()
    return out


def relaxed(sizes: np.ndarray, need: np.ndarray, capacity: int, gap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A solution of the linear program with (all tokens / capacity) * (1 + gap) containers.

    The share of each need that it covers, the weights, the weight of the fillings of each room, the chances of the used room.
    """
    containers = float(sizes @ need) / capacity * (1 + gap)
    log_weight, best = np.log(need / need.sum()), None
    for _ in range(ROUNDS):
        weight = _normal(sizes, log_weight)
        held = _filled(sizes, weight, capacity)
        end = _ends(held, capacity / (1 + gap))
        part = np.divide(end, held, out=np.zeros(capacity + 1), where=held > 0)
        # Weight of the containers with a given length in any place: what is before it, what is after it, what stays unused.
        both = np.convolve(held, held)[: capacity + 1]
        around = np.convolve(part[::-1], both)[: capacity + 1][::-1]
        covered = containers * weight * around[sizes] / need
        if best is None or covered.min() > best[0].min():
            best = covered, weight, held, end
        if covered.min() >= COVERED:
            break
        log_weight = log_weight - np.log(np.maximum(covered, 1e-9))
    return best


def _drawn(sizes: np.ndarray, weight: np.ndarray, held: np.ndarray, end: np.ndarray, n: int, chance: np.random.Generator) -> np.ndarray:
    """Counts of the lengths in n containers of a solution."""
    counts = np.zeros((n, len(sizes)), np.int16)
    room = np.searchsorted(np.cumsum(end)[:-1], chance.random(n), side="right")
    for r in range(len(held) - 1, 0, -1):
        at = np.flatnonzero(room == r)
        if len(at):
            fit = np.searchsorted(sizes, r, side="right")
            share = np.cumsum(weight[:fit] * held[r - sizes[:fit]])
            pick = np.searchsorted(share[:-1], chance.random(len(at)) * share[-1], side="right")
            counts[at, pick] += 1
            room[at] = r - sizes[pick]
    return counts


def configured(sizes: np.ndarray, wanted: np.ndarray, capacity: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """(copies, counts of each length) of the configurations taken from the linear program, and what they leave."""
    chance = np.random.default_rng(0)
    left, out, step = wanted.copy(), [], 0
    for _ in range(PASSES):
        on = np.flatnonzero(left)
        if not len(on):
            break
        own, need = sizes[on], left[on]
        while True:
            covered, weight, held, end = relaxed(own, need.astype(float), capacity, GAPS[step])
            if covered.min() >= COVERED or step == len(GAPS) - 1:
                break
            step += 1
        containers = int(np.ceil(own @ need / capacity * (1 + GAPS[step])))
        n = min(containers, DRAWS * len(own))
        for i, counts in enumerate(_drawn(own, weight, held, end, n, chance)):
            inside = counts > 0
            if inside.any():
                copies = int(min((i + 1) * containers // n - i * containers // n, (left[on[inside]] // counts[inside]).min()))
                if copies > 0:
                    whole = np.zeros(len(sizes), np.int16)
                    whole[on] = counts
                    out.append((copies, whole))
                    left[on] -= copies * counts.astype(np.int64)
    return out, left


def solve(sizes: np.ndarray, wanted: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(copies, counts of each length) of configurations that cover the histogram; sizes ascend, none above capacity."""
    out, left = configured(sizes, wanted, capacity) if len(sizes) else ([], wanted.copy())
    # What is left: containers filled from the longest length down, each as often as it can be repeated.
    while left.sum() > 0:
        counts, room = np.zeros(len(sizes), np.int64), capacity
        for i in range(len(sizes) - 1, -1, -1):
            if left[i] and sizes[i] <= room:
                counts[i] = min(left[i], room // sizes[i])
                room -= int(counts[i] * sizes[i])
        held = counts > 0
        copies = int((left[held] // counts[held]).min())
        out.append((copies, counts))
        left = left - copies * counts
    return out


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """Slots of all configurations of one spec, from its histogram."""
    pdf = pdf.sort_values("size")
    sizes, wanted, capacity = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), int(pdf["capacity"].iloc[0])
    rows, base, used = [], int(pdf["first"].iloc[0]), np.zeros(len(sizes), np.int64)
    for config, (copies, counts) in enumerate(solve(sizes, wanted, capacity)):
        start, skip = 0, 0
        counts = counts.astype(np.int64)
        for i in np.flatnonzero(counts)[::-1]:
            rows.append((pdf["spec_name"].iloc[0], config, copies, base, sizes[i], counts[i], skip, start, used[i]))
            start += int(sizes[i] * counts[i])
            skip += int(counts[i])
            used[i] += copies * counts[i]
        base += copies
    return pd.DataFrame(rows, columns=["spec_name", "config", "copies", "base", "size", "per", "skip", "start", "low"])


def packed(items: DataFrame, specs: DataFrame, item_id: str, size: Column) -> DataFrame:
    """spec_name, item_id, piece, container, position, start, n_tokens for every piece of every item.

    specs: spec_name, capacity_tokens. Containers are numbered from 1 within a spec.
    """
    lengths = cut_lineage(items.select(F.col(item_id).alias("item_id"), size.cast("long").alias("length")).distinct())
    stated = sorted(tuple(r) for r in specs.where("capacity_tokens > 0").select("spec_name", F.col("capacity_tokens").cast("long")).distinct().collect())
    parts = [_packed(lengths, stated[at : at + SPECS_AT_ONCE]) for at in range(0, max(1, len(stated)), SPECS_AT_ONCE)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _packed(lengths: DataFrame, stated: list[tuple[str, int]]) -> DataFrame:
    """The pieces of some specs, each as (spec_name, capacity)."""
    cells = cells_for(lengths)
    spec = F.array(*[F.struct(F.lit(n).alias("spec_name"), F.lit(c).alias("capacity")) for n, c in stated]).cast("array<struct<spec_name: string, capacity: bigint>>")
    each = lengths.withColumn("spec", F.explode(spec)).select("item_id", "length", "spec.*").withColumn("full", F.expr("CASE WHEN length > capacity THEN length DIV capacity ELSE 0 END"))
    each = each.withColumn("size", F.col("length") - F.col("full") * F.col("capacity"))
    nothing = each.where("length = 0").select("spec_name", "item_id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("container"), F.lit(0).cast("long").alias("position"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_tokens"))
    # Whole containers of texts above the capacity: numbered by running sums.
    over = spread_rank(each.where("full > 0").select("spec_name", "item_id", "capacity", "full"), ["spec_name"], F.col("item_id"), weight=F.col("full"), cells=cells)
    whole = over.withColumn("piece", F.explode(F.expr("sequence(0L, full - 1)")))
    whole = whole.select("spec_name", "item_id", "piece", (F.col("rank_sum") + F.col("piece") + 1).alias("container"), F.lit(0).cast("long").alias("position"), F.lit(0).cast("long").alias("start"), F.col("capacity").alias("n_tokens"))
    rest = each.where("size > 0")
    # The histogram has at most `capacity` rows for each spec.
    ahead = each.groupBy("spec_name").agg((F.sum("full") + 1).alias("first"))
    histogram = rest.groupBy("spec_name", "capacity", "size").agg(F.count("*").alias("n")).join(ahead, "spec_name")
    # A stated number of partitions is kept, so the specs are solved side by side.
    apart = histogram.repartition(max(1, 4 * len(stated)), "spec_name")
    plan = cut_lineage(apart.groupBy("spec_name").applyInPandas(_plan, SLOTS + ", low long"))
    slots = plan.groupBy("spec_name", "size").agg(F.sort_array(F.collect_list(F.struct("low", "copies", "base", "per", "skip", "start"))).alias("slots"))
    ranked = spread_rank(rest.select("spec_name", "item_id", "size", "full"), ["spec_name", "size"], F.col("item_id"), cells=cells)
    # The slots of a length, at most one for each configuration, ascend by `low`; the last that is not above the rank holds it.
    placed = ranked.join(slots, ["spec_name", "size"]).withColumn("s", F.expr("element_at(filter(slots, s -> s.low <= rank), -1)"))
    nth = F.expr("(rank - s.low) DIV s.per")
    inside = F.expr("(rank - s.low) % s.per")
    placed = placed.select(
        "spec_name", "item_id", F.col("full").alias("piece"), (F.col("s.base") + nth).alias("container"),
        (F.col("s.skip") + inside).alias("position"), (F.col("s.start") + inside * F.col("size")).alias("start"), F.col("size").alias("n_tokens"),
    )
    return placed.unionByName(whole).unionByName(nothing)


def fill_report(placed: DataFrame, specs: DataFrame) -> DataFrame:
    """Containers, pieces, tokens and the used share of each spec."""
    used = placed.where("n_tokens > 0").groupBy("spec_name").agg(
        F.max("container").alias("n_containers"), F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens")
    )
    sized = used.join(F.broadcast(specs.select("spec_name", "capacity_tokens").distinct()), "spec_name")
    fill = F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))
    least = F.ceil(F.col("n_tokens") / F.col("capacity_tokens"))
    return sized.select("spec_name", "n_containers", "n_pieces", "n_tokens", least.alias("least_containers"), F.round(fill, 6).alias("used_share"))
