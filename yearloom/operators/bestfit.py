"""Best-fit rows: each row begins with a document, takes the longest buffered one that fits, and crops to fill up."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fill_rows(lengths: list[int], seq_len: int, buffer: int) -> list[tuple[int, int, int, int]]:
    """(document, row, offset, tokens) of documents taken in order into rows of seq_len; what a crop cuts off is lost."""
    waiting: list[tuple[int, int]] = []
    taken, row, out = 0, 0, []
    while True:
        room = seq_len
        made: list[tuple[int, int, int, int]] = []
        while room > 0:
            while len(waiting) < buffer and taken < len(lengths):
                waiting.append((lengths[taken] + 1, taken))
                taken += 1
            if not waiting:
                return out
            fits = [w for w in waiting if w[0] <= room]
            pick = max(fits, key=lambda w: (w[0], -w[1])) if fits else min(waiting)
            waiting.remove(pick)
            n = min(pick[0], room)
            made.append((pick[1], row, seq_len - room, n))
            room -= n
        out += made
        row += 1


def best_fit_rows(documents: DataFrame, key: str, n_tokens: str, seq_len: int, buffer: int = 1000, group_rows: int = 20_000) -> DataFrame:
    """bucket, key, row, offset, n for documents dealt by hash into buckets of about group_rows, packed side by side.

    The number of buckets follows the number of rows, so no bucket outgrows a task; the last, unfilled row of each goes.
    """
    buckets = max(1, -(-documents.count() // group_rows))
    dealt = documents.select(key, F.col(n_tokens).cast("long").alias("_n")).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key).reset_index(drop=True)
        rows = fill_rows(group["_n"].tolist(), seq_len, buffer)
        out = pd.DataFrame(rows, columns=["_i", "row", "offset", "n"])
        return pd.DataFrame({"bucket": group["bucket"].iloc[0], key: group[key].to_numpy()[out["_i"].to_numpy(int)], "row": out["row"], "offset": out["offset"], "n": out["n"]})

    return dealt.groupBy("bucket").applyInPandas(pack, f"bucket long, {key} {dict(documents.dtypes)[key]}, row long, offset long, n long")
