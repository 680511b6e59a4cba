"""Test passages inside a training corpus (problem 4).

All windows of n words of the test items go into one Aho-Corasick automaton over word numbers; every text is read once
and each hit is mapped back to character offsets of the original text. The items are a stated, bounded side: their
words are counted first, and past MAX_WORDS the items are dealt into blocks, each with an automaton of its own.

Defined cases: null, empty and short texts give no rows; a row id delivered again counts once; an item id that occurs
on several rows counts with each of its texts; items of fewer than n words cannot leak; null ids are kept as such.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yearloom.session import cut_lineage

#: A word is a maximal run of a-z and digits in the lower-cased text.
WORD = re.compile(r"[a-z0-9]+")
N_WORDS = 12
#: Words of test items in one automaton (about 100 MB in a worker); more items make more blocks.
MAX_WORDS = 400_000
HITS = "tab string, row_id long, item_id string, start int, end int, n_words int"

_built: dict[int, tuple] = {}


def _automaton(key: int, items: list[tuple[str, str]], n: int) -> tuple:
    """Word numbers and the automaton over the windows of all items, built once in a worker."""
    if key not in _built:
        import ahocorasick

        words: dict[str, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [words.setdefault(w, len(words) + 1) for w in WORD.findall(text.lower())]
            for at in range(len(ids) - n + 1):
                windows.setdefault(tuple(ids[at : at + n]), set()).add(item)
        found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, owners in windows.items():
            found.add_word(window, tuple(owners))
        if windows:
            found.make_automaton()
        _built.clear()
        _built[key] = (words, found if windows else None)
    return _built[key]


def _runs(ends: list[int], n: int) -> list[tuple[int, int]]:
    """First and last word of each unbroken run of windows that end at the given words."""
    runs: list[list[int]] = []
    for end in sorted(set(ends)):
        if runs and end == runs[-1][1] + 1:
            runs[-1][1] = end
        else:
            runs.append([end - n + 1, end])
    return [(a, b) for a, b in runs]


def corpus(tab: str, df: DataFrame, row_id: str, text: str) -> DataFrame:
    """The three columns that the scan reads: tab, row_id and body."""
    return df.select(F.lit(tab).alias("tab"), F.col(row_id).cast("long").alias("row_id"), F.col(text).cast("string").alias("body"))


def leaked_passages(corpus: DataFrame, items: DataFrame, n_words: int = N_WORDS, max_words: int = MAX_WORDS) -> DataFrame:
    """One row for each passage of at least n_words words of an item: row, item, offsets in the original text.

    corpus has the columns tab, row_id and body, items item_id and item_text; others are ignored.
    """
    spark = corpus.sparkSession
    items = items.where(F.col("item_text").isNotNull()).select(F.col("item_id").cast("string"), "item_text")
    size = F.size(F.split(F.lower("item_text"), "[^a-z0-9]+"))
    total = items.agg(F.sum(size.cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // max_words))
    source = corpus.select("tab", "row_id", "body").where(F.length("body") >= 2 * n_words - 1)
    parts = []
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast([tuple(r) for r in own.collect()])

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            words, found = _automaton(hash(tuple(shared.value)), shared.value, n_words)
            number = words.get
            for batch in batches if found is not None else ():
                out = []
                for tab, row, body in zip(batch["tab"], batch["row_id"], batch["body"]):
                    lowered = body.lower()
                    hits: dict[str, list[int]] = {}
                    for end, owners in found.iter(tuple([number(w, 0) for w in WORD.findall(lowered)])):
                        for owner in owners:
                            hits.setdefault(owner, []).append(end)
                    if hits:
                        spans = [m.span() for m in WORD.finditer(lowered)]
                        if len(lowered) != len(body):
                            # A few letters become two when lower-cased; each of them leads back to its letter.
                            back = [i for i, letter in enumerate(body) for _ in letter.lower()]
                            spans = [(back[a], back[b - 1] + 1) for a, b in spans]
                        for owner, ends in hits.items():
                            out += [(tab, row, owner, spans[a][0], spans[b][1], b - a + 1) for a, b in _runs(ends, n_words)]
                yield pd.DataFrame(out, columns=["tab", "row_id", "item_id", "start", "end", "n_words"])

        hits = source.mapInPandas(scan, HITS)
        if blocks > 1:
            # One block at a time: its hits are written before the next block's items are read.
            hits = cut_lineage(hits)
            shared.destroy()
        parts.append(hits)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def leaked_rows(passages: DataFrame) -> DataFrame:
    """One row for each record and item; redeliveries fall together here."""
    return passages.select("tab", "row_id", "item_id").distinct()
