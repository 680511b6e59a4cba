"""Near-duplicate records with small edits (problem 2): Order MinHash, banded alignment, exact share.

Every text of at least LEAST_WORDS words becomes ROUNDS * BINS keys. A round deals the occurrence-labelled k-mers of a
text into bins by hash; a key is made of the SAMPLED k-mers of least hash in a bin, taken in the order they have in the
text, so it survives edits elsewhere but not reordering inside. Texts that share a key, and whose 128-bit signatures of
all three-word sequences do not rule them out, are candidates. A banded alignment verifies them: the words it matches in
order bound the number of common three-word sequences from below, and where this bound reaches the similarity the pair is
settled. The others (moved parts, many edits) are settled by their exact share of common distinct sequences, so no pair
is lost or wrong for the band's sake.

Equal texts are one node throughout; they are told apart again only in the result. Keys that a bounded sample shows to be
common are dealt into blocks before the shuffle, and block against block is a cell of its own; no key is left out. Rows of a
cell lie together after one sort, and most cells have one row, so pairs are made from the sorted rows, not by a join.

Defined cases: null, empty and short texts pair with nothing; a record delivered again counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yearloom.operators.graph import connected_components
from yearloom.session import cut_lineage

LEAST_WORDS = 100
SIMILARITY = 0.5
SHINGLE = 3
#: Words of a k-mer, k-mers in a key, bins of a round, rounds.
KMER, SAMPLED, BINS, ROUNDS = 5, 2, 20, 2
#: Bits of the 128-bit signatures (last bits of 128 independent minima of the three-word sequences) that must agree before a pair
#: is a candidate. At similarity s a bit agrees with chance (1 + s) / 2: of pairs at SIMILARITY one in 200 has fewer, at 0.55 one
#: in 1600, at 0.6 one in 18,000.
AGREEING = 84
#: One text in SAMPLE tells which keys are common: those with a share of 1 / COMMON of the sampled keys, and at least LEAST of
#: them. There are at most COMMON such keys. It decides where pairs are compared, not which.
SAMPLE, COMMON, LEAST = 64, 20_000, 8
#: Rows of a common key that are compared in one go.
BLOCK = 1024
#: Pairs of rows whose signatures are compared in one go, but for the last row's.
PAIRS = 1_000_000
#: Numbers of 64 bits in which the texts of candidates are marked before their words are shuffled. Other texts may share a bit,
#: one in six with twelve million marked; so it decides what is moved, not what is compared.
MARKS = 1 << 20
#: Half the width of an alignment band.
BAND = 8
#: Characters of the texts that are verified together.
CHUNK = 2_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


#: A number for each byte that words are made of, the same for a capital and its small letter; 0 for all others.
_CODES = np.zeros(256, np.uint64)
_CODES[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = _mix(np.arange(1, 37, dtype=np.uint64) * _ODD)
_CODES[ord("A") : ord("Z") + 1] = _CODES[ord("a") : ord("z") + 1]
#: Bytes whose words are hashed in one go.
PIECE = 1_000_000


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2 ** 64, as many as were asked for yet."""

    def __init__(self, base: int) -> None:
        self.bases, self.known = (base, pow(base, -1, 1 << 64)), [np.ones(1, np.uint64)] * 2

    def first(self, n: int) -> list[np.ndarray]:
        if n > len(self.known[0]):
            self.known = [np.multiply.accumulate(np.append(np.uint64(1), np.full(2 * n, base, np.uint64))) for base in self.bases]
        return [x[:n] for x in self.known]


_powers = _Powers(int(_ODD))


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ([a-z0-9]+ of the lower-cased text) of all texts, one after another, and the number of words of each.

    The hash of a word is the sum of its bytes' numbers times powers by position, mixed; sums over words are differences of
    running sums, brought to the same powers by the inverse.
    """
    # Only outside ASCII can lower-casing do more than the table of codes.
    parts = [(t if t.isascii() else t.lower()).encode() for t in texts]
    raw = np.frombuffer(b" ".join(parts), np.uint8)
    edges = np.flatnonzero(np.diff(_CODES[raw] != 0, prepend=False, append=False))
    first, last = edges[::2], edges[1::2]
    words = np.empty(len(first), np.uint64)
    cuts = np.append(np.searchsorted(first, np.arange(0, len(raw), PIECE)), len(first))
    for i, j in zip(cuts[:-1], cuts[1:]):
        if i < j:
            start, piece = first[i], raw[first[i] : last[j - 1]]
            up, down = _powers.first(len(piece))
            sums = np.append(np.uint64(0), np.cumsum(_CODES[piece] * up))
            words[i:j] = _mix((sums[last[i:j] - start] - sums[first[i:j] - start]) * down[first[i:j] - start])
    ends = np.cumsum([len(p) + 1 for p in parts])
    return words, np.diff(np.searchsorted(first, ends), prepend=0)


def _grams(words: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word sequences inside each text, and the number of them in each."""
    gram = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for j in range(n):
        gram = _mix(gram * _ODD + words[j : j + len(gram)])
    counts = np.maximum(sizes - n + 1, 0)
    starts = np.cumsum(sizes) - sizes
    return gram[np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)], counts


def sketch(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of several texts at once (at most 65,536): the text's index and the key, one entry each, keys of a text side by side.

    words are the word hashes of all texts, one text after another, sizes their numbers.
    """
    kmer, counts = _grams(words, sizes, KMER)
    doc = np.repeat(np.arange(len(sizes)), counts)
    order = np.argsort((doc.astype(np.uint64) << np.uint64(48)) | (kmer >> np.uint64(16)))
    by_doc = kmer[order]
    same = np.zeros(len(order), bool)
    same[1:] = (by_doc[1:] == by_doc[:-1]) & (doc[order][1:] == doc[order][:-1])
    # Sorting leaves equal k-mers in any order; they are counted in that of the text.
    equal = same.copy()
    equal[:-1] |= same[1:]
    order[equal] = order[equal][np.lexsort((order[equal], np.cumsum(~same)[equal]))]
    index = np.arange(len(order), dtype=np.uint64)
    occurrence = np.empty(len(order), np.uint64)
    occurrence[order] = index - np.maximum.accumulate(np.where(same, np.uint64(0), index))
    labelled = kmer + occurrence * _ODD
    none, low = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0xFFFFFFFF)
    keys, full = np.empty((len(sizes) * BINS, ROUNDS), np.uint64), np.empty((len(sizes) * BINS, ROUNDS), bool)
    for r in range(ROUNDS):
        value = _mix(labelled ^ _mix(np.array([r + 1], np.uint64) * _ODD))
        group = doc * BINS + (value % np.uint64(BINS)).astype(np.int64)
        # The upper half of the value decides, then the place in the text, which the lower half holds.
        value = (value & ~low) | index
        chosen = np.empty((SAMPLED, len(full)), np.uint64)
        for j in range(SAMPLED):
            chosen[j] = none
            np.minimum.at(chosen[j], group, value)
            value[(chosen[j][chosen[j] != none] & low).astype(np.int64)] = none
        full[:, r] = (chosen != none).all(axis=0)
        places = np.sort(chosen[:, full[:, r]] & low, axis=0).astype(np.int64)
        key = np.full(places.shape[1], r + 1, np.uint64)
        for j in range(SAMPLED):
            key = _mix(key * _ODD + kmer[places[j]])
        keys[full[:, r], r] = _mix(key + np.flatnonzero(full[:, r]).astype(np.uint64) % np.uint64(BINS))
    # Keys of a text lie side by side, so its columns compress well on their way.
    return np.nonzero(full)[0] // BINS, keys[full].view(np.int64)


_SEEDS = [np.uint32(x >> np.uint64(32)) | np.uint32(1) for x in _mix(np.arange(1, 129, dtype=np.uint64) * _ODD)]


def signatures(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The last bits of 128 minima of the three-word sequences of each text, as two numbers; each text has three words or more."""
    gram, counts = _grams(words, sizes, SHINGLE)
    gram, starts = (_mix(gram) >> np.uint64(32)).astype(np.uint32), np.cumsum(counts) - counts
    least = np.empty((len(_SEEDS), len(sizes)), np.uint32)
    for k, seed in enumerate(_SEEDS):
        np.minimum.reduceat(gram * seed, starts, out=least[k])
    bits = (_mix(least.astype(np.uint64) * _ODD) & np.uint64(1)).astype(np.uint8)
    return np.packbits(np.ascontiguousarray(bits.T), axis=1).view(np.int64)


KEYED = "key long, fp long, sign long, more long"


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen = set()
    for batch in batches:
        # Texts of a piece in one go, so that it stays in the processor's cache; at most 2000.
        run = batch["text"].str.len().cumsum() // PIECE * len(batch) + np.arange(len(batch)) // 2000
        for _, part in batch.groupby(run.to_numpy(), sort=False):
            fps, texts = [], []
            for fp, text in zip(part["fp"], part["text"]):
                if fp not in seen:
                    # Remembered up to a bound; what is read twice falls together after the shuffle.
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(fp)
                    fps.append(fp)
                    texts.append(text)
            if texts:
                words, sizes = hashed_words(texts)
                long = sizes >= LEAST_WORDS
                if long.any():
                    words, sizes, own = words[np.repeat(long, sizes)], sizes[long], np.array(fps, np.int64)[long]
                    doc, key = sketch(words, sizes)
                    sign = signatures(words, sizes)
                    yield pd.DataFrame({"key": key, "fp": own[doc], "sign": sign[doc, 0], "more": sign[doc, 1]})


def fingerprinted(records: DataFrame, record_id: str, text: str) -> DataFrame:
    """id, fp, text; equal texts have equal fp. Texts too short for the least number of words go at once."""
    body = records.select(F.col(record_id).alias("id"), F.col(text).alias("text"))
    return body.where(F.col("id").isNotNull() & (F.length("text") >= 2 * LEAST_WORDS - 1)).withColumn("fp", F.xxhash64("text"))


def common_keys(texts: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Keys that many texts share, with the number of blocks to deal their rows into; at most COMMON rows."""
    some = texts.select("fp", "text").where(F.pmod("fp", F.lit(sample)) == 0).mapInPandas(_sketches, KEYED)
    counted = cut_lineage(some.groupBy("key").agg(F.count("*").alias("n")))
    least = max(LEAST, -(-(counted.agg(F.sum("n")).first()[0] or 0) // COMMON))
    return counted.where(F.col("n") >= least).select("key", F.ceil(F.col("n") * sample / BLOCK).cast("long").alias("blocks"))


def candidates(texts: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Distinct pairs (a, b), a < b, of fingerprints that share a key and have signatures close enough.

    All rows go through one shuffle. Rows of a common key are dealt into its blocks, and for each pair of blocks the two share a
    key of their own, so a row goes out once for each block.
    """
    common = F.broadcast(common_keys(texts, sample))
    keyed = texts.select("fp", "text").mapInPandas(_sketches, KEYED).join(common, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine, other = F.pmod(F.xxhash64("fp"), "blocks"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = keyed.withColumn("mine", mine).withColumn("other", other)
    cell = F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")))
    dealt = dealt.select(cell.alias("cell"), "fp", "sign", "more").repartition("cell").sortWithinPartitions("cell", "fp")
    return dealt.mapInArrow(_met, "a long, b long").repartition("a").distinct()


def _pairs(cell: np.ndarray, fp: np.ndarray, sign: np.ndarray, more: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of whole cells; rows are in the order of cell and fp."""
    new = np.append(True, (cell[1:] != cell[:-1]) | (fp[1:] != fp[:-1]))
    cell, fp, sign, more = (x[new] for x in (cell, fp, sign, more))
    # How many later rows of its cell each row meets.
    later = np.searchsorted(cell, cell, "right") - np.arange(len(cell)) - 1
    rows = np.flatnonzero(later)
    total = np.cumsum(later[rows])
    for part in np.split(rows, np.flatnonzero(np.diff(total // PAIRS)) + 1):
        one = np.repeat(part, later[part])
        two = np.arange(len(one)) - np.repeat(np.cumsum(later[part]) - later[part], later[part]) + one + 1
        apart = np.bitwise_count((sign[one] ^ sign[two]).view(np.uint64)) + np.bitwise_count((more[one] ^ more[two]).view(np.uint64))
        near = apart <= 128 - AGREEING
        yield pa.RecordBatch.from_arrays([pa.array(fp[one[near]]), pa.array(fp[two[near]])], ["a", "b"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b), a < b, with signatures close enough in each cell, of rows in the order of cell and fp; most cells have one row."""
    kept: list[list[np.ndarray]] = []
    for batch in batches:
        if batch.num_rows:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "fp", "sign", "more")]
            # The last cell may go on in the next batch.
            cell = columns[0]
            begun = np.searchsorted(cell, cell[-1])
            if begun or (kept and kept[-1][0][-1] != cell[-1]):
                yield from _pairs(*map(np.concatenate, zip(*kept, [c[:begun] for c in columns])))
                kept = []
            kept.append([c[begun:] for c in columns])
    if kept:
        yield from _pairs(*map(np.concatenate, zip(*kept)))


def banded(pairs: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Longest common subsequence of each pair of word numbers within BAND of its diagonal, all pairs step by step."""
    if not pairs:
        return np.zeros(0, int)
    width, longest = 2 * BAND + 1, max(len(a) for a, _, _ in pairs)
    left = np.full((len(pairs), longest), -1, np.int32)
    right = np.full((len(pairs), longest + width), -2, np.int32)
    for row, (a, b, diagonal) in enumerate(pairs):
        left[row, : len(a)] = a
        start = diagonal - BAND
        part = b[max(0, start) : start + longest + width]
        right[row, max(0, -start) : max(0, -start) + len(part)] = part[: max(0, longest + width - max(0, -start))]
    best = np.zeros((len(pairs), width + 1), np.int16 if longest < 32_000 else np.int32)
    for i in range(longest):
        step = np.maximum(best[:, 1:], best[:, :-1] + (right[:, i : i + width] == left[:, i : i + 1]))
        best[:, :-1] = np.maximum.accumulate(step, axis=1)
    return best[:, :-1].max(axis=1)


class _Read:
    """What verification needs of a text's words, made once for all its pairs: word numbers and distinct sequences of three."""

    def __init__(self, text: str, number: dict[str, int]) -> None:
        words = text.split()
        for word in set(words).difference(number):
            number[word] = len(number)
        self.words = np.array([*map(number.__getitem__, words)], np.int32)

    def index(self, base: int) -> None:
        """Word numbers lie below base, so the codes are exact as long as they fit."""
        w, n = self.words.astype(np.int64), len(self.words)
        codes = np.sort((w[: n - 2] * base + w[1 : n - 1]) * base + w[2:])
        self.sequences = codes[np.append(True, codes[1:] != codes[:-1])] if len(codes) else codes


def _common_at_least(one: _Read, two: _Read, matched: int) -> int:
    """Common distinct sequences that an alignment with so many matched words warrants.

    A word of the first text without a partner breaks at most three of its sequences, one of the second at most two.
    """
    return len(one.sequences) - 3 * (len(one.words) - matched) - 2 * (len(two.words) - matched)


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        size = (batch["text_a"].str.len() + batch["text_b"].str.len()).cumsum()
        for _, part in batch.groupby(size // CHUNK, sort=False):
            number: dict[str, int] = {}
            read = {t: _Read(t, number) for t in {*part["text_a"], *part["text_b"]}}
            for one in read.values():
                one.index(len(number) + 1)
            pairs = [(read[x], read[y]) for x, y in zip(part["text_a"], part["text_b"])]
            matched = banded([(one.words, two.words, 0) for one, two in pairs])
            for a, b, (one, two), m in zip(part["a"], part["b"], pairs, matched):
                both, total = _common_at_least(one, two, int(m)), len(one.sequences) + len(two.sequences)
                aligned = both >= SIMILARITY * (total - both)
                if not aligned and min(len(one.sequences), len(two.sequences)) >= SIMILARITY * max(len(one.sequences), len(two.sequences)):
                    merged = np.sort(np.concatenate([one.sequences, two.sequences]), kind="stable")
                    both = int((merged[1:] == merged[:-1]).sum())
                if aligned or both >= SIMILARITY * (total - both):
                    out.append((a, b, aligned))
        yield pd.DataFrame(out, columns=["a", "b", "aligned"])


def _bodies(texts: DataFrame, fps: DataFrame) -> DataFrame:
    """fp and the words of the text, a blank between them, of the wanted fingerprints, each once."""
    wanted = cut_lineage(fps.select("fp").distinct())
    word, bit = F.pmod(F.shiftright("fp", 6), F.lit(MARKS)), F.expr("shiftleft(1L, cast(fp & 63 AS int))")
    marks = wanted.groupBy(word.alias("mark")).agg(F.bit_or(bit).alias("bits"))
    marked = texts.select("fp", "text").join(F.broadcast(marks), word == F.col("mark")).where(F.col("bits").bitwiseAND(bit) != 0)
    words = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    # Not a semi-join, which would be moved below the marks.
    return marked.select("fp", words.alias("text")).join(wanted, "fp").dropDuplicates(["fp"])


def similar_texts(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Of candidate pairs of fingerprints (a < b), those whose texts are near-duplicates, and whether the alignment settled it."""
    one = bodies.select(F.col("fp").alias("a"), F.col("text").alias("text_a"))
    two = bodies.select(F.col("fp").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").mapInPandas(_verified, "a long, b long, aligned boolean")


def linked(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (fp, id), links between different texts (a, b, aligned), and fp of long texts that several records hold."""
    members = cut_lineage(texts.select("fp", "id").distinct())
    many = members.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    pairs = cut_lineage(candidates(texts))
    bodies = _bodies(texts, pairs.select(F.explode(F.array("a", "b")).alias("fp")).unionByName(many))
    length = F.size(F.split("text", " "))
    held = bodies.join(many, "fp", "left_semi").where(length >= LEAST_WORDS).select("fp")
    return members, similar_texts(pairs, bodies), held


def near_duplicate_pairs(records: DataFrame, record_id: str, text: str) -> DataFrame:
    """Every pair of records a < b that are near-duplicates or equal."""
    members, links, held = linked(fingerprinted(records, record_id, text))
    one, two = members.select(F.col("fp").alias("a"), F.col("id").alias("x")), members.select(F.col("fp").alias("b"), F.col("id").alias("y"))
    far = links.select("a", "b").join(one, "a").join(two, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    copies = members.join(held, "fp", "left_semi")
    near = copies.withColumnRenamed("id", "a").join(copies.withColumnRenamed("id", "b"), "fp").where("a < b").select("a", "b")
    return far.unionByName(near).where("a < b").distinct()


def near_duplicate_groups(records: DataFrame, record_id: str, text: str) -> DataFrame:
    """One row for each record that has a near-duplicate or a copy: id, group_id (the least fp), links between texts."""
    members, links, held = linked(fingerprinted(records, record_id, text))
    links = cut_lineage(links.select("a", "b"))
    parts = connected_components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    alone = held.select(F.col("fp").alias("node"), F.col("fp").alias("component")).join(parts, "node", "left_anti")
    nodes = parts.unionByName(alone).join(degree, "node", "left")
    return members.join(nodes, F.col("fp") == F.col("node")).select("id", F.col("component").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
