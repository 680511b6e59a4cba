"""Template residue, filler and error-page text (problem 1): SimHash tables and labels spread through components.

Trusted labels are few: one wording of each message (MESSAGES), running Latin filler, and the slots of common template
languages (TRUSTED). Everything else is found by likeness to what is labelled.

Messages. A text is cut into sentences, and a sentence at its breaks (marks, figures, capitals), so that a message stands
free of what a page puts around it. Every run of pieces that could reach the stated similarity to a labelled wording is a
vertex: of the 4-grams of a wording, any (1 - SIMILARITY) part and one more must hold one of the run's, so that part,
the rarest ones, is looked up first, and no likeness is lost. What is newly labelled is looked up in turn, until nothing new is.

Slots. Any span in brackets or between signs may be a slot. The words before it and the words after it are vertices; a slot
of a trusted form labels its surroundings, and a span of an unknown form in such surroundings is a slot. A form that
is a slot in most of its places is one in all, and one that hardly ever is (an editor's mark) is none anywhere; a syntax whose forms
are nearly all slots makes slots of the others.

Vertices are distinct normal forms (lower case, figures masked, marks off) with a 64-bit SimHash of their 4-grams. A table
for each two of its parts finds hashes that differ in few bits; then the Hamming distance and the similarity of the
4-grams decide, and a label runs along such links until its connected component has it.

Defined cases: null and blank texts are no cases; a record delivered again counts once; very long texts are read whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yearloom.session import cut_lineage

#: Most bits two SimHash values may differ in, and the least similarity of the texts. Texts of similarity 0.8 to 0.85 differ in
#: 9 bits on average and 97 of 100 in at most 14. Of twelve parts of five bits two are equal if at most ten bits differ,
#: so one table for each two parts (66 in all) misses no such pair; at 14 bits it finds nine in ten.
HAMMING, SIMILARITY, PARTS = 14, 0.8, 12
#: Labelled vertices that are sent to every task at once; more are joined by shuffle.
SENT = 20_000
#: A form is a slot in all its places if it is one in this share of them, and in none if in no more than the other share;
#: a syntax (a form with its words masked) is one for the forms in it from the third share on.
MOSTLY, HARDLY, NEARLY_ALL = 0.5, 0.1, 0.7
#: Words of the surroundings of a slot on each side.
AROUND = 3

# One wording of each message. Figures are masked, so any number stands for all.
MESSAGES = {
    "error": [
        "500 Internal Server Error.", "The server met an unexpected condition.", "404 Not Found.", "The requested URL /doc/1 was not found on this server.", "The requested URL /doc/1/2 was not found on this server.",
        "503 Service Unavailable: the service is temporarily unable to handle your request.", "Gateway time-out.", "The web server reported a gateway time-out error.", "502 Bad Gateway proxy/1",
        "403 Forbidden You don't have permission to access /archive/1 on this server.", "Access denied.", "Error establishing a database connection (node 1).", "An error occurred while processing your request.", "Request ID: 1-2-3",
        "Erreur 404 : la page demandée est introuvable.", "Fehler 503: Dienst nicht verfügbar.", "Página no encontrada.", "HTTP error 402: resource unavailable, rate limit exceeded", "Try again in 5 seconds.",
        '{"error": {"code": 429, "message": "Too many requests", "request": "r-1"}}', "Upstream connect error or disconnect before headers.", "reset reason: connection timeout 1", 'Traceback (most recent call last): File "render.py", line 1 KeyError: \'body\'',
        "<html><head><title>Page not found</title></head><body><h1>Not Found</h1><p>id 1</p></body></html>", "Your session has expired.", "Please log in again to continue.", "The document could not be loaded.", "Please refresh the browser and retry (E1).", "Sorry, this content isn't available right now.",
        "We can't find the page you are looking for.", "Oops!",
    ],
    "notice": [
        "Please enable JavaScript to view this page.", "JavaScript is disabled in your browser.", "Enable JS and disable any ad blocker, then try again.", "Your browser does not support scripts, or they are turned off.", "Your browser blocked them (1).",
        "Scripts required.", "This site needs scripts to run.", "Scripts and cookies must be allowed.", "(scripting must be on)", "Turn it on and reload to continue reading.", "To use the archive viewer, activate Javascript.", "The reader for volume 1 cannot start.",
        "Bitte aktivieren Sie JavaScript, um diese Seite zu sehen.", "Veuillez activer JavaScript pour lire cette page (1).", "Active JavaScript para ver esta página.", "Checking your browser before you proceed.", "One more step: complete the check to prove you are human.",
        "Some features of page 1 are unavailable because active scripting is switched off in your settings.", "We're sorry but this app doesn't work properly without JavaScript enabled.", "You need to allow scripts to read article 1.", "Please turn on JS.",
    ],
    "filler": [
        "Lorem ipsum.", "Body copy to come.", "Type or paste your content.", "Text text text text.", "Your document starts here.", "You can add your own words here.", "Click to edit this paragraph.", "Replace this text before publishing.",
        "Blah blah blah, blah blah 1 blah blah.", "Blah blah.", "Here is some dummy content so that the layout can be checked, block 1.", "Sample paragraph 1.", "This is placeholder text for item 1; the final copy follows later.",
        "Insert generated article about the chosen subject at this spot (1 words).", "Asdf jkl; asdf qwer zxcv 1 asdf jkl;", "Title: Date: Speaker: Body: (to be written, slot 1)", "Test test 123 test 1 test", "Test, test, test", "xxxx xxxxx xx xxxxxxx xxx xxxx 1 xxxx xx.",
    ],
}
# The words of Latin filler; four in a row are no accident.
_LATIN = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur"
LATIN = rf"(?i:(?:^|[^\pL])(?:(?:{'|'.join(_LATIN.split())})[^\pL]+){{3}}(?:{'|'.join(_LATIN.split())})(?:[^\pL]|$))"

#: Spans that may be slots: anything in brackets or between signs, runs of underscores, capitals after a marker.
_SLOT = re.compile(
    r"\{\{[^{}\n]{0,80}\}\}|[$#]?\{[^{}\n]{1,80}\}|<%[^%\n]{1,80}%>|<<[^<>\n]{1,80}>>|\[\[[^\[\]\n]{1,80}\]\]|<[^<>\n]{1,80}>|\[[^\[\]\n]{1,80}\]|«[^«»\n]{1,80}»"
    r"|%\(\w+\)[a-z]|%[sd]\b|@@\w+@@|\$\w+\$|__\w+?__|_{4,}|\bTK [A-Z]{3,}(?: [A-Z]{2,})*|\bTODO: ?\w+ [a-z]+|\bFIXME\b"
)
#: What any such span holds, in RE2.
_SIGNS = r"[{\[<«]|@@|%s|%d|%\(|__|TK |TODO|FIXME|\$\w+\$"
# Slots of common template languages, blank forms and the parts of a letter.
TRUSTED = re.compile(r"\{\{.*\}\}|\$\{.*\}|%\(\w+\)s|<<.*>>|@@\w+@@|__\w+__|TODO.*|FIXME|TK [A-Z]{3,}.*|_{6,}|\[INSERT .*\]|\[(?i:recipient|sender|matter|opening paragraph|text|title|body)\]")
_TAG = re.compile(r"</?(?:p|br|hr|b|i|u|em|a|ul|ol|li|h\d|html|head|body|title|noscript|script|style|div|span|td|tr|th|table|pre|code|sup|sub|strong|small|meta|link|img|center|font|blockquote)\b[^<>]*>", re.I)
_ENDS = re.compile(r"\n\s*\n|(?<=[.!?…])\s+(?=\S)")

# Kinds of bytes: letters (also all that is not ASCII), figures, and what stands between words, by rising weight: a blank or
# mark, a break, a sentence end, the end of a text.
_LETTER, _DIGIT, _MARK, _BREAK, _END, _LAST = range(6)
_WRITTEN = np.array([0, 48, 32, 2, 1, 3], np.uint8)
_KIND = np.full(256, _MARK, np.uint8)
_KIND[np.r_[65:91, 97:123, 128:256]], _KIND[48:58], _KIND[3] = _LETTER, _DIGIT, _LAST
_KIND[np.frombuffer(b"<>()[]|", np.uint8)] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Signs outside ASCII and what stands for them here.
_SIGNS_OF = [("\u2026", ". "), ("\u2014", " - "), ("\u2013", " - "), ("\u00a0", " "), ("\u201c", '"'), ("\u201d", '"'), ("\u2018", "'"), ("\u2019", "'"), ("\x03", " ")]


_WORDED = f"[0-9A-Za-z]|[^\\x00-\\x7f{''.join(sign for sign, _ in _SIGNS_OF[:-1])}]"


def normal(texts: pa.Array) -> bytes:
    """All texts in a row, in lower case, without marks and with every number as 0.

    Words are parted by a blank, by \x02 where a piece of a sentence may begin (after marks that part, figures and line ends,
    before capitals and figures), by \x01 where a sentence ends, and by \x03 after each text.
    """
    for sign, by in _SIGNS_OF:
        texts = pc.replace_substring(texts, sign, by)
    raw = np.frombuffer(b"\x03" + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "\x03")[0].as_py().encode() + b"\x03", np.uint8)
    kind = _KIND[raw]
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    before, after = np.r_[True, blank[:-1]], np.r_[blank[1:], True]
    starts = ((raw >= 65) & (raw <= 90)) | (kind == _DIGIT)
    parted = (blank & np.r_[starts[1:], False]) | (blank & np.r_[False, kind[:-1] == _DIGIT]) | (raw == 10)
    parted |= after & before & (raw == 45) | after & (raw == 58)
    kind[parted & (kind == _MARK)] = _BREAK
    kind[((raw == 46) | (raw == 33) | (raw == 63)) & after] = _END
    # What stands between two words counts once, with its greatest weight; two line ends are a sentence end.
    word = kind <= _DIGIT
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    weight = np.maximum.reduceat(kind, first)
    lines = np.add.reduceat((raw == 10).astype(np.uint8), first)
    weight[(lines > 1) & (weight == _BREAK)] = _END
    between = ~word[first]
    ends = np.r_[first[1:], len(raw)]
    # Marks inside a number vanish.
    figure = kind == _DIGIT
    inner = between & (weight == _MARK) & np.r_[False, figure[first[1:] - 1]] & np.r_[figure[ends[:-1]], False]
    kept = word.copy()
    kept[first[between & ~inner]] = True
    out = _LOWER[raw]
    # Capitals with accents: in UTF-8, C3 80 to C3 9E stand 32 before their small letters.
    out[1:][(raw[:-1] == 0xC3) & (raw[1:] <= 0x9E)] += 32
    out[figure] = 48
    out[first[between]] = _WRITTEN[weight[between]]
    out = out[kept]
    return out[~((out == 48) & np.r_[False, out[:-1] == 48])].tobytes()


def plain(text: str) -> str:
    """The normal form of one message."""
    return " ".join(normal(pa.array([text])).translate(bytes.maketrans(b"\x01\x02\x03", b"   ")).decode().split())


def grams(text: str) -> set[bytes]:
    """4-grams of the bytes of a text; a shorter text is its own."""
    raw = text.encode()
    return {raw[i : i + 4] for i in range(max(1, len(raw) - 3))}


def rare_grams(norms: list[str], often: np.ndarray) -> set[bytes]:
    """Of each text so many 4-grams that a text of SIMILARITY must hold one of them, the rarest ones.

    often counts cells of 4-grams; any counts keep every likeness, good ones keep few others.
    """
    out = set()
    for norm in norms:
        own = sorted(grams(norm))
        need = len(own) - int(np.ceil(SIMILARITY * len(own) - 1e-9)) + 1
        count = often[_cells(own)]
        out |= {own[i] for i in np.argsort(count, kind="stable")[:need]}
    return out


def _cell(value: np.ndarray) -> np.ndarray:
    return (value * np.uint32(0x9E3779B1)) >> np.uint32(10)


def _numbers(raw: np.ndarray) -> np.ndarray:
    wide = raw.astype(np.uint32)
    return wide[:-3] | (wide[1:-2] << 8) | (wide[2:-1] << 16) | (wide[3:] << 24)


def _cells(some: list[bytes]) -> np.ndarray:
    return _cell(np.concatenate([_numbers(np.frombuffer(g.ljust(4, b" ")[:4], np.uint8)) for g in some]))


def _runs(sentence: bytes, hits: list[int], longest: int) -> set[tuple[bytes, bool]]:
    """Runs of pieces of a sentence that hold a 4-gram looked for and are no longer than a likeness can be, and whether all of it."""
    marks = [-1, *(i for i, c in enumerate(sentence) if c == 2), len(sentence)]
    pieces = [(a + 1, b) for a, b in zip(marks, marks[1:]) if b > a + 1]
    out = set()
    for i, (start, _) in enumerate(pieces):
        at = bisect_left(hits, start)
        if at == len(hits):
            break
        for j in range(i, len(pieces)):
            end = pieces[j][1]
            if end - start > longest:
                break
            if hits[at] + 4 <= end:
                out.add((sentence[start:end], i == 0 and j == len(pieces) - 1))
    return out


def _messages(ids: list, form: bytes, table: np.ndarray, longest: int) -> list[tuple]:
    """Ids, runs and whether they are whole sentences: the 4-grams of all texts are looked up at once, sentences with one looked for are read."""
    out, raw = [], np.frombuffer(form.replace(b"\x02", b" "), np.uint8)
    if len(raw) < 4:
        return out
    hits = np.flatnonzero(table[_cell(_numbers(raw))])
    ends = np.flatnonzero((raw == 1) | (raw == 3))
    texts = np.cumsum(raw[ends] == 3) - 1
    at = np.searchsorted(ends, hits, side="right") - 1
    for own in np.split(np.arange(len(hits)), np.flatnonzero(np.diff(at)) + 1) if len(hits) else ():
        one = at[own[0]]
        if 0 <= one < len(ends) - 1:
            start = int(ends[one]) + 1
            runs = _runs(form[start : ends[one + 1]], (hits[own] - start).tolist(), longest)
            out += [(ids[texts[one]], "message", " ".join(run.replace(b"\x02", b" ").decode(errors="replace").split()), None, None, whole) for run, whole in runs]
    return out


def slots(text: str) -> Iterator[tuple[str, str, str, bool]]:
    """Of every span that may be a slot: its form, the surroundings before and after, and whether the form is trusted."""
    for sentence in _ENDS.split(text):
        bare = _TAG.sub(" ", " ".join(sentence.split()))
        for m in _SLOT.finditer(bare):
            before, after = ([w for w in re.findall(r"[^\W\d_]+|\d+", re.sub(r"\d+", "0", _SLOT.sub(" slotx ", part).lower()))] for part in (bare[: m.start()], bare[m.end() :]))
            left = " ".join([*before[-AROUND:], "slotx"]) if len(before) > 1 else None
            right = " ".join(["slotx", *after[:AROUND]]) if len(after) > 1 else None
            yield re.sub(r"\d+", "0", m.group()), left, right, bool(TRUSTED.fullmatch(m.group()))


def _read(wordings: list[str], first: bool):
    longest = max([0, *(int(len(w.encode()) / SIMILARITY) + 4 for w in wordings)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            # Texts without a letter or figure would leave no trace in the row of texts.
            batch = batch.filter(pc.match_substring_regex(batch["text"], _WORDED))
            ids, texts = batch["id"], batch["text"]
            form = normal(texts)
            if table is None:
                # Counts of a stretch of the texts say which 4-grams are rare; they decide the speed, not the result.
                some = np.frombuffer(b"    " + form[: 1 << 20].replace(b"\x02", b" "), np.uint8)
                table = np.zeros(1 << 22, bool)
                if wordings:
                    table[_cells(sorted(rare_grams(wordings, np.bincount(_cell(_numbers(some)), minlength=1 << 22))))] = True
            found = _messages(ids.to_pylist(), form, table, longest)
            if first:
                found += [(one, "latin", "latin", None, None, True) for one in ids.filter(pc.match_substring_regex(texts, LATIN)).to_pylist()]
                held = batch.filter(pc.match_substring_regex(texts, _SIGNS))
                found += [(one, "slot", *each) for one, text in zip(held["id"].to_pylist(), held["text"].to_pylist()) for each in slots(text)]
            schema = pa.schema([("id", ids.type), ("part", pa.string()), ("norm", pa.string()), ("before", pa.string()), ("after", pa.string()), ("trusted", pa.bool_())])
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*found) if found else [[]] * 6, schema.types)], schema=schema)

    return scan


def scanned(records: DataFrame, record_id: str, text: str, wordings: list[str], first: bool = True) -> DataFrame:
    """id, part (message, latin or slot), norm, before, after, trusted: runs that may be like a wording and, at first, the rest.

    trusted says of a slot whether its form is, of a message whether it is a whole sentence.
    """
    body = records.select(F.col(record_id).alias("id"), F.col(text).cast("string").alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    return body.mapInArrow(_read(wordings, first), f"id {dict(body.dtypes)['id']}, part string, norm string, before string, after string, trusted boolean")


def simhashes(texts: list[str]) -> np.ndarray:
    """64-bit SimHash of the 4-grams of each text, as signed numbers."""
    raw = np.frombuffer("".join(t.ljust(4) + "\x03" for t in texts).encode(), np.uint8)
    ends = np.flatnonzero(raw == 3)
    starts = np.r_[0, ends[:-1] + 1]
    inside = np.ones(len(raw), bool)
    for back in range(4):
        inside[ends - back] = False
    at = np.flatnonzero(inside)
    value = _numbers(raw)[at].astype(np.uint64) + np.uint64(1)
    for odd in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        value = (value ^ (value >> np.uint64(31))) * np.uint64(odd)
    value ^= value >> np.uint64(29)
    first = np.searchsorted(at, starts)
    ones = np.add.reduceat(np.unpackbits(value.view(np.uint8).reshape(-1, 8), axis=1), first, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > np.diff(np.r_[first, len(at)])[:, None], axis=1).view(np.int64)[:, 0]


def simhash(text: str) -> int:
    return int(simhashes([text])[0])


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 4096):
            part = batch.iloc[at : at + 4096]
            yield part.assign(sim=simhashes(part["norm"].tolist()))


def vertices(each: DataFrame) -> DataFrame:
    """Distinct rows of norm, with a label if any row has one and whether any stands alone, and their SimHash."""
    distinct = each.where("norm <> ''").groupBy("norm").agg(F.min("label").alias("label"), F.max("alone").alias("alone"))
    return distinct.mapInPandas(_hashed, "norm string, label string, alone boolean, sim long")


def _tables(df: DataFrame) -> DataFrame:
    """Each row once for each two parts of its SimHash: part names the table, bits is the key in it."""
    width = 64 // PARTS
    both = F.array(*[F.lit(a * PARTS + b) for a in range(PARTS) for b in range(a)])
    cell = f"CAST(shiftright(sim, {width} * ({{}})) & {2**width - 1}L AS int)"
    return df.withColumn("part", F.explode(both)).withColumn("bits", F.expr(f"{cell.format(f'part DIV {PARTS}')} * {2**width} + {cell.format(f'part % {PARTS}')}"))


def _alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose 4-grams have at least SIMILARITY of their union in common."""
    for batch in batches:
        own = {text: grams(text) for text in {*batch["norm"], *batch["known"]}}
        both = [len(own[a] & own[b]) / len(own[a] | own[b]) for a, b in zip(batch["norm"], batch["known"])]
        yield batch[np.array(both, float) >= SIMILARITY]


def propagated(points: DataFrame) -> DataFrame:
    """norm, label, alone and hops of every vertex whose component holds a labelled one; hops counts links from a trusted one.

    Each hop joins the newly labelled with the unlabelled in all tables; only counts reach the driver. A run inside a
    sentence takes a label and hands none on, as runs of one sentence are like each other by their nature.
    """
    done = points.where("label IS NOT NULL").withColumn("hops", F.lit(0))
    frontier, rest, hops = done, points.where("label IS NULL"), 0
    while (size := frontier.where("alone").count()) > 0:
        hops += 1
        near = _tables(frontier.where("alone").select(F.col("norm").alias("known"), F.col("label").alias("kind"), "sim"))
        near = F.broadcast(near) if size <= SENT else near
        met = _tables(rest.select("norm", "alone", "sim")).withColumnRenamed("sim", "own").join(near, ["part", "bits"])
        met = met.where(F.bit_count(F.col("sim").bitwiseXOR(F.col("own"))) <= HAMMING)
        met = met.select("norm", "own", "alone", "known", "kind").distinct()
        met = met.mapInPandas(_alike, met.schema)
        frontier = met.groupBy("norm").agg(F.min("kind").alias("label"), F.max("alone").alias("alone"), F.min("own").alias("sim"))
        frontier = cut_lineage(frontier.withColumn("hops", F.lit(hops)))
        done = done.unionByName(frontier)
        rest = rest.join(frontier.select("norm"), "norm", "left_anti")
    return done.select("norm", "label", "alone", "hops")


def _slot_rows(found: DataFrame) -> DataFrame:
    """id and how each slot was known: 0 by its form, 1 by its surroundings, 2 by other places of the form, 3 by its syntax."""
    places = found.where("part = 'slot'")
    around = F.explode(F.array_compact(F.array("before", "after"))).alias("norm")
    sides = places.select(F.when(F.col("trusted"), "placeholder").alias("label"), F.lit(True).alias("alone"), around)
    known = propagated(cut_lineage(vertices(sides))).select("norm", F.lit(True).alias("is"))
    placed = places.join(known.select(F.col("norm").alias("before"), F.col("is").alias("by")), "before", "left").join(known.select(F.col("norm").alias("after"), F.col("is").alias("to")), "after", "left")
    placed = cut_lineage(placed.select("id", "norm", "trusted", F.coalesce("by", "to", F.lit(False)).alias("near")))
    # Words of a form are masked, small and capital ones apart; single letters stay.
    syntax = F.regexp_replace(F.regexp_replace("norm", r"[A-Z][A-Za-z]+(?:[ _.][A-Za-z]+)*", "W"), r"[a-z][A-Za-z]+(?:[ _.][A-Za-z]+)*", "w")
    forms = placed.groupBy("norm").agg(F.avg(F.col("near").cast("double")).alias("share"), F.count("*").alias("n")).withColumn("syntax", syntax)
    kinds = forms.groupBy("syntax").agg((F.sum(F.col("share") * F.col("n")) / F.sum("n")).alias("all"))
    forms = forms.join(kinds, "syntax").select("norm", "share", "all")
    how = F.when(F.col("trusted"), 0).when(F.col("near") & (F.col("share") > HARDLY), 1).when(F.col("share") >= MOSTLY, 2).when(F.col("all") >= NEARLY_ALL, 3)
    return placed.join(forms, "norm").select("id", F.lit("placeholder").alias("label"), how.alias("hops")).where("hops IS NOT NULL")


def _runs_of(found: DataFrame) -> DataFrame:
    return found.where("part = 'message'").select("norm", F.lit(None).cast("string").alias("label"), F.col("trusted").alias("alone"))


def residue(records: DataFrame, record_id: str, text: str, messages: dict[str, list[str]] | None = None) -> DataFrame:
    """id, label, n (places) and hops of every record that holds residue.

    hops is 0 if a trusted wording or form stands in the record, else the least number of links that led to it.
    """
    spark = records.sparkSession
    seeds = sorted({(plain(m), label) for label, some in (MESSAGES if messages is None else messages).items() for m in some})
    trusted = spark.createDataFrame(seeds, "norm string, label string")
    found = cut_lineage(scanned(records, record_id, text, [norm for norm, _ in seeds]))
    points = cut_lineage(vertices(_runs_of(found).unionByName(trusted.withColumn("alone", F.lit(True)))))
    known = points.where("label IS NOT NULL").select("norm")
    while True:
        labels = cut_lineage(propagated(points))
        fresh = cut_lineage(labels.where("alone").select("norm").join(known, "norm", "left_anti"))
        if not (size := fresh.count()):
            break
        # What is like the newly labelled; so many wordings are sent at once, more are sent in turns.
        turns = -(-size // SENT)
        for turn in range(turns):
            own = [r.norm for r in fresh.where(F.pmod(F.xxhash64("norm"), F.lit(turns)) == turn).collect()]
            more = cut_lineage(scanned(records, record_id, text, own, False))
            points = points.unionByName(vertices(_runs_of(more).join(points.select("norm"), "norm", "left_anti")))
            found = found.unionByName(more)
        known, points = labels.select("norm"), cut_lineage(points.dropDuplicates(["norm"]))
    found = found.distinct()
    said = found.where("part = 'message'").join(labels, "norm").select("id", "label", "hops")
    latin = found.where("part = 'latin'").select("id", F.lit("filler").alias("label"), F.lit(0).alias("hops"))
    return said.unionByName(latin).unionByName(_slot_rows(found)).groupBy("id", "label").agg(F.count("*").alias("n"), F.min("hops").alias("hops"))
