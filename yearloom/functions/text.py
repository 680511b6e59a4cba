"""Text functions as column expressions. White space is that of Java's \\s plus what trim leaves; no-break space is text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squash(text: Column) -> Column:
    """Runs of white space become one blank, the ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def cut_to(text: Column, n: int, suffix: str = "") -> Column:
    """The first n characters, with the suffix if something was cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(suffix))).otherwise(text)


def word_count(text: Column) -> Column:
    """Words between white space; 0 for blank, null for null."""
    flat = squash(text)
    return F.when(flat == "", 0).otherwise(F.size(F.split(flat, " "))).cast("int")


def whole_number(text: Column) -> Column:
    """int(float(text)) or null: '12.7' gives 12, 'n/a' null."""
    return F.expr("null") if text is None else text.try_cast("double").cast("long")


def clean_share(text: Column) -> Column:
    """Share of letters, digits and white space among the characters; null for an empty text."""
    kept = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", ""))
    return F.try_divide(kept.cast("double"), F.length(text))


def is_garbage(text: Column, least: float = 0.5) -> Column:
    """OCR garbage: empty, or fewer clean characters than the least share."""
    return F.coalesce(clean_share(text) < least, F.lit(True))


def without_tags(html: Column) -> Column:
    """Markup tags become blanks."""
    return F.regexp_replace(html, r"<[^>]+>", " ")


def without_fences(text: Column) -> Column:
    """A reply without its code fences."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s*```[A-Za-z]*\s*", ""), r"\s*```\s*$", "")


def chunks(text: Column, size: int, least: int) -> Column:
    """Array of runs of `size` words; a tail shorter than `least` is dropped. Null for null."""
    words = F.split(squash(text), " ")
    cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(size)), lambda at: F.slice(words, at + 1, F.lit(size)))
    return F.transform(F.filter(cuts, lambda part: F.size(part) >= least), lambda part: F.array_join(part, " "))


def last_marked_number(text: Column) -> Column:
    """The last '#### number' of a text, commas removed, as a plain number: 72.0 gives 72."""
    found = F.regexp_replace(F.try_element_at(F.regexp_extract_all(text, F.lit(r"#### (-?[0-9.,]+)")), F.lit(-1)), ",", "")
    value = found.try_cast("double")
    return F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))


def first_marked_number(text: Column) -> Column:
    """The first '#### number' with commas removed, as text."""
    return F.nullif(F.regexp_replace(F.regexp_extract(text, r"#### (-?[0-9.,]+)", 1), ",", ""), F.lit(""))


def brackets_only(text: Column) -> Column:
    """The brackets of a text, one blank between them."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^()\[\]<>{}]", ""), r"(.)", "$1 "))


def first_of(name: Column, *patterns: str) -> Column:
    """First group of the first pattern that is found, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(name, p, 1), F.lit("")) for p in patterns])


def experiment_parts(name: Column) -> Column:
    """year, backend, spec, x, sft of an experiment name; all null for a name of another form."""
    form = r"^policy_(\d{4})_([a-z]+)_((?:roll|exp)\d+(?:\.\d+)?|cum|single)_n(\d+)((?:_[a-z]+)?)$"
    part = [F.nullif(F.regexp_extract(name, form, k), F.lit("")) for k in range(1, 6)]
    return F.struct(part[0].cast("int").alias("year"), part[1].alias("backend"), part[2].alias("spec"), part[3].cast("int").alias("x"), F.when(part[0].isNotNull(), F.coalesce(part[4] == "_sft", F.lit(False))).alias("sft"))
