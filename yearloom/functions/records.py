"""Small record-level functions as column expressions: labels, options, calendars, schedules, token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decoded_label(label: Column, letters: str = "ABCD") -> Column:
    """The letter of a 0-based label; null outside the letters."""
    return F.when(label.between(0, len(letters) - 1), F.substring(F.lit(letters), (label + 1).cast("int"), F.lit(1)))


def options(text: Column, n: int = 5) -> Column:
    """Values of 'a ) 24 , b ) 120 , ...'; null unless there are n."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"[a-z] \) ([^,]+)")), lambda v: F.trim(v))
    return F.when(F.size(found) == n, found)


def two_records(question: Column, verdict: Column, scale: Column) -> Column:
    """The yes-or-no and the scale record of one answered question, as an array to explode."""
    return F.array(
        F.struct(F.lit("yes_no").alias("kind"), F.concat(question, F.lit(" Answer Yes or No.")).alias("prompt"), verdict.alias("answer")),
        F.struct(F.lit("scale").alias("kind"), F.concat(question, F.lit(" How far do you agree?")).alias("prompt"), scale.alias("answer")),
    )


# What the probes add to a question.
SCALE_LEAD = "Respond to the following question by rating your agreement"
CUES = {"yes_no": "Think step by step about the reasons, then answer Yes or No.", "scale": "Think step by step about the reasons, then give your rating."}


def probe_prompt(question: Column, kind: str, reasoned: bool = False, chat: bool = False) -> Column:
    """The prompt of a probe: yes_no or scale, answered at once or after reasoning, bare or as a chat turn."""
    if kind not in CUES:
        raise ValueError(f"unknown probe {kind!r}")
    lead = "" if kind == "yes_no" else SCALE_LEAD + (".\n\n" if reasoned else ":\n\n")
    body = F.concat(F.lit(lead), question, F.lit("\n\n" + (CUES[kind] if reasoned else "Answer:")))
    return F.concat(F.lit("User: "), F.trim(body), F.lit("\n\nAssistant:")) if chat else body


def choice_prompt(question: Column, choices: Column, letters: str = "ABCD") -> Column:
    """A question with a line '- choice=letter' for each choice; null unless there are as many choices as letters."""
    lines = F.zip_with(choices, F.array(*[F.lit(x) for x in letters]), lambda c, x: F.concat(F.lit("- "), c, F.lit("="), x))
    return F.when(F.size(choices) == len(letters), F.concat(question, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\nAnswer:")))


def moved_letter(answer: Column, native: str, letters: str) -> Column:
    """The letter that stands at the answer's place among other letters; null for an answer that is none."""
    at = F.instr(F.lit(native), answer)
    return F.when((F.length(answer) == 1) & (at > 0), F.substring(F.lit(letters), at, F.lit(1)))


def calculator_results(text: Column) -> Column:
    """Results of the calculator tags <<expr=result>> of a text, in order."""
    return F.regexp_extract_all(text, F.lit(r"<<[^=<>]*=([^<>]*)>>"))


def code_block(text: Column) -> Column:
    """The first fenced block of a reply, or the whole reply."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)```(?:python)?\s*\n(.*?)\n```", 1), F.lit("")), text)


def congress(year: Column) -> Column:
    """Number of the Congress that sits in a year; the first began in 1789."""
    return (F.floor((year - 1789) / 2) + 1).cast("int")


def congress_years(number: Column, padding: int = 0) -> Column:
    """The years of a Congress, with so many more on both sides for sessions that run over."""
    first = 1789 + 2 * (number - 1)
    return F.sequence((first - padding).cast("int"), (first + 1 + padding).cast("int"))


def edition(year: Column) -> Column:
    """Which edition of the record covers a year: the bound one ends where the daily one begins, in 2011."""
    return F.when(year >= 2011, "daily").otherwise("bound")


def learning_rate(step: Column, total: Column, peak: float, warm_up: float = 0.03, floor: float = 0.1) -> Column:
    """Linear warm-up, then a cosine down to the floor's share of the peak."""
    warm = F.greatest(F.lit(1.0), F.floor(total * warm_up + 0.5))
    left = F.least(F.lit(1.0), (step - warm) / F.greatest(F.lit(1.0), total - warm))
    return F.when(step < warm, peak * (step + 1) / warm).otherwise(peak * (floor + (1 - floor) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * left))))


def ladder_steps(ladder: str, total: int) -> list[tuple[int, str]]:
    """Steps and names of 'frac:name,...', ascending; at least step 1, halves round to even."""
    parts = [p.split(":") for p in ladder.split(",") if p.strip()]
    return sorted((max(1, round(float(f) * total)), name.strip()) for f, name in parts)


def letter_count(word: Column, letter: str) -> Column:
    return (F.length(word) - F.length(F.replace(word, F.lit(letter), F.lit("")))).cast("int")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), " ", "-")


def common_prefix(one: Column, two: Column) -> Column:
    """Number of equal leading elements of two arrays."""
    n = F.least(F.size(one), F.size(two))
    first = F.array_position(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.element_at(one, i) != F.element_at(two, i)), True)
    return F.when(n <= 0, 0).when(first == 0, n).otherwise(first - 1).cast("int")


def cropped(tokens: Column, n: int) -> Column:
    """The last n elements."""
    return F.when(F.size(tokens) > n, F.slice(tokens, -n, n)).otherwise(tokens)


def cropped_span(start: Column, stop: Column, size: Column, n: int) -> Column:
    """Where a span of a token array lies after the array was cropped to its last n elements."""
    gone = F.greatest(F.lit(0), size - n)
    return F.struct(F.greatest(F.lit(0), start - gone).alias("start"), F.greatest(F.lit(0), stop - gone).alias("stop"))


def padded(tokens: Column, n: int, pad: Column) -> Column:
    """Padded on the right to n elements."""
    return F.concat(tokens, F.array_repeat(pad, F.greatest(F.lit(0), n - F.size(tokens))))


def cut_at(text: Column, *stops: str) -> Column:
    """A generated text up to the first stop string."""
    for stop in stops:
        text = F.substring_index(text, stop, 1)
    return text


def reasoned_prefix(text: Column, mark: str = "Answer:") -> Column:
    """A reasoning up to and with its answer mark, which is added if it is missing."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, F.lit(1), at + len(mark) - 1)).otherwise(F.concat(F.rtrim(text), F.lit("\n" + mark)))
