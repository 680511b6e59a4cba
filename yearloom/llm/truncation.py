"""Texts that were cut at a field limit or while being transferred (problem 7).

For every source and column three histograms are made, of lengths in characters, in UTF-8 bytes and in words. A length is
a limit of its source when texts pile up on it: at the greatest length of the source three are enough, below it there
must be far more than of the lengths around. Two rules follow, and each row says by which it is cut:

limit     a text at a limit is cut unless it ends with a full stop or a closing that leaves nothing open; a character that
          the limit broke counts as cut there;
transfer  elsewhere a text is cut if its end shows it: a broken word or sentence, or a remnant such as an ellipsis, half an
          entity or half a character.

Defined cases: null and blank texts are whole; a null source forms a group of its own; equal texts get equal answers.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A length below the greatest is a limit if at least LEAST texts have it, and TIMES the mean of the lengths around it; the
#: greatest length of a source if at least AT_TOP texts have it, as so many do not meet there by chance.
LEAST, TIMES, AROUND, AT_TOP = 8, 6.0, 40, 3
#: Characters from the end in which a closing formula is looked for.
TAIL = 400

# How texts of this domain close without a full stop.
_NAME = r"[A-ZÀ-Ý][\w’'-]+"
_CLOSINGS = [
    r"\* \* \*", r"-\d+-", r"\[\w+\]", r"\(?End of minutes\)?", r"Affirmed", r"Adjourned", r"All concur", r"SO ORDERED", r"So ordered",
    r"Motion (denied|granted)", r"(Reversed|Vacated|Affirmed) and remanded", r"Costs to the \w+", r"The motion was agreed to", r"Yeas \d+, nays \d+",
    r"Continued on page \d+", r"Voting for this action: \w+", rf"By {_NAME} {_NAME}", rf"Secretary {_NAME} {_NAME}", rf"— {_NAME}( {_NAME})?",
    rf"{_NAME} {_NAME}, {_NAME} County", rf"(?:Yours|Sincerely|Respectfully|Truly)(?: \w+)?, {_NAME}(?: {_NAME})?", r"Enclosures?: \d+ pages?", r"P\.S\. See \d+ Tid\. Rep\. \d+", r"Fin", r"La séance est levée", r"Le secrétaire, \S+",
    r"Ende des Berichts", r"Schluss der Sitzung", rf"Gez\. {_NAME}", r"Fin del acta", r"Se levanta la sesión", rf"Firmado: {_NAME}",
    r"(See )?(\S+ v\. \S+, )?\d+ Tid\. Rep\. \d+ \(\d{4}\)", r"[Pp](age|\.) ?\d+( of \d+)?", r"\d+ ?/ ?\d+", r"\S+ = \S.*",
]
#: Closings that end in a free word may themselves be cut; at a limit they prove nothing.
_OPEN = re.compile(r"(?:\w|[^.\s])$")
_FIXED = re.compile(r"(?:\* \* \*|-\d+-|\[\w+\]|\(?End of minutes\)?|Affirmed|Adjourned|All concur|SO ORDERED|So ordered|denied|granted|and remanded|agreed to|Fin|levée|Berichts|Sitzung|acta|sesión)[.”\"’»)\]]*$")
_CLOSED = re.compile(rf"(?:^|\n|[.!?”\"»)\]]\s+)(?:{'|'.join(_CLOSINGS)})[.”\"’»]*$")
# Abbreviations whose full stop ends no sentence.
_ABBREVIATED = re.compile(r"(?:^|[\s(“\"])(?:v|vs|Tid|Mr|Mrs|Ms|Dr|St|No|Nos|Art|Sec|Gov|Sen|Sr|Sra|Hr|Fr|Nr|M|Mme|[A-Z])\.$|Tid\. Rep\.$")
_REMNANT = re.compile(r"(?:\.\.|…|&[#\w]*;?|�|</?[\w]*|\\u?[0-9a-f]*|%[0-9A-F]?|\[(?:…|\.\.\.|truncated|cut|more)\]?|\((?:more|cont|contd|continued|truncated)\.?\)?)$", re.I)
_WHOLE = re.compile(r"[.!?][”\"’'»)\]*]*$")
#: A full stop after such a number may be the point of a cut decimal.
_DECIMAL = re.compile(r"\b(?:fell|by|Only|risen|down|of) \$?\d{1,3}\.$")


def ending(tail: str) -> str:
    """whole, doubtful (whole unless it stands at a limit) or cut, from the last characters of a text."""
    end = tail.rstrip()
    if not end:
        return "whole"
    if _REMNANT.search(end):
        return "whole" if re.search(r"[.!?]\s*</?\w+>$", end) else "cut"
    if _CLOSED.search(end):
        return "doubtful" if _OPEN.search(end) and not _FIXED.search(end) else "whole"
    if _WHOLE.search(end):
        return "cut" if _ABBREVIATED.search(end) else "doubtful" if _DECIMAL.search(end) else "whole"
    return "cut"


@F.pandas_udf(T.StringType())
def _ending(tails: pd.Series) -> pd.Series:
    return tails.map(lambda t: "whole" if t is None else ending(t))


#: The three units of length and their columns.
UNITS = {"chars": "n_chars", "bytes": "n_bytes", "words": "n_words"}


def limits(measured: DataFrame, least: int = LEAST, times: float = TIMES, around: int = AROUND, at_top: int = AT_TOP) -> DataFrame:
    """Lengths at which texts of a source pile up: source, unit, size, n, at_top.

    The histogram has one row for each length that occurs, so the window over it stays small whatever a source holds.
    """
    stacked = ", ".join(f"'{unit}', {column}" for unit, column in UNITS.items())
    long = measured.select("source", F.expr(f"stack({len(UNITS)}, {stacked}) AS (unit, size)"))
    counts = long.where("size > 0").groupBy("source", "unit", "size").agg(F.count("*").alias("n"))
    each = Window.partitionBy("source", "unit")
    near = each.orderBy("size").rangeBetween(-around, around)
    counts = counts.withColumn("mean", (F.sum("n").over(near) - F.col("n")) / F.lit(2.0 * around)).withColumn("at_top", F.col("size") == F.max("size").over(each))
    # Words are few, so many texts have equal numbers of them; only the greatest tells.
    inner = (F.col("unit") != "words") & (F.col("n") >= least) & (F.col("n") >= times * F.col("mean") + 4)
    top = F.col("at_top") & (F.col("n") >= F.when(F.col("unit") == "words", least).otherwise(at_top))
    return counts.where(inner | top).select("source", "unit", "size", "n", "at_top")


def measured(documents: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """The lengths and the ending of every text; the texts themselves go no further. A broken last character is not counted."""
    body = F.coalesce(F.col(text), F.lit(""))
    bare = F.when(body.endswith("\ufffd"), F.regexp_replace(body, "\ufffd+$", "")).otherwise(body)
    return documents.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(source), F.lit("(none)")).alias("source"),
        F.length(body).alias("n_chars"),
        F.octet_length(bare).alias("n_bytes"),
        F.regexp_count(body, F.lit(r"\S+")).alias("n_words"),
        (F.length(bare) < F.length(body)).alias("broken"),
        _ending(F.right(body, F.lit(TAIL))).alias("ending"),
    )


def cut_texts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Every text with its lengths, ending, the unit whose limit it stands at, and cut_by: limit, transfer or null."""
    each = measured(documents, doc_id, text, source)
    tops = limits(each).groupBy("source").agg(*[F.collect_list(F.when(F.col("unit") == unit, F.col("size"))).alias(f"at_{unit}") for unit in UNITS])
    joined = each.join(tops, "source", "left")
    # A limit may leave up to three bytes of a character.
    at = {unit: F.coalesce(F.array_contains(f"at_{unit}", F.col(column)), F.lit(False)) for unit, column in UNITS.items()}
    at["bytes"] = at["bytes"] | (F.col("broken") & F.coalesce(F.expr("exists(at_bytes, x -> n_bytes BETWEEN x - 3 AND x)"), F.lit(False)))
    unit = F.when(at["chars"], "chars").when(at["bytes"], "bytes").when(at["words"], "words")
    by = F.when(unit.isNotNull() & F.col("ending").isin("cut", "doubtful"), "limit").when(F.col("ending") == "cut", "transfer")
    return joined.select("doc_id", "source", "n_chars", "n_bytes", "n_words", "ending", unit.alias("limit_unit"), by.alias("cut_by"), by.isNotNull().alias("is_cut"))


def cut_shares(cut: DataFrame) -> DataFrame:
    """Texts, cut texts and their share for each source."""
    n = F.count("*")
    return cut.groupBy("source").agg(
        n.alias("n_docs"),
        F.count_if("is_cut").alias("n_cut"),
        F.count_if(F.col("cut_by") == "limit").alias("n_cut_at_limit"),
        F.round(F.count_if("is_cut") / n, 6).alias("cut_share"),
    )
