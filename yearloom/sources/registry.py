"""Sources by name; each reads a folder lazily and returns passages: doc_id, source, text, year, word_count and extras."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yearloom.functions.records import edition
from yearloom.functions.text import chunks, is_garbage, squash, whole_number, without_tags, word_count
from yearloom.operators.chat import rendered, split_prompt

PASSAGE = ["doc_id", "source", "text", "year", "word_count"]


@dataclass(frozen=True)
class Wanted:
    """What to select: empty lists filter nothing; years are inclusive."""

    first_year: int | None = None
    last_year: int | None = None
    collections: tuple[str, ...] = ()
    languages: tuple[str, ...] = ("English",)
    least_words: int = 100
    most_words: int | None = None
    extra: dict[str, str] = field(default_factory=dict)


Source = Callable[[SparkSession, str, Wanted], DataFrame]
_SOURCES: dict[str, Source] = {}


def source(name: str) -> Callable[[Source], Source]:
    def register(read: Source) -> Source:
        _SOURCES[name] = read
        return read

    return register


def get(name: str) -> Source:
    if name not in _SOURCES:
        raise KeyError(f"unknown source {name!r}; known: {', '.join(sorted(_SOURCES))}")
    return _SOURCES[name]


def names() -> list[str]:
    return sorted(_SOURCES)


def text_column(df: DataFrame, order: tuple[str, ...] = ("text_cleaned", "text", "content", "body")) -> Column:
    """The first column of the order that a table has; the order is the caller's, as callers differ."""
    for name in order:
        if name in df.columns:
            return F.col(name)
    raise KeyError(f"none of {order} among {df.columns}")


def _within(df: DataFrame, wanted: Wanted) -> DataFrame:
    """Filters that every source shares; simple comparisons, so they reach the parquet scan."""
    df = df.where(F.col("text").isNotNull() & F.col("text").rlike(r"\S"))
    if wanted.first_year is not None:
        df = df.where(F.col("year") >= wanted.first_year)
    if wanted.last_year is not None:
        df = df.where(F.col("year") <= wanted.last_year)
    df = df.where(F.col("word_count") >= wanted.least_words)
    return df if wanted.most_words is None else df.where(F.col("word_count") <= wanted.most_words)


@source("bulk_corpus")
def bulk_corpus(spark: SparkSession, folder: str, wanted: Wanted) -> DataFrame:
    """Parquet by year folder, raw/<year>/subset_*.parquet; the year is read from the path if no column has it."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "subset_*.parquet").parquet(folder)
    if wanted.collections:
        df = df.where(F.col("collection").isin(list(wanted.collections)))
    if wanted.languages:
        df = df.where(F.col("language").isin(list(wanted.languages)))
    year = F.col("year") if "year" in df.columns else F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{4})/[^/]+$", 1)
    out = df.select(F.col("identifier").alias("doc_id"), F.concat(F.lit("bulk_corpus:"), "collection").alias("source"), "text", year.cast("string").try_cast("int").alias("year"), F.col("word_count").cast("int").alias("word_count"), "collection")
    return _within(out, wanted)


@source("daily_paper")
def daily_paper(spark: SparkSession, folder: str, wanted: Wanted) -> DataFrame:
    """Parquet of articles; a file year of 0 or null gives way to the publication date's."""
    df = spark.read.parquet(folder)
    year = F.coalesce(F.nullif(F.col("file_year").cast("string").try_cast("int"), F.lit(0)), F.substring(F.col("pub_date").cast("string"), 1, 4).try_cast("int"))
    out = df.select(F.col("_id").alias("doc_id"), F.lit("daily_paper").alias("source"), F.col("combined_text").alias("text"), year.alias("year"), F.col("word_count").cast("int").alias("word_count"), F.col("headline_main").alias("headline"))
    return _within(out, wanted)


@source("weekly_paper")
def weekly_paper(spark: SparkSession, folder: str, wanted: Wanted) -> DataFrame:
    """Parquet by week, year at the start of the file name; counts are text and may be missing; OCR garbage is dropped.

    An article without an id is named by its file and its row in it.
    """
    df = spark.read.parquet(folder).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    words = F.coalesce(whole_number(F.col("word_count")), word_count(F.col("ocr_text")).cast("long")).cast("int")
    year = F.substring(F.substring_index("_file", "_", 1), 1, 4).try_cast("int")
    ident = F.coalesce("article_id", F.concat_ws(":", F.regexp_replace("_file", r"\.parquet$", ""), F.col("_row").cast("string")))
    out = df.select(ident.alias("doc_id"), F.lit("weekly_paper").alias("source"), F.regexp_replace("ocr_text", r"^\s+|\s+$", "").alias("text"), year.alias("year"), words.alias("word_count"))
    return _within(out, wanted).where(~is_garbage(F.col("text")))


@source("floor_speeches")
def floor_speeches(spark: SparkSession, folder: str, wanted: Wanted) -> DataFrame:
    """Pipe text, descr_*.txt and speeches_*.txt of the same session: the index is filtered, then the speeches join it.

    The files may lie in folders of two editions, bound and daily; each year is then taken from the edition that covers it.
    """
    path = F.col("_metadata.file_path")
    session = F.concat(F.regexp_extract(path, r"/([^/]*)/[^/]+$", 1), F.lit("/"), F.regexp_extract(path, r"_(\d+)\.txt$", 1))
    part = F.split("value", r"\|")
    nested = spark.read.option("recursiveFileLookup", "true")
    lines = nested.option("pathGlobFilter", "descr_*.txt").text(folder).select(session.alias("session"), part.alias("p"), F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
    index = lines.where((F.size("p") >= 14) & F.col("p")[2].rlike(r"^\d{4}")).select(
        "session", "at", F.col("p")[0].alias("doc_id"), F.substring(F.col("p")[2], 1, 4).cast("int").alias("year"), F.col("p")[13].try_cast("int").alias("word_count")
    )
    # Of lines with the same id the last one counts.
    index = index.groupBy("session", "doc_id").agg(F.max_by(F.struct("year", "word_count"), "at").alias("last")).select("session", "doc_id", "last.*")
    of = F.regexp_extract("session", r"(bound|daily)[^/]*/", 1)
    index = index.where((F.col("word_count") >= max(200, wanted.least_words)) & ((of == "") | (of == edition(F.col("year")))))
    said = nested.option("pathGlobFilter", "speeches_*.txt").text(folder).where(F.col("value").contains("|")).select(
        session.alias("session"), F.substring_index("value", "|", 1).alias("doc_id"), F.regexp_replace("value", r"^[^|]*\|", "").alias("text")
    )
    out = said.join(index, ["session", "doc_id"]).select("doc_id", F.lit("floor_speeches").alias("source"), "text", "year", "word_count", F.substring_index("session", "/", -1).alias("session"))
    return _within(out, wanted)


@source("meeting_pages")
def meeting_pages(spark: SparkSession, folder: str, wanted: Wanted) -> DataFrame:
    """Minutes and statements in HTML below <year>/<meeting>/, markup taken off, cut into chunks of 400 words (200 at least)."""
    pages = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "{minutes*,*statement*}.html").text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    pages = pages.select(F.regexp_extract(path, r"/(\d{4})/[^/]+/[^/]+$", 1).try_cast("int").alias("year"), F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1).alias("meeting"), F.regexp_extract(path, r"/([^/]+)\.html$", 1).alias("stem"), squash(without_tags(F.col("value"))).alias("body"))
    cut = pages.select("year", "meeting", "stem", F.posexplode(chunks(F.col("body"), 400, 200)).alias("j", "text"))
    out = cut.select(F.concat_ws(":", F.lit("meeting"), "meeting", "stem", "j").alias("doc_id"), F.lit("meeting_pages").alias("source"), "text", "year", word_count(F.col("text")).alias("word_count"))
    return _within(out, wanted)


def documents_of(spark: SparkSession, path: str, order: tuple[str, ...] = ("text", "content", "body")) -> DataFrame:
    """Texts of a .jsonl, .parquet or .txt path or of a folder of .txt files (one text a file; a file parted by --- lines is several)."""
    if path.endswith(".jsonl"):
        df = spark.read.schema(", ".join(f"{c} string" for c in order)).json(path)
        return df.select(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in order]).alias("text")).where("text IS NOT NULL")
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
        return df.select(text_column(df, order).alias("text")).where("text IS NOT NULL")
    whole = spark.read.text(path, wholetext=True)
    # A single file without such lines holds a text a line.
    parts = F.when(F.lit(path.endswith(".txt")) & ~F.col("value").contains("\n---\n"), F.split("value", "\n")).otherwise(F.split("value", r"\n---\n"))
    each = whole.select(F.explode(parts).alias("text"))
    return each.select(F.regexp_replace("text", r"^\s+|\s+$", "").alias("text")).where("text <> ''")


def first_passages(passages: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n passages in a stored order (n is the feature: a caller asks for so many)."""
    return passages.orderBy(*order).limit(n)


def item_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Items of JSON lines; blank lines and lines that are no JSON are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("item")).where("item IS NOT NULL").select("item.*")


def variant_files(spark: SparkSession, folder: str) -> DataFrame:
    """event_id and question of all <event_id>.jsonl files of a folder; blank questions and other types are dropped."""
    lines = spark.read.option("pathGlobFilter", "*.jsonl").text(folder)
    event = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.jsonl$", 1)
    raw = F.get_json_object("value", "$.variant_question")
    quoted = F.col("value").rlike(r'"variant_question"\s*:\s*"')
    return lines.select(event.alias("event_id"), F.when(quoted, F.trim(raw)).alias("question")).where("question <> ''")


def step_map(spark: SparkSession, path: str) -> DataFrame:
    """year, step of a CSV with a header; rows without either are dropped."""
    return spark.read.csv(path, header=True, schema="year int, step long").where("year IS NOT NULL AND step IS NOT NULL")


def split_files(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """Rows of the parquet files of a folder: the last file by name is val, the others are train."""
    if split not in ("train", "val"):
        raise ValueError(f"unknown split {split!r}")
    rows = spark.read.parquet(folder).select("*", F.col("_metadata.file_name").alias("_file"))
    last = rows.agg(F.max("_file").alias("_last"))
    kept = rows.join(F.broadcast(last), (F.col("_file") == F.col("_last")) if split == "val" else (F.col("_file") < F.col("_last")))
    return kept.drop("_file", "_last")


def strided_rows(spark: SparkSession, folder: str, start: int, step: int, rows: int = 1000) -> DataFrame:
    """Every step-th stretch of `rows` rows of each file, from the start-th on; the readers of all starts share the rows without overlap."""
    each = spark.read.parquet(folder).select("*", F.col("_metadata.row_index").alias("_row"))
    return each.where(F.pmod(F.floor(F.col("_row") / rows), F.lit(step)) == start).drop("_row")


def training_documents(spark: SparkSession, path: str, marks: tuple[str, ...] = ("text", "content", "body")) -> DataFrame:
    """prompt and response of training files: rendered chats of JSON lines with messages, plain texts as a response alone."""
    if path.endswith(".jsonl"):
        schema = "messages array<struct<role: string, content: string>>, " + ", ".join(f"{c} string" for c in marks)
        lines = item_lines(spark, path, schema)
        spoken = rendered(F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.trim(m["content"]).alias("content"))))
        body = F.coalesce(F.when(F.size("messages") > 0, spoken), *[F.nullif(F.col(c), F.lit("")) for c in marks])
        return lines.select(split_prompt(body).alias("p")).where("p.response IS NOT NULL").select("p.prompt", "p.response")
    return documents_of(spark, path, marks).select(F.lit("").alias("prompt"), F.col("text").alias("response"))


def union(parts: list[DataFrame]) -> DataFrame:
    """Passages of several sources; extras that a source lacks are null."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


BATTERY = T.StructType([T.StructField(c, T.IntegerType() if c == "event_year" else T.StringType()) for c in ("event_id", "event_year", "benchmark_question", "adoption_object", "domain", "institution", "policy_or_case")])


def battery_csv(spark: SparkSession, path: str) -> DataFrame:
    """Policy events with a question; without one it is made from the adopted object."""
    df = spark.read.csv(path, header=True, schema=BATTERY, multiLine=True, escape='"')
    asked = F.coalesce(F.nullif(F.trim("benchmark_question"), F.lit("")), F.concat(F.lit("Should the United States have "), "adoption_object", F.lit("?")))
    return df.withColumn("benchmark_question", asked)


def evaluation_files(spark: SparkSession, folder: str) -> DataFrame:
    """Policies of all eval.json files below a folder: path, year_model, policy_id, enactment_year, p_yes, likert, n_variants."""
    shape = "struct<id: string, implementation_year: int, scores: struct<yes_no: struct<mean_p_yes: double, p_yes: double, n_variants: int>, likert5: struct<mean_score: double, score: double>>>"
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "eval.json").schema(f"experiment string, results struct<policies: array<{shape}>>").json(folder, multiLine=True)
    each = df.select("experiment", F.explode("results.policies").alias("p"))
    year = F.coalesce(F.nullif(F.regexp_extract("experiment", r"_(\d{4})_", 1), F.lit("")), F.nullif(F.regexp_extract("experiment", r"(\d{4})", 1), F.lit("")))
    return each.select("experiment", year.cast("int").alias("year_model"), F.col("p.id").alias("policy_id"), F.col("p.implementation_year").alias("enactment_year"), F.coalesce("p.scores.yes_no.mean_p_yes", "p.scores.yes_no.p_yes").alias("p_yes"), F.coalesce("p.scores.likert5.mean_score", "p.scores.likert5.score").alias("likert"), F.col("p.scores.yes_no.n_variants").alias("n_variants"))


def archived_lines(spark: SparkSession, path: str) -> DataFrame:
    """year and text of the JSON files in tar archives; the year is the first part of a member's path. An archive is read in one task."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with tarfile.open(fileobj=io.BytesIO(content)) as archive:
                    for member in archive:
                        if member.isfile() and member.name.endswith(".json"):
                            text = archive.extractfile(member).read().decode("utf-8", "replace")
                            yield pd.DataFrame({"path": [member.name.removeprefix("./")], "text": [text]})

    members = spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "path string, text string")
    return members.select(F.substring_index("path", "/", 1).try_cast("int").alias("year"), "path", "text")
