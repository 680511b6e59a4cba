"""Semi-structured replies into clean records and dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yearloom.functions.text import without_fences


def document_list(reply: Column) -> Column:
    """Texts of a JSON reply: a bare list, or a list under documents, docs or items; elements are strings or {"text"}.

    Null for a reply that is no such JSON; blank elements are dropped.
    """
    body = without_fences(reply)
    lists = [F.from_json(body, "array<string>", {"mode": "PERMISSIVE"})]
    for key in ("documents", "docs", "items"):
        lists.append(F.from_json(F.get_json_object(body, f"$.{key}"), "array<string>", {"mode": "PERMISSIVE"}))
    texts = F.transform(F.coalesce(*lists[1:], lists[0]), lambda e: F.coalesce(F.get_json_object(e, "$.text"), e))
    return F.filter(texts, lambda t: t.isNotNull() & (F.trim(t) != ""))


def reply_status(reply: Column, banned: Column | None = None) -> Column:
    """ok, parse_failed, banned_term or error (no reply) for each reply."""
    status = F.when(reply.isNull() | (F.trim(reply) == ""), "error").when(F.coalesce(F.size(document_list(reply)), F.lit(0)) <= 0, "parse_failed")
    return (status if banned is None else status.when(banned, "banned_term")).otherwise("ok")


def exploded_documents(replies: DataFrame, reply: str, keys: list[str]) -> DataFrame:
    """One row for each document of each reply that parses: keys, doc_idx, text."""
    return replies.select(*keys, F.posexplode(document_list(F.col(reply))).alias("doc_idx", "text"))


def request_key(custom_id: Column) -> Column:
    """year and seed of 'year=1942;seed=487'; null where missing or malformed."""
    pairs = F.str_to_map(custom_id, F.lit(";"), F.lit("="))
    return F.struct(pairs["year"].try_cast("int").alias("year"), pairs["seed"].try_cast("int").alias("seed"))


def text_record_status(question: Column, verdict: Column, allowed: list[str]) -> Column:
    """Whether a generated question ends in a question mark and its verdict is one of the allowed."""
    return F.when(question.isNull() | ~F.rtrim(question).endswith("?"), "bad_question").when(verdict.isNull() | ~verdict.isin(allowed), "bad_label").otherwise("ok")


def _listed(reply: Column, element: str, keys: tuple[str, ...]) -> Column:
    """The array of a JSON reply, bare or under the first of the keys that holds one."""
    body = without_fences(reply)
    parts = [F.from_json(F.get_json_object(body, f"$.{key}"), f"array<{element}>") for key in keys]
    return F.coalesce(*parts, F.from_json(body, f"array<{element}>"))


def ideas(reply: Column) -> Column:
    """Ideas (doc_type, concept, tone) of a reply; those without a doc_type or concept go, a missing tone is empty."""
    found = _listed(reply, "struct<doc_type: string, concept: string, tone: string>", ("ideas",))
    kept = F.filter(found, lambda i: (F.coalesce(F.trim(i["doc_type"]), F.lit("")) != "") & (F.coalesce(F.trim(i["concept"]), F.lit("")) != ""))
    return F.transform(kept, lambda i: F.struct(i["doc_type"].alias("doc_type"), i["concept"].alias("concept"), F.coalesce(i["tone"], F.lit("")).alias("tone")))


def single_document(reply: Column) -> Column:
    """The text of a reply with one document: under document, text or content, or a JSON string; null if there is none."""
    body = F.trim(without_fences(reply))
    named = [F.nullif(F.get_json_object(body, f"$.{key}"), F.lit("")) for key in ("document", "text", "content")]
    quoted = F.when(body.startswith('"'), F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<string>")[0])
    return F.coalesce(*named, quoted)


def problems(reply: Column) -> Column:
    """Problems (question, answer) of a reply whose answer holds the mark of its number."""
    found = _listed(reply, "struct<question: string, answer: string>", ("problems", "questions", "data"))
    return F.filter(found, lambda p: p["question"].isNotNull() & p["answer"].contains("####"))


def variants(reply: Column) -> Column:
    """Wordings of a question, trimmed, without blanks."""
    return F.filter(F.transform(_listed(reply, "string", ("variants",)), lambda v: F.trim(v)), lambda v: v != "")


def written_record_status(question: Column, verdict: Column, scale: Column, reasoning: Column, verdicts: list[str], scales: list[str]) -> Column:
    """ok, or what is wrong first: the question, the verdict, the scale or the reasoning."""
    bad = F.when(F.coalesce(~F.rtrim(question).endswith("?"), F.lit(True)), "bad_question")
    bad = bad.when(~F.coalesce(verdict.isin(verdicts), F.lit(False)), "bad_verdict").when(~F.coalesce(scale.isin(scales), F.lit(False)), "bad_scale")
    return bad.when(F.coalesce(F.trim(reasoning), F.lit("")) == "", "no_reasoning").otherwise("ok")
