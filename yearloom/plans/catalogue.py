"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from yearloom.plans import assembly, chat, corpus, evaluation, evaluators, panel, records, replies, streams  # noqa: F401
from yearloom.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
