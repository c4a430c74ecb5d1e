"""All registered queries."""

from __future__ import annotations

from broadsheet.plans import language, learn, pages, rows, runs, stats, streams, words  # noqa: F401
from broadsheet.plans.base import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
