"""All registered queries."""

from __future__ import annotations

from checks import registry
from checks import post_queries, term_queries, text_queries  # noqa: F401


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.SQL)
