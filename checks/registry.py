"""The registry: name → query function and, where there is one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks import inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_VIEWS = {"posts": inputs.POSTS, "raw": inputs.RAW, "prompts": inputs.PROMPTS, "profiles": inputs.PROFILES}
_NEEDS = {"raw": ["posts"]}


def with_views(sql: str, *views: str) -> str:
    """The SQL with the derived views it reads as common table expressions in front."""
    names: list[str] = []
    for view in views:
        names += [n for n in _NEEDS.get(view, []) + [view] if n not in names]
    ctes = ", ".join(f"{n} as ({inputs.duck(_VIEWS[n]).strip()})" for n in names)
    return f"with {ctes} {sql}" if not sql.lstrip().startswith(",") else f"with {ctes}{sql}"


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ("posts",)):
    """Register ``build(inputs) -> DataFrame``."""

    def register(build: Callable[[inputs.Inputs], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(inputs.Inputs(spark, folder))
        if sql is not None:
            SQL[name] = with_views(sql, *views) if views else sql
        return build

    return register
