"""Ordered lists as array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXTS = "array<string>"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def empty_texts() -> Column:
    return F.array().cast(TEXTS)


def or_empty(items: Column) -> Column:
    return F.coalesce(items, empty_texts())


def literal_list(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(TEXTS)


def drop_blank(items: Column) -> Column:
    """Trimmed elements without nulls and blanks; a null list is an empty one."""
    trimmed = F.transform(or_empty(items), lambda x: F.trim(x))
    return F.filter(trimmed, lambda x: x.isNotNull() & (x != ""))


def first_of_each(items: Column, key: Callable[[Column], Column]) -> Column:
    """The elements whose ``key`` has not occurred before, in order. Lists without repeats are only hashed."""

    def without_repeats(both: Column) -> Column:
        items, keys = both["items"], both["keys"]
        firsts = F.filter(items, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), items).otherwise(firsts)

    return bind(items, lambda own: bind(
        F.struct(own.alias("items"), F.transform(own, key).alias("keys")), without_repeats
    ))


def dedupe(items: Column) -> Column:
    """Trim, drop blanks, keep the first spelling of each case-insensitively equal element."""
    return first_of_each(drop_blank(items), F.lower)


def merge(*lists: Column) -> Column:
    """De-duplicated concatenation, earlier lists winning."""
    return dedupe(F.concat(*[or_empty(x) for x in lists]))


def cap(items: Column, limit) -> Column:
    return F.slice(items, F.lit(1), limit if isinstance(limit, Column) else F.lit(limit))


def join_or(items: Column, separator: str, otherwise: str) -> Column:
    """Elements joined by a separator, or a placeholder for an empty list."""
    return F.when(F.size(or_empty(items)) > 0, F.array_join(items, separator)).otherwise(otherwise)


def json_list(text: Column) -> Column:
    """A JSON array argument as a clean list; invalid JSON or another type gives an empty list."""
    return drop_blank(F.from_json(text, TEXTS))
