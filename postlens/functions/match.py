"""Substring term matching on folded text.

The text is folded once per row and bound to a lambda variable; terms are folded on the driver or in their
own column. Matching is by substring on purpose: ``ai`` is found in ``said``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlens.functions.lists import bind, or_empty
from postlens.functions.text import fold


def _safe(text: Column) -> Column:
    return fold(F.coalesce(text, F.lit("")))


def contains_any(text: Column, terms: Column) -> Column:
    """True if a term of the list column occurs; an empty list never matches."""
    folded = F.transform(or_empty(terms), fold)
    return bind(
        F.struct(_safe(text).alias("text"), folded.alias("terms")),
        lambda b: F.exists(b["terms"], lambda t: b["text"].contains(t)),
    )


def contains_all(text: Column, terms: Column) -> Column:
    folded = F.transform(or_empty(terms), fold)
    return bind(
        F.struct(_safe(text).alias("text"), folded.alias("terms")),
        lambda b: F.forall(b["terms"], lambda t: b["text"].contains(t)),
    )


def python_fold(term: str) -> str:
    """The driver-side twin of :func:`postlens.functions.text.fold` for literal terms."""
    return term.lower().replace("ß", "ss").replace("ς", "σ").replace("ſ", "s")


def contains_any_of(text: Column, terms) -> Column:
    """Like :func:`contains_any` for terms known when the query is written."""
    wanted = [python_fold(t) for t in terms if t]
    if not wanted:
        return F.lit(False)
    return bind(_safe(text), lambda s: reduce(lambda a, b: a | b, [s.contains(t) for t in wanted]))


def contains_all_of(text: Column, terms) -> Column:
    wanted = [python_fold(t) for t in terms if t]
    if not wanted:
        return F.lit(True)
    return bind(_safe(text), lambda s: reduce(lambda a, b: a & b, [s.contains(t) for t in wanted]))


def include_filter(text: Column, terms, mode: str = "any") -> Column:
    """Keyword filter; an empty list of terms lets every row pass."""
    if not [t for t in terms if t]:
        return F.lit(True)
    return contains_all_of(text, terms) if mode == "all" else contains_any_of(text, terms)


def exclude_filter(text: Column, terms) -> Column:
    return ~contains_any_of(text, terms)


def evidence_filter(text: Column, terms: Column) -> Column:
    """Evidence match; unlike a filter, no terms means no evidence."""
    return (F.size(or_empty(terms)) > 0) & contains_any(text, terms)


def matched_terms(text: Column, terms) -> Column:
    """The literal terms that occur in the text."""
    listed = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    return bind(_safe(text), lambda s: F.filter(listed, lambda t: s.contains(t)))
