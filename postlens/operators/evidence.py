"""The evidence behind each plan: matched posts, counts, samples and the filled context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens import fixed_values as fixed
from postlens.functions.lists import dedupe, join_or, or_empty
from postlens.functions.text import two_places
from postlens.operators.termjoin import Matches
from postlens.operators.terms import filter_lists, focus_terms
from postlens.sources.readers import with_text

SAMPLES = 8
_SAMPLE = ["id", "title", "url", "pain_score"]


def coverage_note(matched: Column, total: Column) -> Column:
    return (
        F.when(total == 0, fixed.COVERAGE_EMPTY)
        .when(matched == 0, fixed.COVERAGE_NONE)
        .when(matched < 5, fixed.COVERAGE_THIN)
        .otherwise(fixed.COVERAGE_GOOD)
    )


def theme_notes(themes: Column) -> Column:
    """Up to five themes in one line, with up to three pains and two outcomes each."""

    def note(theme: Column) -> Column:
        return F.format_string(
            "%s (audience: %s; pains: %s; outcomes: %s)",
            F.coalesce(F.nullif(theme["name"], F.lit("")), F.lit("theme")),
            F.coalesce(F.nullif(theme["audience"], F.lit("")), F.lit("-")),
            join_or(F.slice(or_empty(theme["pain_points"]), 1, 3), ", ", "-"),
            join_or(F.slice(or_empty(theme["desired_outcomes"]), 1, 2), ", ", "-"),
        )

    has_any = F.coalesce(F.size(themes) > 0, F.lit(False))
    return F.when(has_any, F.array_join(F.transform(F.slice(themes, 1, 5), note), " | ")).otherwise("(none)")


def warning_notes(own: Column, seeded: Column) -> Column:
    """The plan's warnings, else those of its seed."""
    chosen = F.when(F.size(or_empty(own)) > 0, own).otherwise(or_empty(seeded))
    return F.when(F.size(chosen) > 0, F.array_join(dedupe(chosen), "; ")).otherwise("(none)")


def sample_line(title: Column, url: Column, pain: Column) -> Column:
    name = F.coalesce(title, F.lit(""))
    linked = F.when(F.coalesce(url, F.lit("")) != "", F.format_string("- [%s](%s)", name, url)).otherwise(
        F.concat(F.lit("- "), name)
    )
    return F.concat(linked, F.when(pain.isNotNull(), F.concat(F.lit(" (pain "), two_places(pain), F.lit(")"))).otherwise(""))


def matches(posts: DataFrame, focus: DataFrame) -> Matches:
    """Each post that contains a focus term of a plan, as sample columns by ``plan_id``; no terms, no rows."""
    terms = focus.select("plan_id", F.explode(F.array_distinct("focus_terms")).alias("term"))
    return Matches(with_text(posts), terms, "plan_id", _SAMPLE)


def counted(matched: Matches, posts: DataFrame, plans: DataFrame) -> DataFrame:
    """``(plan_id, matched, total)``. The total is one row, joined as such."""
    hits = matched.counts("matched")
    total = posts.agg(F.count("*").alias("total"))
    return (
        plans.select("plan_id")
        .join(hits, "plan_id", "left")
        .select("plan_id", F.coalesce("matched", F.lit(0)).alias("matched"), total.scalar().alias("total"))
    )


def samples(matched: Matches, posts: DataFrame, plans: DataFrame, n: int = SAMPLES) -> DataFrame:
    """``(plan_id, lines)``: the most painful matched posts, or of all posts for a plan without a match.

    The posts offered to such plans are the same n rows for all of them, so they are ranked once.
    """
    order = [F.desc("pain_score"), F.asc("id")]
    own = matched.first(order, n)
    line = sample_line(F.col("title"), F.col("url"), F.col("pain_score"))

    def listed(df: DataFrame, *groups: str) -> DataFrame:
        entries = F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))
        return df.groupBy(*groups).agg(F.transform(entries, lambda e: e["line"]).alias("lines"))

    best = posts.select(*_SAMPLE).orderBy(*order).limit(n)
    ranked = best.agg(
        F.sort_array(F.collect_list(F.struct((-F.col("pain_score")).alias("at"), "id", line.alias("line")))).alias("all")
    )
    anywhere = ranked.select(F.transform("all", lambda e: e["line"]).alias("lines"))
    return (
        plans.select("plan_id")
        .join(listed(own, "plan_id"), "plan_id", "left")
        .select("plan_id", F.coalesce(F.col("lines"), anywhere.scalar()).alias("lines"))
    )


def mean_sentiment(posts: DataFrame) -> DataFrame:
    return posts.agg(F.coalesce(F.avg("sentiment"), F.lit(0.0)).alias("avg_sentiment"))


def sentiment_section(plans: DataFrame, posts: DataFrame) -> DataFrame:
    """Mean sentiment, only for plans whose report type asks for it."""
    wanted = F.col("report_type") == "sentiment"
    return plans.select("plan_id", F.when(wanted, mean_sentiment(posts).scalar()).alias("avg_sentiment"))


def report_header(plans: DataFrame) -> DataFrame:
    """Communities, parameters, keywords and type of each plan's report."""

    def param(name: str) -> Column:
        return F.coalesce(F.col(f"params.{name}").cast("string"), F.lit("-"))

    return plans.select(
        "plan_id",
        F.array_join(or_empty(F.col("communities")), ", ").alias("communities"),
        F.format_string(
            "months=%s, min_upvotes=%s, limit=%s", param("months"), param("min_upvotes"), param("limit")
        ).alias("params"),
        F.coalesce(F.nullif(F.array_join(or_empty(F.col("filters.keywords")), " "), F.lit("")), F.lit("—")).alias(
            "keywords"
        ),
        F.coalesce("report_type", F.lit("auto")).alias("report_type"),
    )


def context(plans: DataFrame) -> Column:
    """The filled evidence template over plan columns plus focus terms, counts and sample lines."""

    def param(name: str) -> Column:
        return F.coalesce(F.col(f"params.{name}").cast("string"), F.lit("-"))

    must, should, exclude, languages = filter_lists(F.col("filters"))
    seeded = F.array().cast("array<string>")
    sample_lines = F.when(F.size(or_empty(F.col("lines"))) > 0, F.array_join("lines", "\n")).otherwise(fixed.NO_SAMPLES)
    return F.format_string(
        fixed.EVIDENCE_TEMPLATE,
        F.coalesce("prompt", F.lit("<unknown prompt>")),
        F.coalesce("report_type", F.lit("auto")),
        F.array_join(or_empty(F.col("communities")), ", "),
        param("months"), param("min_upvotes"), param("limit"),
        join_or(must, ", ", "(none)"), join_or(should, ", ", "(none)"),
        join_or(exclude, ", ", "(none)"), join_or(languages, ", ", "(none)"),
        join_or(F.col("focus_terms"), ", ", "(none)"),
        theme_notes(F.col("topic_themes")),
        warning_notes(F.col("warnings"), seeded),
        F.col("matched"), F.col("total"),
        coverage_note(F.col("matched"), F.col("total")),
        sample_lines,
    )


def evidence(posts: DataFrame, plans: DataFrame, synonyms: DataFrame, split_phrases: bool = False) -> DataFrame:
    """One row per plan: counts, coverage note, sample lines and the context text."""
    focus = focus_terms(plans, synonyms, split_phrases)
    matched = matches(posts, focus)
    whole = (
        plans.join(focus, "plan_id", "left")
        .join(counted(matched, posts, plans), "plan_id", "left")
        .join(samples(matched, posts, plans), "plan_id", "left")
    )
    return whole.select(
        "plan_id", "matched", "total", coverage_note(F.col("matched"), F.col("total")).alias("coverage_note"),
        "lines", context(plans).alias("context"),
    )


def planning_context(prompts: DataFrame, max_communities: int = 8, months: int = 12, min_upvotes: int = 20,
                     limit: int = 1000) -> DataFrame:
    """``(plan_id, context)``: what a planner is asked, from ``prompt, report_type, seed_communities``."""
    return prompts.select(
        "plan_id",
        F.format_string(
            fixed.PLANNING_TEMPLATE, F.col("prompt"), F.coalesce("report_type", F.lit("auto")),
            F.lit(max_communities), F.lit(months), F.lit(min_upvotes), F.lit(limit),
            join_or(F.col("seed_communities"), ", ", "(none)"),
        ).alias("context"),
    )
