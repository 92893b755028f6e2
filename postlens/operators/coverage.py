"""Does the post store answer the searches a plan will make?"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions.text import match_text
from postlens.operators.termjoin import Matches
from postlens.sources.posts import in_window


def community_checks(posts: DataFrame, expected: DataFrame, since: int) -> DataFrame:
    """``(plan_id, label, items, ok)`` for each expected community ``(plan_id, community)``."""
    counts = in_window(posts, after=since).groupBy("community").agg(F.count("*").alias("items"))
    return expected.join(counts, "community", "left").select(
        "plan_id",
        F.concat(F.lit("community:"), F.replace("community", F.lit("r/"), F.lit(""))).alias("label"),
        F.coalesce("items", F.lit(0)).alias("items"),
        F.col("items").isNotNull().alias("ok"),
    )


def search_checks(posts: DataFrame, strategies: DataFrame, since: int) -> DataFrame:
    """The same for the searches ``(plan_id, strategy, term)`` of each plan, up to the first that finds items.

    A plan with one strategy has the label without a number. Each search is answered, so each is ok.
    """
    recent = in_window(posts, after=since).withColumn("text", match_text(F.col("title"), F.col("selftext")))
    search = ["plan_id", "strategy"]
    items = Matches(recent, strategies, search, ["id"]).counts("items")
    wanted = strategies.select(*search).distinct()
    plans = wanted.groupBy("plan_id").agg(F.count("*").alias("searches"))
    first = items.groupBy("plan_id").agg(F.min("strategy").alias("first"))
    return (
        wanted.join(items, search, "left").join(plans, "plan_id").join(first, "plan_id", "left")
        .where("first is null or strategy <= first")
        .select(
            "plan_id",
            F.when(F.col("searches") == 1, "search_query")
            .otherwise(F.format_string("search_query_%d", F.col("strategy") + 1)).alias("label"),
            F.coalesce("items", F.lit(0)).alias("items"),
            F.col("items").isNotNull().alias("ok"),
        )
    )


def overall_status(checks: DataFrame) -> DataFrame:
    """``healthy`` if every check of a plan passes, else ``degraded``."""
    return checks.groupBy("plan_id").agg(
        F.count("*").alias("checks"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.when(F.every("ok"), "healthy").otherwise("degraded").alias("status"),
    )
