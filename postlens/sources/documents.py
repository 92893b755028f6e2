"""Seeds and plans as the JSON documents that planners exchange, to rows of the library's schemas.

Fields that come in several layouts (a name, or an object with or without ``meta``) are read as JSON text and
brought into one form in the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.functions.lists import bind, first_of_each, or_empty
from postlens.functions.text import seed_community_tag

_DETAILS = "confidence: double, why: string, flags: array<string>"
_ENTRY = f"struct<name: string, subreddit: string, {_DETAILS}, meta: struct<{_DETAILS}>>"
_PHRASE = "struct<phrase: string, keyword: string>"
_FILTERS = (
    "struct<keywords: array<string>, must_include: array<string>, should_include: array<string>, exclude: array<string>, "
    "languages: array<string>>"
)
_THEMES = "array<struct<name: string, audience: string, pain_points: array<string>, desired_outcomes: array<string>>>"
_COMMON = f"""plan_id: bigint, prompt: string, original_prompt: string, subreddits: array<string>, keywords: array<string>,
  filters: {_FILTERS}, warnings: array<string>, validation_hints: array<string>, topic_themes: {_THEMES}"""
_SEED = f"struct<{_COMMON}, confidence: string, timeframe_months: int, min_upvotes: int>"
_PLAN = f"""struct<{_COMMON}, communities: array<string>, params: struct<months: int, min_upvotes: int, limit: int>,
  report_type: string, rationale: string,
  keyword_plan: struct<core: array<string>, long_tail: array<string>, exploratory: array<string>>,
  seed_metadata: struct<subreddits: array<string>>, seed_context: struct<subreddits: array<string>>>"""
#: What an entry that is only a name says about itself.
PLAIN_WHY, PLAIN_CONFIDENCE = "seed suggestion", 0.0


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``document``: the text of each file of a folder."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("document"))


def _is_object(text: Column) -> Column:
    return F.ltrim(text).startswith("{")


def seed_entries(entries: Column) -> Column:
    """Entries ``name, confidence, why, flags`` from JSON texts or names; tagged, first of each name."""

    def entry(text: Column) -> Column:
        def of(e: Column) -> Column:
            name = F.coalesce(F.nullif(F.trim(e["name"]), F.lit("")), F.trim(e["subreddit"]))
            meta = e["meta"]
            return F.struct(
                seed_community_tag(name).alias("name"),
                F.when(meta.isNull(), e["confidence"]).otherwise(meta["confidence"]).alias("confidence"),
                F.when(meta.isNull(), e["why"]).otherwise(meta["why"]).alias("why"),
                or_empty(F.when(meta.isNull(), e["flags"]).otherwise(meta["flags"])).alias("flags"),
            )

        plain = F.struct(
            seed_community_tag(text).alias("name"), F.lit(PLAIN_CONFIDENCE).alias("confidence"), F.lit(PLAIN_WHY).alias("why"),
            F.array().cast("array<string>").alias("flags"),
        )
        return F.when(_is_object(text), bind(F.from_json(text, _ENTRY), of)).otherwise(plain)

    named = F.filter(F.transform(or_empty(entries), entry), lambda e: ~F.lower(e["name"]).isin("", "r/"))
    return first_of_each(named, lambda e: F.lower(e["name"]))


def phrases(items: Column) -> Column:
    """Keyword entries ``phrase, keyword`` from JSON texts or plain phrases."""

    def entry(text: Column) -> Column:
        plain = F.struct(text.alias("phrase"), F.lit(None).cast("string").alias("keyword"))
        return F.when(_is_object(text), F.from_json(text, _PHRASE)).otherwise(plain)

    return F.transform(items, entry)


def seeds(documents: DataFrame, column: str = "document") -> DataFrame:
    """Rows of ``schemas.SEED`` from seed documents; text that is no JSON object gives an empty seed."""
    rows = documents.select(F.from_json(column, _SEED).alias("d"))
    return rows.select(
        "d.plan_id", F.coalesce("d.prompt", "d.original_prompt").alias("prompt"), seed_entries(F.col("d.subreddits")).alias("subreddits"),
        "d.topic_themes", "d.keywords", "d.filters", "d.warnings", "d.validation_hints", "d.confidence", "d.timeframe_months",
        "d.min_upvotes",
    )


def plans(documents: DataFrame, column: str = "document") -> DataFrame:
    """Rows of ``schemas.PLAN`` from plan documents; communities may be called ``subreddits``."""
    rows = documents.select(F.from_json(column, _PLAN).alias("d"))
    kinds = ("core", "long_tail", "exploratory")
    keyword_plan = F.when(
        F.col("d.keyword_plan").isNotNull(), F.struct(*[phrases(F.col(f"d.keyword_plan.{k}")).alias(k) for k in kinds])
    )
    return rows.select(
        "d.plan_id", F.coalesce("d.prompt", "d.original_prompt").alias("prompt"),
        F.transform(seed_entries(F.coalesce("d.communities", "d.subreddits")), lambda e: e["name"]).alias("communities"),
        "d.params", "d.filters", "d.report_type", "d.rationale", "d.keywords", keyword_plan.alias("keyword_plan"), "d.warnings",
        "d.validation_hints", "d.topic_themes",
        seed_entries(F.coalesce("d.seed_metadata.subreddits", "d.seed_context.subreddits")).alias("seed"),
    )
