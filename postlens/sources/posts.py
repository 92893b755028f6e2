"""Raw API items to posts, and the time window."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions import text as t


def to_posts(raw: DataFrame, source: str | Column, site: str | None = None) -> DataFrame:
    """Rename, default and clean raw items. The community comes from ``subreddit``, else from ``asked``."""
    source = F.lit(source) if isinstance(source, str) else source
    name = F.col("subreddit")
    if "asked" in raw.columns:
        name = F.coalesce(F.nullif(name, F.lit("")), F.replace(F.col("asked"), F.lit("r/"), F.lit("")))
    name = F.coalesce(name, F.lit(""))
    link = {"site": site} if site else {}
    extra = [c for c in ("plan_id", "pass_no", "community_pos") if c in raw.columns]
    return raw.select(
        *extra,
        "id",
        F.concat(F.lit("r/"), name).alias("community"),
        F.col("created_utc").cast("long").alias("created_utc"),
        t.clean_text(F.col("title")).alias("title"),
        t.clean_text(F.col("selftext")).alias("selftext"),
        t.permalink(F.col("full_link"), name, F.col("id"), **link).alias("url"),
        F.coalesce(F.col("score"), F.lit(0)).cast("int").alias("upvotes"),
        F.coalesce(F.col("num_comments"), F.lit(0)).cast("int").alias("num_comments"),
        source.alias("source"),
        F.current_timestamp().alias("fetched_at"),
    )


def in_window(df: DataFrame, after=None, before=None) -> DataFrame:
    """Strict time range on the plain column, so that the scan can use it.

    A table with a folder per month is also limited to the months of the range, given as numbers.
    """
    months = "created_month" in df.columns
    if after is not None:
        df = df.where(F.col("created_utc") > after)
        if months and not isinstance(after, Column):
            df = df.where(F.col("created_month") >= month_of(after))
    if before is not None:
        df = df.where(F.col("created_utc") < before)
        if months and not isinstance(before, Column):
            df = df.where(F.col("created_month") <= month_of(before))
    return df


def month_of(moment: float) -> str:
    """The month folder of a moment, as the raw table's writer names it."""
    return datetime.fromtimestamp(moment, UTC).strftime("%Y-%m")


def min_score(df: DataFrame, minimum: int) -> DataFrame:
    return df.where(F.col("upvotes") >= max(0, minimum))


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("created_utc"), "id")
