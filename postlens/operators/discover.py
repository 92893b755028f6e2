"""Which communities talk about a prompt, for a table of prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens import fixed_values as fixed
from postlens.functions.lists import cap, first_of_each
from postlens.functions.text import community_tag, fold, match_text, window_start
from postlens.operators.termjoin import Matches
from postlens.operators.terms import prompt_terms, strategy_terms
from postlens.operators.topn import top_n
from postlens.sources.posts import in_window

MOST_COMMON = 64
FALLBACK_CAP = 8


def community_counts(posts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Posts per community; counted on the map side first, so a hot community costs one row per task."""
    return posts.groupBy(*by, "community").agg(F.count("*").alias("n"))


def strategy_counts(posts: DataFrame, strategies: DataFrame, since: int, depth: int) -> DataFrame:
    """``(plan_id, community, n)`` over the newest ``depth`` matches of the first strategy that finds any."""
    search = ["plan_id", "strategy"]
    recent = in_window(posts, after=since).withColumn("text", match_text(F.col("title"), F.col("selftext")))
    found = Matches(recent, strategies, search, ["id", "community", "created_utc"])
    newest = found.first_counts([F.desc("created_utc"), F.asc("id")], depth, "community", salt_on="id")
    # Posts without a community lead nowhere, but take part in the search.
    per_search = newest.where("community <> 'r/'")
    first = per_search.groupBy("plan_id").agg(F.min("strategy").alias("strategy"))
    return per_search.join(first, ["plan_id", "strategy"]).select("plan_id", "community", "n")


def ranked_communities(counts: DataFrame, max_communities: int, blocked=fixed.DISCOVERY_BLOCKLIST) -> DataFrame:
    """The most common communities without blocked ones, as ``(plan_id, pos, community)``; ties by name."""
    common = top_n(counts, ["plan_id"], [F.desc("n"), F.asc("community")], MOST_COMMON)
    tagged = common.withColumn("community", community_tag(F.col("community")))
    allowed = tagged.where(~F.lower("community").isin(*blocked))
    once = allowed.groupBy("plan_id", "community").agg(F.min("rank").alias("at"))
    return top_n(once, ["plan_id"], [F.asc("at")], max_communities, rank="pos").select("plan_id", "pos", "community")


def fallback_communities(lists: DataFrame, mapping: dict[str, list[str]] = fixed.FALLBACK_COMMUNITIES,
                         limit: int = FALLBACK_CAP) -> DataFrame:
    """``(plan_id, communities)``: curated communities whose word stem is part of a search term.

    The fixed table has a few stems, so each term is tested against all of them in the row.
    """
    pieces = F.flatten(F.transform("english", lambda e: F.concat(F.array(fold(e)), F.split(fold(e), " "))))
    pieces = F.array_distinct(F.filter(pieces, lambda p: p != ""))
    empty = F.array().cast("array<string>")

    def offers(piece):
        return F.flatten(
            F.array(
                *[
                    F.when(piece.contains(stem), F.array(*[community_tag(F.lit(n)) for n in names])).otherwise(empty)
                    for stem, names in mapping.items()
                ]
            )
        )

    offered = F.flatten(F.transform(pieces, offers))
    return lists.select("plan_id", cap(first_of_each(offered, F.lower), limit).alias("communities"))


def discover(prompts: DataFrame, posts: DataFrame, synonyms: DataFrame, as_of: int, months: int = 12,
             max_communities: int = 8, pages: int = 8, page_size: int = 100) -> DataFrame:
    """``(plan_id, communities)`` for every prompt: by search, else from the fallback table."""
    lists = prompt_terms(prompts, synonyms)
    strategies = strategy_terms(lists, max_communities * 2 or fixed.SEARCH_TERM_CAP)
    since = as_of - months * fixed.SECONDS_PER_MONTH
    counts = strategy_counts(posts, strategies, since, pages * page_size)
    ranked = ranked_communities(counts, max_communities)
    found = ranked.groupBy("plan_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "community"))), lambda x: x["community"]).alias("found")
    )
    searched = counts.select("plan_id").distinct().withColumn("hit", F.lit(True))
    fallback = fallback_communities(lists, limit=max_communities)
    empty = F.array().cast("array<string>")
    return (
        fallback.join(found, "plan_id", "left")
        .join(searched, "plan_id", "left")
        .select(
            "plan_id",
            F.when(F.col("hit"), F.coalesce("found", empty)).otherwise(F.col("communities")).alias("communities"),
        )
    )
