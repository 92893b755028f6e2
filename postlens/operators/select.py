"""Post selection: community pass, keyword pass, union, first-wins de-duplication, filters.

All passes rank narrow rows: id, time, score and where the item is. Titles and texts are fetched once, for the rows that are
left. Searches of a table of plans store the items of any other plan first; searches with fixed arguments carry their texts
along. See ``sources.locate``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from postlens.config import MAX_INLINE_ROWS, written
from postlens.functions import match
from postlens.functions.lists import cap, dedupe, json_list, or_empty
from postlens.functions.text import clean_text, match_text, window_start
from postlens.operators.termjoin import Matches
from postlens.operators.terms import prompt_terms, selection_terms
from postlens.operators.topn import first_per_key, top_n, top_slices
from postlens.sources.locate import Late, fetched, placed
from postlens.sources.posts import in_window, to_posts
from postlens.sources.writers import SLICE

COMMUNITY_SOURCE = "community_search"
KEYWORD_SOURCE = "keyword_search"
#: Terms a keyword filter uses at most.
FILTER_TERMS = 24
#: What a plan asks for where it does not say.
DEFAULT_MONTHS, DEFAULT_MIN_UPVOTES, DEFAULT_LIMIT = 12, 20, 2000


def newest() -> list[Column]:
    return [F.desc("created_utc"), F.asc("id")]


# --- one search with fixed arguments -----------------------------------------------------------------

def _enough(minimum: Column | int) -> Column:
    return F.coalesce(F.col("score"), F.lit(0)) >= minimum


_RANKED = ["id", "created_utc", "score", "subreddit"]
_WIDE = ["title", "selftext", "full_link", "num_comments"]


def search_communities(raw: DataFrame, communities: list[str], since: int, limit: int, min_upvotes: int,
                       limit_after_filter: bool = False) -> DataFrame:
    """The newest ``limit`` items of each community since a moment, then those with enough score."""
    names = [c.replace("r/", "") for c in communities]
    items = Late(raw, _WIDE)
    found = in_window(items.rows, after=since).where(F.col("subreddit").isin(*names))
    enough = _enough(max(0, min_upvotes))
    if limit_after_filter:
        found = found.where(enough)
    narrow = found.select(*items.carried, *_RANKED)
    ranked = top_n(narrow, ["subreddit"], newest(), limit, salt_on="id").where(enough).drop("rank")
    return to_posts(items.fetch(ranked), COMMUNITY_SOURCE)


def search_keywords(raw: DataFrame, terms: list[str], since: int, limit: int, min_upvotes: int,
                    limit_after_filter: bool = False) -> DataFrame:
    """The newest ``limit`` items that contain any term, then those with enough score."""
    text = match_text(F.col("title"), F.col("selftext"))
    items = Late(raw, _WIDE)
    found = in_window(items.rows, after=since).where(match.contains_any_of(text, terms))
    enough = _enough(max(0, min_upvotes))
    if limit_after_filter:
        found = found.where(enough)
    narrow = found.select(*items.carried, *_RANKED)
    ranked = top_slices(narrow, newest(), limit, salt_on="id" if items.stored else None).where(enough)
    return to_posts(items.fetch(ranked), KEYWORD_SOURCE)


# --- all plans at once -------------------------------------------------------------------------------

@dataclass
class Searches:
    """Clean search arguments of a plan table, with the widest window and limit over all plans.

    The two bounds come from one small aggregation over the plans; as literals they reach the scan of the
    posts and the rank limits.
    """

    plans: DataFrame
    since: int
    limit: int

    @staticmethod
    def of(plans: DataFrame, as_of: int) -> "Searches":
        clean = plans.select(
            "plan_id",
            or_empty(F.col("communities")).alias("communities"),
            dedupe(F.col("filters.keywords")).alias("keywords"),
            dedupe(F.col("filters.exclude")).alias("exclude"),
            window_start(F.lit(as_of), F.coalesce(F.col("params.months"), F.lit(DEFAULT_MONTHS))).alias("since"),
            F.greatest(F.lit(0), F.coalesce(F.col("params.min_upvotes"), F.lit(DEFAULT_MIN_UPVOTES))).alias("min_upvotes"),
            F.coalesce(F.col("params.limit"), F.lit(DEFAULT_LIMIT)).alias("limit"),
        )
        widest = clean.agg(F.min("since").alias("since"), F.max("limit").alias("limit")).first()
        return Searches(clean, widest.since or as_of, widest.limit or 0)


def _within_limit(found: DataFrame, groups: list[str], limit: int) -> DataFrame:
    """The newest rows of each search up to its plan's limit, then those with enough score."""
    ranked = top_n(found.where(F.col("created_utc") > F.col("since")), groups, newest(), limit, salt_on="id")
    return ranked.where((F.col("rank") <= F.col("limit")) & _enough(F.col("min_upvotes")))


def _items(raw: DataFrame) -> Late:
    """Items whose texts are fetched late, as a row may be found by any number of plans: what is no stored table is stored."""
    items = Late(raw, _WIDE)
    return items if items.stored else Late(placed(raw, _WIDE), _WIDE)


#: What both passes hand on besides what an item carries: which search found a row.
_HIT = ["plan_id", "pass_no", "community_pos", *_RANKED]


def community_hits(items: Late, searches: Searches, slices: int = 0, max_broadcast: int = MAX_INLINE_ROWS) -> DataFrame:
    """Narrow rows of each plan's communities.

    Rows are ranked once per community, however many plans ask for it: of the rows since a moment, the newest are the newest
    of all. Only ranked rows meet the plans. Up to ``max_broadcast`` names of communities (counted) are sent to every task.
    More are joined; of a table that ``write_bucketed_table`` made with so many ``slices``, bucket by bucket.
    """
    asked = searches.plans.select(
        "plan_id", "since", "min_upvotes", "limit", F.posexplode("communities").alias("community_pos", "asked")
    ).withColumn("subreddit", F.replace("asked", F.lit("r/"), F.lit(""))).drop("asked")
    names, keys = asked.select("subreddit").distinct(), ["subreddit"]
    if names.limit(max_broadcast + 1).count() <= max_broadcast:
        names = F.broadcast(names)
    elif slices:
        names = names.withColumn(SLICE, F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        keys.append(SLICE)
    found = in_window(items.rows, after=searches.since).select(*items.carried, *_RANKED, *keys[1:]).join(names, keys, "left_semi")
    ranked = top_n(found.drop(*keys[1:]), ["subreddit"], newest(), searches.limit, salt_on="id")
    kept = ranked.join(asked, "subreddit").where(
        (F.col("created_utc") > F.col("since")) & (F.col("rank") <= F.col("limit")) & _enough(F.col("min_upvotes"))
    )
    return kept.withColumn("pass_no", F.lit(1)).select(*_HIT, *items.carried)


def keyword_hits(items: Late, searches: Searches, synonyms: DataFrame) -> DataFrame:
    """Narrow rows that contain a search term of the plan; a plan without keywords searches for nothing."""
    listed = selection_terms(searches.plans.select("plan_id", "keywords"), synonyms)
    terms = listed.select("plan_id", F.explode(F.array_distinct("terms")).alias("term"))
    texts = in_window(items.rows, after=searches.since).select(
        *items.carried, *_RANKED, match_text(F.col("title"), F.col("selftext")).alias("text")
    )
    # The newest rows of the widest window: a plan's own window and limit hold the first of them. They are ranked again with
    # the plans, as a plan id that comes twice shares its limit.
    found = Matches(texts, terms, "plan_id", [*items.carried, *_RANKED]).first(newest(), searches.limit, salt_on="id")
    found = found.drop("rank").join(searches.plans.select("plan_id", "since", "min_upvotes", "limit"), "plan_id")
    kept = _within_limit(found, ["plan_id"], searches.limit)
    return kept.withColumns({"pass_no": F.lit(2), "community_pos": F.lit(0)}).select(*_HIT, *items.carried)


def both_hits(items: Late, searches: Searches, synonyms: DataFrame, slices: int = 0) -> DataFrame:
    return community_hits(items, searches, slices).unionByName(keyword_hits(items, searches, synonyms))


def _posts(items: Late, hits: DataFrame) -> DataFrame:
    source = F.when(F.col("pass_no") == 1, COMMUNITY_SOURCE).otherwise(KEYWORD_SOURCE)
    return to_posts(items.fetch(hits), source)


def community_pass(raw: DataFrame, searches: Searches, slices: int = 0, max_broadcast: int = MAX_INLINE_ROWS) -> DataFrame:
    """Posts of each plan's communities; see ``community_hits``."""
    items = _items(raw)
    return _posts(items, community_hits(items, searches, slices, max_broadcast))


def keyword_pass(raw: DataFrame, searches: Searches, synonyms: DataFrame) -> DataFrame:
    """Posts that contain a search term of the plan."""
    items = _items(raw)
    return _posts(items, keyword_hits(items, searches, synonyms))


def both_passes(raw: DataFrame, searches: Searches, synonyms: DataFrame) -> DataFrame:
    items = _items(raw)
    return _posts(items, both_hits(items, searches, synonyms))


def first_wins(hits: DataFrame, keys: list[str], last: Sequence[str] = ("selftext",)) -> DataFrame:
    """One row per id: community pass first, then the order of the communities, then the newest, then by ``last``."""
    return first_per_key(hits, keys, [F.col("pass_no"), F.col("community_pos"), -F.col("created_utc"), *map(F.col, last)])


def judged(items: Late, unique: DataFrame, searches: Searches) -> DataFrame:
    """Narrow de-duplicated rows of all plans with the verdict of each filter (``excluded``, ``included``).

    A text is read once for each different pair of filters that plans judge it by, not for each plan.
    """
    asked = written(searches.plans.select("plan_id", *_FILTERS), "filters")
    filters = written(asked.select(*_FILTERS).distinct().withColumn("_filter", F.monotonically_increasing_id()), "filters")
    owned = asked.join(filters, _FILTERS).select("plan_id", "_filter")
    rows = written(unique.join(owned, "plan_id"), "unique")
    at = {f"_at{c}": F.col(c) for c in items.carried}
    pairs = fetched(items.rows, rows.select(*items.carried, "_filter").distinct().withColumns(at), ["title", "selftext"])
    text = match_text(clean_text(F.col("title")), clean_text(F.col("selftext")))
    verdicts = pairs.withColumn("text", text).select("_filter", *at, "text").join(filters, "_filter").select(
        "_filter", *(F.col(a).alias(c) for a, c in zip(at, items.carried)),
        match.contains_any(F.col("text"), F.col("exclude")).alias("excluded"),
        ((F.size("keywords") == 0) | match.contains_any(F.col("text"), F.col("keywords"))).alias("included"),
    )
    return rows.join(verdicts, [*items.carried, "_filter"]).drop("_filter")


_FILTERS = ["keywords", "exclude"]


def unique_hits(items: Late, hits: DataFrame) -> DataFrame:
    """The first hit of each plan and id."""
    return first_wins(hits, ["plan_id", "id"], items.carried)


def select_posts(raw: DataFrame, plans: DataFrame, synonyms: DataFrame, as_of: int,
                 counters: tuple[Observation, Observation] | None = None, slices: int = 0) -> DataFrame:
    """Posts of each plan: searched, de-duplicated, without excluded terms, with included ones.

    ``slices`` are those of a table by ``write_bucketed_table``, and 0 for any other.

    Two ``counters`` tell, after the query has run and without another pass, how many rows all plans have together: the
    first ``community_rows`` and ``keyword_rows``, the second ``unique_rows``, ``excluded_rows`` and ``kept_rows``. Both are
    filled when this function returns. Plans meet narrow rows only; texts are fetched for the rows that are kept.
    """
    searches = Searches.of(plans, as_of)
    items = _items(raw)
    hits = both_hits(items, searches, synonyms, slices)
    if counters:
        hits = hits.observe(counters[0], *(F.count_if(F.col("pass_no") == n).alias(c) for n, c in _PASSES.items()))
    stages = judged(items, unique_hits(items, hits), searches)
    if counters:
        stages = stages.observe(counters[1], *(total.alias(name) for name, total in _judged_counts().items()))
    kept = stages.where(~F.col("excluded") & F.col("included"))
    return _posts(items, kept.drop("excluded", "included")).drop("pass_no", "community_pos")


_PASSES = {1: "community_rows", 2: "keyword_rows"}


def _judged_counts() -> dict[str, Column]:
    return {
        "unique_rows": F.count("*"), "excluded_rows": F.count_if("excluded"),
        "kept_rows": F.count_if(~F.col("excluded") & F.col("included")),
    }


def keyword_filter(posts: DataFrame, keywords: list[str], exclude: list[str] = (), mode: str = "any") -> DataFrame:
    """Filter stored posts by literal terms; excludes always apply, no keywords lets all pass."""
    text = match_text(F.col("title"), F.col("selftext"))
    return posts.where(match.exclude_filter(text, exclude)).where(match.include_filter(text, keywords, mode))


def keyword_filter_step(posts: DataFrame, keywords: str, synonyms: DataFrame, keywords_json: str = "[]",
                        exclude_json: str = "[]", mode: str = "any") -> DataFrame:
    """The filter as a user asks for it: keywords as text and as a JSON list, expanded, at most 24 of them.

    Without keywords all posts pass, excluded ones too; JSON that is no list counts as an empty one.
    """
    spark = posts.sparkSession
    asked = spark.range(1).select(
        F.lit(0).cast("long").alias("plan_id"), F.lit("").alias("prompt"),
        F.array_join(F.concat(F.array(F.lit(keywords)), json_list(F.lit(keywords_json))), " ").alias("keywords"),
        json_list(F.lit(exclude_json)).alias("exclude"),
    )
    row = prompt_terms(asked, synonyms).join(asked.select("plan_id", "exclude"), "plan_id").select(
        cap(F.col("english"), FILTER_TERMS).alias("terms"), "exclude"
    ).first()
    return keyword_filter(posts, row["terms"], row["exclude"], mode) if row["terms"] else posts


def funnel(hits: DataFrame, stages: DataFrame) -> DataFrame:
    """Rows per plan at each step, in two single-pass aggregations; hits may be narrow or whole posts."""
    collected = hits.groupBy("plan_id").agg(*(F.count_if(F.col("pass_no") == n).alias(c) for n, c in _PASSES.items()))
    kept = stages.groupBy("plan_id").agg(*(total.alias(name) for name, total in _judged_counts().items()))
    return collected.join(kept, "plan_id")


def selection_funnel(raw: DataFrame, plans: DataFrame, synonyms: DataFrame, as_of: int) -> DataFrame:
    """Rows per plan at each step of ``select_posts``. The searches run once: their narrow hits are stored."""
    searches = Searches.of(plans, as_of)
    items = _items(raw)
    hits = written(both_hits(items, searches, synonyms), "hits")
    return funnel(hits, judged(items, unique_hits(items, hits), searches))
