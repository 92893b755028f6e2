"""Research plans as rows: classification, communities, assembly and vetting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens import fixed_values as fixed
from postlens import schemas
from postlens.functions import text as t
from postlens.functions.lists import cap, dedupe, empty_texts, first_of_each, or_empty

MAX_COMMUNITIES = 8


def report_type(prompt: Column, asked: Column) -> Column:
    """The asked type, or for ``auto`` the first type one of whose words is in the prompt."""
    return F.when(asked == "auto", t.starting_words(prompt, fixed.REPORT_TYPES, fixed.DEFAULT_REPORT_TYPE)).otherwise(
        asked
    )


def community_list(names: Column) -> Column:
    """Clean community names, first spelling of each kept."""
    trimmed = F.filter(
        F.transform(or_empty(names), lambda n: F.trim(n)), lambda n: n.isNotNull() & (n != "")
    )
    return first_of_each(F.transform(trimmed, t.community_tag), F.lower)


def parse_communities(text: Column) -> Column:
    """A comma- or space-separated argument as a clean list."""
    return community_list(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^,\s]+"), F.lit(0)))


def seed_communities(entries: Column) -> Column:
    """Seed entries ``(name, …)`` with tagged names, first of each kept."""
    named = F.filter(or_empty_entries(entries), lambda e: F.coalesce(F.trim(e["name"]), F.lit("")) != "")
    tagged = F.transform(
        named,
        lambda e: F.struct(
            t.seed_community_tag(e["name"]).alias("name"), e["confidence"].alias("confidence"),
            e["why"].alias("why"), e["flags"].alias("flags"),
        ),
    )
    return first_of_each(tagged, lambda e: F.lower(e["name"]))


def or_empty_entries(entries: Column) -> Column:
    return F.coalesce(
        entries, F.array().cast("array<struct<name:string,confidence:double,why:string,flags:array<string>>>")
    )


def seed_metadata(entries: Column) -> Column:
    """Name, confidence, reason and flags of each seed entry; missing flags are an empty list."""
    return F.transform(
        or_empty_entries(entries),
        lambda e: F.struct(
            e["name"].alias("name"), e["confidence"].alias("confidence"), e["why"].alias("why"),
            or_empty(e["flags"]).alias("flags"),
        ),
    )


def curated_communities(prompts: DataFrame, curated: DataFrame) -> DataFrame:
    """``(plan_id, curated)``: communities curated for words of the prompt, in word order (equi-join)."""
    words = prompts.select("plan_id", F.posexplode(t.prompt_words(F.col("prompt"))).alias("word_at", "word"))
    offers = words.join(curated.select("word", "pos", "community"), "word").select(
        "plan_id", F.struct("word_at", "pos", t.community_tag(F.col("community")).alias("community")).alias("offer")
    )
    listed = offers.groupBy("plan_id").agg(F.sort_array(F.collect_list("offer")).alias("offers"))
    return listed.select("plan_id", first_of_each(F.transform("offers", lambda o: o["community"]), F.lower).alias("curated"))


def heuristic_plans(prompts: DataFrame, curated: DataFrame, max_communities: int = MAX_COMMUNITIES, months: int = 12,
                    min_upvotes: int = 20, limit: int = 1000) -> DataFrame:
    """Plans from ``(plan_id, prompt, report_type, seeds)``: seeds, then curated communities, capped."""
    offered = prompts.join(curated_communities(prompts, curated), "plan_id", "left")
    both = first_of_each(F.concat(community_list(F.col("seeds")), F.coalesce("curated", empty_texts())), F.lower)
    return offered.select(
        "plan_id", "prompt",
        cap(both, max_communities).alias("communities"),
        F.struct(
            F.lit(months).alias("months"), F.lit(min_upvotes).alias("min_upvotes"), F.lit(limit).alias("limit")
        ).alias("params"),
        report_type(F.col("prompt"), F.col("report_type")).alias("report_type"),
    )


#: Parts that only a proposal has; all of them stay.
_PROPOSED_PARTS = ["filters", "keywords", "keyword_plan", "topic_themes", "warnings", "validation_hints"]


def assemble(heuristics: DataFrame, proposals: DataFrame, max_communities: int = MAX_COMMUNITIES) -> DataFrame:
    """The proposed plan where it names communities, else the heuristic one; ``rationale`` says which.

    ``proposals`` is ``(plan_id, communities, params, report_type)``, made by any outside planner, with as many of the
    other parts of a plan as it has; these are kept, and null in a heuristic plan.
    """
    parts = [c for c in _PROPOSED_PARTS if c in proposals.columns]
    other = proposals.select(
        "plan_id", F.col("communities").alias("p_communities"), F.col("params").alias("p_params"),
        F.col("report_type").alias("p_type"), *[F.col(c).alias(f"p_{c}") for c in parts],
    )
    proposed = F.coalesce(F.size("p_communities") > 0, F.lit(False))

    def choose(theirs: str, ours: str) -> Column:
        return F.when(proposed, F.col(theirs)).otherwise(F.col(ours))

    return heuristics.join(other, "plan_id", "left").select(
        "plan_id", "prompt",
        cap(community_list(choose("p_communities", "communities")), max_communities).alias("communities"),
        choose("p_params", "params").alias("params"),
        choose("p_type", "report_type").alias("report_type"),
        F.when(proposed, "llm").otherwise("heuristic").alias("rationale"),
        *[F.when(proposed, F.col(f"p_{c}")).alias(c) for c in parts],
    )


def complete(plans: DataFrame, user_keywords: DataFrame, seeds: DataFrame) -> DataFrame:
    """Rows of ``schemas.PLAN``: assembled plans with the user's keywords ``(plan_id, keywords)`` and their seeds.

    The user's keywords replace the plan's in its filters; without any, the plan has no filters. Themes, warnings and
    hints that a plan lacks come from its seed, whose entries are kept.
    """
    plans = plans.withColumns(
        {c: F.lit(None).cast(schemas.PLAN[c].dataType) for c in _PROPOSED_PARTS if c not in plans.columns}
    )
    asked = user_keywords.select("plan_id", dedupe(F.col("keywords")).alias("u_keywords"))
    seeded = seeds.select(
        "plan_id", F.col("subreddits").alias("seed"), F.col("topic_themes").alias("s_themes"), F.col("warnings").alias("s_warnings"),
        F.col("validation_hints").alias("s_hints"),
    )
    filters = F.struct(
        F.col("u_keywords").alias("keywords"),
        *[F.col(f"filters.{f.name}").alias(f.name) for f in schemas.FILTERS if f.name != "keywords"],
    )
    return plans.join(asked, "plan_id", "left").join(seeded, "plan_id", "left").select(
        "plan_id", "prompt", "communities", "params", F.when(F.size(or_empty(F.col("u_keywords"))) > 0, filters).alias("filters"),
        "report_type", "rationale", "keywords", "keyword_plan",
        seed_defaults(F.col("warnings"), F.col("s_warnings")).alias("warnings"),
        seed_defaults(F.col("validation_hints"), F.col("s_hints")).alias("validation_hints"),
        F.coalesce("topic_themes", "s_themes").alias("topic_themes"), "seed",
    )


def plan_rows(prompts: DataFrame, curated: DataFrame, seeds: DataFrame, proposals: DataFrame,
              max_communities: int = MAX_COMMUNITIES) -> DataFrame:
    """Prompts ``(plan_id, prompt, report_type, keywords)`` to full plans, for a whole table at once.

    ``seeds`` has rows of ``schemas.SEED``, ``proposals`` of ``schemas.PLAN``; either may be empty.
    """
    named = seeds.select("plan_id", F.transform(or_empty_entries(F.col("subreddits")), lambda e: e["name"]).alias("seeds"))
    asked = prompts.select("plan_id", "prompt", "report_type").join(named, "plan_id", "left")
    plans = assemble(heuristic_plans(asked, curated, max_communities), proposals, max_communities)
    return complete(plans, prompts, seeds)


def keyword_filters(keywords: Column) -> Column:
    """A filter block only where there are keywords."""
    return F.when(F.size(or_empty(keywords)) > 0, F.struct(keywords.alias("keywords")))


def seed_defaults(own: Column, seeded: Column) -> Column:
    """The plan's own list where the plan has one, else the seed's, de-duplicated."""
    return F.coalesce(own, dedupe(seeded))


# --- vetting -----------------------------------------------------------------------------------------

def with_candidates(plans: DataFrame, limit: int = MAX_COMMUNITIES) -> DataFrame:
    """``(plan_id, pos, community)`` of the first ``limit`` communities: the cap comes before vetting."""
    return plans.select("plan_id", F.posexplode(cap(F.col("communities"), limit)).alias("pos", "community"))


def passing_profile(candidates: DataFrame, profiles: DataFrame, minimum: int = fixed.MIN_SUBSCRIBERS) -> DataFrame:
    """Candidates with a known profile that is not over-18 and large enough, under the profile's spelling."""

    def name(column: str) -> Column:
        return F.lower(F.replace(column, F.lit("r/"), F.lit("")))

    fit = profiles.where(~F.coalesce("over18", F.lit(False)) & (F.coalesce("subscribers", F.lit(0)) >= minimum))
    fit = fit.select(name("community").alias("_name"), "community")
    asked = candidates.select("plan_id", "pos", name("community").alias("_name"))
    return asked.join(fit, "_name").select("plan_id", "pos", "community")


def without_blocked(candidates: DataFrame, blocked: DataFrame, case_sensitive: bool = False,
                    keep_if_empty: bool = False) -> DataFrame:
    """Anti-join with a blocklist ``(community)``; optionally a plan losing everything keeps its list."""
    key = (lambda c: c) if case_sensitive else F.lower
    banned = blocked.select(key(F.col("community")).alias("_key")).distinct()
    keyed = candidates.withColumn("_key", key(F.col("community")))
    allowed = keyed.join(banned, "_key", "left_anti").drop("_key")
    if not keep_if_empty:
        return allowed
    lost = candidates.join(allowed.select("plan_id").distinct(), "plan_id", "left_anti")
    return allowed.unionByName(lost.select(*allowed.columns))


def ordered_unique(candidates: DataFrame, limit: int) -> DataFrame:
    """First spelling of each community in order, ``limit`` per plan."""
    from postlens.operators.topn import top_n

    first = candidates.groupBy("plan_id", F.lower("community").alias("_key")).agg(
        F.min_by("community", "pos").alias("community"), F.min("pos").alias("pos")
    )
    return top_n(first, ["plan_id"], [F.asc("pos")], limit).select("plan_id", "pos", "community")


def community_lists(candidates: DataFrame, name: str = "communities") -> DataFrame:
    listed = F.sort_array(F.collect_list(F.struct("pos", "community")))
    return candidates.groupBy("plan_id").agg(F.transform(listed, lambda c: c["community"]).alias(name))


def vet(plans: DataFrame, profiles: DataFrame, blocked: DataFrame, limit: int = MAX_COMMUNITIES) -> DataFrame:
    """``(plan_id, vetted)``: by profile; where no candidate passes, by blocklist instead."""
    candidates = with_candidates(plans, limit)
    good = community_lists(passing_profile(candidates, profiles), "good")
    tagged = candidates.withColumn("community", t.community_tag(F.col("community")))
    clean = community_lists(ordered_unique(without_blocked(tagged, blocked, case_sensitive=True), limit), "clean")
    return (
        plans.select("plan_id")
        .join(good, "plan_id", "left")
        .join(clean, "plan_id", "left")
        .select("plan_id", F.coalesce("good", "clean", empty_texts()).alias("vetted"))
    )


def patch(plans: DataFrame, vetted: DataFrame) -> DataFrame:
    """Plans with their vetted communities, unless none are left."""
    joined = plans.join(vetted, "plan_id", "left")
    chosen = F.when(F.size(or_empty(F.col("vetted"))) > 0, F.col("vetted")).otherwise(F.col("communities"))
    return joined.withColumn("communities", chosen).drop("vetted")
