"""Prompts to search terms, for a whole table of prompts at once.

A prompt table has one row per ``plan_id``. Words meet the synonym table in an equi-join; everything else is
array work inside the row. The word lists of a prompt are put together again in one task per ``plan_id``,
which is bounded by the length of that prompt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens import fixed_values as fixed
from postlens.functions import text as t
from postlens.functions.lists import bind, cap, dedupe, empty_texts, first_of_each, literal_list, merge, or_empty

KEY = "plan_id"


def with_tokens(prompts: DataFrame) -> DataFrame:
    """``(plan_id, tokens)`` from ``prompt`` and the keyword string ``keywords``."""
    return prompts.select(KEY, F.concat(t.tokens(F.col("prompt")), t.tokens(F.col("keywords"))).alias("tokens"))


def with_variants(token_lists: DataFrame, synonyms: DataFrame) -> DataFrame:
    """``(plan_id, found)``: each distinct token in order, with its synonyms in order.

    Order of synonyms: those of the full key before those of a stem, a longer stem before a shorter one.
    Only words with synonyms pass the join, so only they are grouped again by prompt.
    """
    lists = token_lists.select(KEY, F.array_distinct("tokens").alias("tokens"))
    # Exploding a plain column would add a filter that computes the column again; an expression does not.
    words = token_lists.select(KEY, F.posexplode(F.array_distinct("tokens")).alias("pos", "term"))
    keyed = words.select(KEY, "pos", F.posexplode(t.lookup_keys(F.col("term"))).alias("key_pos", "key"))
    hits = keyed.join(synonyms.select("key", F.col("pos").alias("variant_pos"), "variant"), "key")
    hit_lists = hits.groupBy(KEY).agg(
        F.sort_array(F.collect_list(F.struct("pos", "key_pos", "variant_pos", "variant"))).alias("hits")
    )

    def word(term: Column, pos: Column) -> Column:
        own = F.filter(F.col("hits"), lambda h: h["pos"] == pos)
        variants = F.transform(own, lambda h: h["variant"])
        return F.struct(pos.alias("pos"), term.alias("term"), or_empty(variants).alias("variants"))

    return lists.join(hit_lists, KEY, "left").select(KEY, F.transform("tokens", word).alias("found"))


def _is_stop(term: Column) -> Column:
    return t.fold(term).isin(*fixed.STOP_WORDS)


def expanded_terms(found: Column) -> Column:
    """Words without stop words, replaced by their synonyms; without any, the word and its ASCII form."""
    kept = F.filter(found, lambda f: (F.length(f["term"]) >= 3) & ~_is_stop(f["term"]))
    variants = F.flatten(
        F.transform(
            kept,
            lambda f: F.when(F.size(f["variants"]) > 0, f["variants"]).otherwise(
                F.array_distinct(F.array(f["term"], t.ascii_form(f["term"])))
            ),
        )
    )
    usable = F.filter(
        F.transform(variants, lambda v: F.trim(v)), lambda v: (F.length(v) >= 3) & ~_is_stop(v)
    )
    return first_of_each(usable, t.fold)


def english_terms(expanded: Column, found: Column) -> Column:
    """ASCII part of the expanded terms; if none is left, ASCII forms of the raw tokens."""

    def ascii_list(items: Column) -> Column:
        return first_of_each(F.filter(items, lambda x: x != ""), F.lower)

    main = ascii_list(F.transform(expanded, t.ascii_only))
    raw = ascii_list(F.transform(found, lambda f: t.ascii_only(t.ascii_form(f["term"]))))
    return bind(main, lambda m: F.when(F.size(m) > 0, m).otherwise(raw))


def basic_terms(found: Column) -> Column:
    """Synonyms where there are some, else the plain ASCII word."""
    plain = F.transform(
        found,
        lambda f: F.struct(t.ascii_only(t.ascii_form(f["term"])).alias("word"), f["variants"].alias("variants")),
    )
    usable = F.filter(plain, lambda p: F.length(p["word"]) >= 3)
    listed = F.flatten(
        F.transform(
            usable, lambda p: F.when(F.size(p["variants"]) > 0, p["variants"]).otherwise(F.array(p["word"]))
        )
    )
    return first_of_each(F.filter(listed, lambda v: ~_is_stop(v)), t.fold)


def term_lists(token_lists: DataFrame, synonyms: DataFrame) -> DataFrame:
    """``(plan_id, tokens, expanded, english, basic)`` in one pass over the synonym join."""
    found = with_variants(token_lists, synonyms)
    staged = found.withColumn("expanded", expanded_terms(F.col("found")))
    return staged.select(
        KEY,
        F.transform("found", lambda f: f["term"]).alias("tokens"),
        "expanded",
        english_terms(F.col("expanded"), F.col("found")).alias("english"),
        basic_terms(F.col("found")).alias("basic"),
    )


def prompt_terms(prompts: DataFrame, synonyms: DataFrame) -> DataFrame:
    return term_lists(with_tokens(prompts), synonyms)


# --- search strategies -------------------------------------------------------------------------------

def search_strategies(english: Column, basic: Column, max_terms=fixed.SEARCH_TERM_CAP) -> Column:
    """Term lists to try in order, phrases of the first one quoted; never empty."""
    quoted = F.transform(
        cap(english, max_terms),
        lambda k: F.when(k.contains(" "), F.concat(F.lit('"'), k, F.lit('"'))).otherwise(k),
    )
    tried = F.array_distinct(
        F.filter(F.array(quoted, cap(basic, max_terms)), lambda terms: F.size(terms) > 0)
    )
    default = F.array(literal_list(fixed.DEFAULT_TERMS))
    return bind(tried, lambda lists: F.when(F.size(lists) > 0, lists).otherwise(default))


def strategy_terms(lists: DataFrame, max_terms=fixed.SEARCH_TERM_CAP) -> DataFrame:
    """Long form ``(plan_id, strategy, pos, term)``, strategies and positions from 0, quotes removed."""
    strategies = lists.select(
        KEY,
        F.posexplode(search_strategies(F.col("english"), F.col("basic"), max_terms)).alias("strategy", "terms"),
    )
    long = strategies.select(KEY, "strategy", F.posexplode("terms").alias("pos", "term"))
    return long.withColumn("term", F.replace("term", F.lit('"'), F.lit("")))


def search_query(terms: Column) -> Column:
    return F.array_join(terms, " OR ")


# --- plan terms --------------------------------------------------------------------------------------

def prepare_keywords(prompts: DataFrame, synonyms: DataFrame) -> DataFrame:
    """``(plan_id, keywords)`` from the prompt and a list column ``keyword_list``, capped at 24."""
    lists = prompts.select(
        KEY, F.concat(t.tokens(F.col("prompt")), t.list_tokens(F.col("keyword_list"))).alias("tokens")
    )
    return term_lists(lists, synonyms).select(KEY, cap(F.col("english"), fixed.KEYWORD_CAP).alias("keywords"))


def _phrases(bucket: Column) -> Column:
    return F.transform(
        F.coalesce(bucket, F.array().cast("array<struct<phrase:string,keyword:string>>")),
        lambda e: F.coalesce(F.nullif(e["phrase"], F.lit("")), e["keyword"]),
    )


def focus_base(plans: DataFrame) -> Column:
    """The plan's own terms: required, optional, keywords, then the keyword plan; 48 at most."""
    lists = [F.col("filters.must_include"), F.col("filters.should_include"), F.col("keywords")]
    if "keyword_plan" in plans.columns:
        lists += [_phrases(F.col(f"keyword_plan.{b}")) for b in ("core", "long_tail", "exploratory")]
    return cap(merge(*lists), fixed.FOCUS_BASE_CAP)


def focus_terms(plans: DataFrame, synonyms: DataFrame, split_phrases: bool = False) -> DataFrame:
    """``(plan_id, focus_terms)``. ``split_phrases`` expands the words of a phrase one by one."""
    base = focus_base(plans)
    own = t.tokens(F.array_join(base, " ")) if split_phrases else t.list_tokens(base)
    lists = plans.select(KEY, F.concat(t.tokens(F.col("prompt")), own).alias("tokens"))
    return term_lists(lists, synonyms).select(
        KEY, cap(dedupe(F.col("english")), fixed.FOCUS_CAP).alias("focus_terms")
    )


def filter_lists(filters: Column) -> list[Column]:
    """The four clean filter lists of a plan."""
    names = {"must": "must_include", "should": "should_include", "exclude": "exclude", "languages": "languages"}
    return [dedupe(filters[field]).alias(name) for name, field in names.items()]


def seed_keywords(seeds: DataFrame) -> DataFrame:
    """``(plan_id, communities, keywords, exclude)`` from seeds and the users' own keywords."""
    names = F.transform("subreddits", lambda e: t.seed_community_tag(e["name"]))
    tags = F.filter(names, lambda n: n.isNotNull() & (n != ""))
    return seeds.select(
        KEY,
        first_of_each(F.coalesce(tags, empty_texts()), F.lower).alias("communities"),
        merge(
            F.col("keywords"),
            F.col("filters.must_include"),
            F.col("filters.should_include"),
            t.keyword_list(F.col("user_keywords")),
        ).alias("keywords"),
        dedupe(F.col("filters.exclude")).alias("exclude"),
    )


def selection_terms(keyword_lists: DataFrame, synonyms: DataFrame, split_phrases: bool = False) -> DataFrame:
    """Search terms ``(plan_id, terms)`` of a plan's keywords, 16 at most; the keywords if none survive."""
    clean = keyword_lists.select(KEY, dedupe(F.col("keywords")).alias("keywords"))
    own = t.tokens(F.array_join("keywords", " ")) if split_phrases else t.list_tokens(F.col("keywords"))
    lists = term_lists(clean.select(KEY, own.alias("tokens")), synonyms).select(KEY, "english")
    found = cap(F.col("english"), fixed.SEARCH_TERM_CAP)
    return clean.join(lists, KEY).select(
        KEY, F.when(F.size(found) > 0, found).otherwise(F.col("keywords")).alias("terms")
    )
