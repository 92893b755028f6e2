"""Sources, scalar functions and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import AS_OF, SINCE, Inputs
from checks.registry import query
from postlens import fixed_values as fixed
from postlens.functions import lists, match
from postlens.functions import text as t
from postlens.operators import select
from postlens.plans import planning
from postlens.sources import posts as source
from postlens.sources.readers import read_parquet, with_defaults

TEXT = "concat(title, '. ', selftext)"
BOTH = "lower(concat(title, ' ', selftext))"


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _contains(values, joiner: str) -> str:
    tests = [f"contains({BOTH}, '{v.lower()}')" for v in values]
    return "(" + f" {joiner} ".join(tests) + ")"


# --- sources -----------------------------------------------------------------------------------------

@query("a4_parquet_scan", "select doc_id, lang, n_chars from documents where n_chars > 500", ())
def a4(c: Inputs):
    docs = read_parquet(c.spark, f"{c.folder}/documents.parquet")
    return docs.where(F.col("n_chars") > 500).select("doc_id", "lang", "n_chars")


@query("a10_missing_columns", """
select id, coalesce(case when upvotes % 5 = 0 then null else title end, '') as title,
       cast(upvotes as bigint) as upvotes, cast(0 as bigint) as num_comments from posts""")
def a10(c: Inputs):
    holes = c.posts.drop("num_comments").withColumn(
        "title", F.when(F.col("upvotes") % 5 == 0, None).otherwise(F.col("title"))
    )
    full = with_defaults(holes)
    return full.select("id", "title", F.col("upvotes").cast("long").alias("upvotes"),
                       F.col("num_comments").cast("long").alias("num_comments"))


@query("a12_json_arguments", """
select id, case upvotes % 4 when 0 then concat(community, '|', cast(num_comments as varchar))
  when 1 then concat('trash|', id) else '' end as terms from posts""")
def a12(c: Inputs):
    kind = F.col("upvotes") % 4
    argument = (
        F.when(kind == 0, F.concat(F.lit('["'), "community", F.lit('", "  ", '), "num_comments", F.lit("]")))
        .when(kind == 1, F.concat(F.lit('[" trash ", null, "'), "id", F.lit('"]')))
        .when(kind == 2, F.lit("[not json"))
        .otherwise(F.lit('{"a": 1}'))
    )
    return c.posts.select("id", F.array_join(lists.json_list(argument), "|").alias("terms"))


# --- scalar functions --------------------------------------------------------------------------------

@query("b1_clean_text", r"""
select id, trim(regexp_replace(selftext, '[\s\x0b\x1c-\x1f\x85\p{Z}]+', ' ', 'g')) as cleaned from posts""")
def b1(c: Inputs):
    return c.posts.select("id", t.clean_text(F.col("selftext")).alias("cleaned"))


_LINK = """case when coalesce(full_link, '') <> '' then full_link
  else concat('https://www.reddit.com/r/', subreddit, '/comments/', id, '/') end"""


@query("b2_permalink", f"select id, {_LINK} as url from raw", ("raw",))
def b2(c: Inputs):
    return c.raw.select("id", t.permalink(F.col("full_link"), F.col("subreddit"), F.col("id")).alias("url"))


_POST_SQL = rf"""
select id, concat('r/', subreddit) as community, cast(created_utc as bigint) as created_utc,
       trim(regexp_replace(title, '[\s\x0b\x1c-\x1f\x85\p{{Z}}]+', ' ', 'g')) as title,
       trim(regexp_replace(selftext, '[\s\x0b\x1c-\x1f\x85\p{{Z}}]+', ' ', 'g')) as selftext,
       {_LINK} as url, cast(coalesce(score, 0) as int) as upvotes,
       cast(coalesce(num_comments, 0) as int) as num_comments, 'community_search' as source"""


@query("b3_raw_to_post", f"{_POST_SQL} from raw", ("raw",))
def b3(c: Inputs):
    return source.to_posts(c.raw, select.COMMUNITY_SOURCE).drop("fetched_at")


@query("b4_analysis_text", f"select id, {TEXT} as text, concat(title, ' ', selftext) as searched from posts")
def b4(c: Inputs):
    title, body = F.col("title"), F.col("selftext")
    return c.posts.select("id", t.analysis_text(title, body).alias("text"), t.match_text(title, body).alias("searched"))


@query("b5_lenient_numbers", """
select id, case num_comments % 5 when 0 then upvotes when 1 then upvotes when 4 then upvotes + 1 else 0 end as upvotes
from posts""")
def b5(c: Inputs):
    kind, votes = F.col("num_comments") % 5, F.col("upvotes").cast("string")
    messy = (
        F.when(kind == 0, votes)
        .when(kind == 1, F.concat(votes, F.lit(".7")))
        .when(kind == 2, F.concat(votes, F.lit("k")))
        .when(kind == 3, F.lit("nan"))
        .otherwise((F.col("upvotes") + 1).cast("string"))
    )
    return c.posts.select("id", t.whole_number(messy).alias("upvotes"))


@query("b6_pain_score", """
select id, round(greatest(0.0, -s) * (1 + ln(1 + upvotes + num_comments)), 3) as pain_score
from (select *, cast(num_comments as double) / 48 - 1 as s from posts)""")
def b6(c: Inputs):
    mood = F.col("num_comments").cast("double") / 48 - 1
    return c.posts.select("id", t.pain_score(mood, F.col("upvotes"), F.col("num_comments")).alias("pain_score"))


_ENGLISH = rf"""coalesce(length(regexp_replace({TEXT}, '[^A-Za-z]', '', 'g'))
  / nullif(length(regexp_replace({TEXT}, '\P{{L}}', '', 'g')), 0) > 0.7, true)"""


@query("b7_english_test", f"select id, {_ENGLISH} as english from posts")
def b7(c: Inputs):
    return c.posts.select("id", t.is_english(t.analysis_text(F.col("title"), F.col("selftext"))).alias("english"))


@query("b8_non_ascii_test", r"select id, regexp_matches(selftext, '[^\x00-\x7F]') as non_english from posts")
def b8(c: Inputs):
    return c.posts.select("id", t.has_non_ascii(F.col("selftext")).alias("non_english"))


_GAPS = "list_concat(" * 3 + ", ".join(
    [f"regexp_extract_all(lower({TEXT}), '{p}')".replace("n't ", "n''t ").replace("can't", "can''t") +
     (")" if i else "") for i, p in enumerate(fixed.COMPLAINT_PATTERNS)]
)


@query("b9_complaint_phrases", f"""
select id, cast(pos as int) as pos, trim(gap) as gap
from (select id, unnest(found) as gap, generate_subscripts(found, 1) as pos
      from (select id, {_GAPS} as found from posts)) where pos <= 5""")
def b9(c: Inputs):
    found = t.complaints(t.analysis_text(F.col("title"), F.col("selftext")))
    return c.posts.select("id", F.posexplode(found).alias("pos", "gap")).withColumn("pos", F.col("pos") + 1)


@query("b10_prompt_norm", r"""
select plan_id, trim(regexp_replace(lower(prompt), '[^a-z0-9\s]', ' ', 'g')) as normal from prompts""", ("prompts",))
def b10(c: Inputs):
    return c.prompts.select("plan_id", t.prompt_norm(F.col("prompt")).alias("normal"))


@query("b11_community_tag", """
select distinct concat('r/', regexp_extract(name, '[^/]*$')) as tag,
  case when lower(trim(name)) like 'r/%' then trim(name) else concat('r/', regexp_extract(trim(name), '[^/]*$')) end as seed
from (select case upvotes % 3 when 0 then community when 1 then replace(community, 'r/', '')
  else concat('x/', community) end as name from posts)""")
def b11(c: Inputs):
    kind = F.col("upvotes") % 3
    name = (
        F.when(kind == 0, F.col("community"))
        .when(kind == 1, F.replace("community", F.lit("r/"), F.lit("")))
        .otherwise(F.concat(F.lit("x/"), F.col("community")))
    )
    return c.posts.select(t.community_tag(name).alias("tag"), t.seed_community_tag(name).alias("seed")).distinct()


@query("b12_window_start", f"""
select id, {AS_OF} - greatest(1, cast(upvotes % 5 - 1 as bigint)) * 2592000 as since from posts""")
def b12(c: Inputs):
    since = t.window_start(F.lit(AS_OF), (F.col("upvotes") % 5 - 1).cast("int"))
    return c.posts.select("id", since.cast("long").alias("since"))


@query("b14_ascii_form", r"""
select plan_id, trim(regexp_replace(translate(prompt, 'çğışöüÇĞİÖŞÜ', 'cgisouCGIOSU'), '[^\x00-\x7F]', '', 'g')) as plain
from prompts""", ("prompts",))
def b14(c: Inputs):
    return c.prompts.select("plan_id", t.ascii_only(t.ascii_form(F.col("prompt"))).alias("plain"))


# --- filters -----------------------------------------------------------------------------------------

@query("c1_minimum_score", "select id, upvotes from posts where upvotes >= 300")
def c1(c: Inputs):
    return source.min_score(c.posts, 300).select("id", "upvotes")


@query("c2_time_range", f"""
select id, created_utc from posts where created_utc > {SINCE} and created_utc < {SINCE + 864000}""")
def c2(c: Inputs):
    return source.in_window(c.posts, SINCE, SINCE + 864_000).select("id", "created_utc")


_WORDS = ["trash", "sync is broken", "Log In"]


@query("c3_exclude_terms", f"select id, community from posts where not {_contains(_WORDS, 'or')}")
def c3(c: Inputs):
    return select.keyword_filter(c.posts, [], _WORDS).select("id", "community")


@query("c4_include_any", f"select id, community from posts where {_contains(_WORDS, 'or')}")
def c4(c: Inputs):
    return select.keyword_filter(c.posts, _WORDS).select("id", "community")


@query("c5_include_all", f"select id, community from posts where {_contains(['tion', 'export', 'better'], 'and')}")
def c5(c: Inputs):
    return select.keyword_filter(c.posts, ["tion", "export", "better"], mode="all").select("id", "community")


@query("c6_no_terms_pass", "select id, community from posts")
def c6(c: Inputs):
    text = t.match_text(F.col("title"), F.col("selftext"))
    none = F.array().cast("array<string>")
    kept = c.posts.where((F.size(none) == 0) | match.contains_any(text, none))
    return select.keyword_filter(kept, []).select("id", "community")


@query("c7_minimum_length", f"select id, cast(length({TEXT}) as int) as length from posts where length({TEXT}) > 20")
def c7(c: Inputs):
    text = t.analysis_text(F.col("title"), F.col("selftext"))
    return c.posts.where(F.length(text) > fixed.MIN_TEXT_LENGTH).select("id", F.length(text).alias("length"))


@query("c8_english_only", f"select id, community from posts where {_ENGLISH}")
def c8(c: Inputs):
    text = t.analysis_text(F.col("title"), F.col("selftext"))
    return c.posts.where(t.is_english(text)).select("id", "community")


@query("c12_blank_elements", """
select plan_id, coalesce(string_agg(trim(x), '|' order by pos), '') as kept from (
  select plan_id, unnest(items) as x, generate_subscripts(items, 1) as pos
  from (select plan_id, string_split(concat(must_terms, ',', should_terms), ',') as items from prompts)) s
where trim(x) <> '' group by plan_id""", ("prompts",))
def c12(c: Inputs):
    items = F.split(F.concat_ws(",", "must_terms", "should_terms"), ",")
    return c.prompts.select("plan_id", F.array_join(lists.drop_blank(items), "|").alias("kept"))


_CANDIDATES = """, cand as (
  select plan_id, cast(pos as int) as pos, community from (
    select plan_id, unnest(items) as community, generate_subscripts(items, 1) - 1 as pos from (
      select plan_id, regexp_extract_all(communities, '[^, ]+') as items from prompts)) where pos < 8)"""


@query("c10_community_gate", _CANDIDATES + """
select plan_id, p.community from cand c join profiles p
  on lower(replace(c.community, 'r/', '')) = lower(replace(p.community, 'r/', ''))
where not coalesce(over18, false) and coalesce(subscribers, 0) >= 10000""", ("prompts", "profiles"))
def c10(c: Inputs):
    passing = planning.passing_profile(planning.with_candidates(c.plans), c.profiles)
    return passing.select("plan_id", "community")


def _blocked(c: Inputs, names):
    return fixed.inline_table(c.spark, "community", [(n,) for n in names])


@query("c11_blocklist_cased", _CANDIDATES + f"""
select plan_id, community from cand where community not in ({_quoted(fixed.VETTING_BLOCKLIST)})""", ("prompts",))
def c11(c: Inputs):
    candidates = planning.with_candidates(c.plans)
    kept = planning.without_blocked(candidates, _blocked(c, fixed.VETTING_BLOCKLIST), case_sensitive=True)
    return kept.select("plan_id", "community")


@query("c11_blocklist_keep_if_empty", _CANDIDATES + f"""
, marked as (select *, lower(concat('r/', regexp_extract(community, '[^/]*$')))
    in ({_quoted(fixed.SEED_BLOCKLIST)}) as bad from cand)
select plan_id, concat('r/', regexp_extract(community, '[^/]*$')) as community from (
  select *, min(bad) over (partition by plan_id) as all_bad from marked) where all_bad or not bad""", ("prompts",))
def c11_keep(c: Inputs):
    candidates = planning.with_candidates(c.plans).withColumn("community", t.community_tag(F.col("community")))
    kept = planning.without_blocked(candidates, _blocked(c, fixed.SEED_BLOCKLIST), keep_if_empty=True)
    return kept.select("plan_id", "community")


@query("i3_difference_with_blocklist", _CANDIDATES + f"""
select plan_id, community from cand where lower(community) not in ({_quoted(fixed.DISCOVERY_BLOCKLIST)})""",
       ("prompts",))
def i3(c: Inputs):
    kept = planning.without_blocked(planning.with_candidates(c.plans), _blocked(c, fixed.DISCOVERY_BLOCKLIST))
    return kept.select("plan_id", "community")
