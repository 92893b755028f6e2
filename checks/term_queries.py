"""Term building and planning over a table of prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import Inputs
from checks.registry import query, with_views
from checks.text_queries import _quoted
from postlens import fixed_values as fixed
from postlens.functions import lists
from postlens.functions import text as t
from postlens.functions.match import python_fold
from postlens.operators import discover, evidence, terms
from postlens.plans import planning

_NOT_TOKEN = r"[^0-9A-Za-zçğışöüÇĞİÖŞÜ+#\-/_.]+"


def joined(column, separator="|"):
    return F.array_join(column, separator)


# --- SQL building blocks -----------------------------------------------------------------------------

def token_ctes(source: str) -> str:
    """``toks(plan_id, pos, term)`` from ``source(plan_id, src, text, as_list)``."""
    return rf""", parts as (
  select plan_id, src, ppos, case when quoted then regexp_replace(part, '"([^"]*)"|''([^'']*)''', '\1\2', 'g')
         else part end as part
  from (select plan_id, src, quoted, unnest(items) as part, generate_subscripts(items, 1) as ppos from (
    select plan_id, src, quoted, case when quoted
        then regexp_extract_all(text, '(?:[^\s"'']+|"[^"]*"|''[^'']*'')+') else regexp_extract_all(text, '\S+') end as items
    from (select *, not regexp_matches(regexp_replace(text, '"[^"]*"|''[^'']*''', '', 'g'), '["'']') as quoted
          from ({source}))))),
cleaned as (select plan_id, src, ppos, contains(part, ' ') as phrase,
  regexp_extract_all(lower(regexp_replace(part, '{_NOT_TOKEN}', ' ', 'g')), '\S+') as chunks from parts),
loose as (
  select plan_id, src, ppos, 1 as cpos, array_to_string(chunks, ' ') as term from cleaned where phrase and len(chunks) > 0
  union all
  select plan_id, src, ppos, generate_subscripts(chunks, 1), unnest(chunks) from cleaned where not phrase),
toks as (select plan_id, row_number() over (partition by plan_id order by src, ppos, cpos) as pos, term from loose)"""


PROMPT_TOKENS = token_ctes(
    "select plan_id, 1 as src, prompt as text from prompts union all select plan_id, 2, keywords from prompts"
)

_ASCII = "translate({0}, 'çğışöüÇĞİÖŞÜ', 'cgisouCGIOSU')"


def _key(word: str) -> str:
    return python_fold(word).translate(str.maketrans(fixed.TURKISH_LETTERS, fixed.TURKISH_ASCII))


def _synonym_values() -> str:
    rows = {_key(w): v for w, v in fixed.SYNONYMS.items()}
    return ", ".join(f"('{k}', {i}, '{v}')" for k, vs in rows.items() for i, v in enumerate(vs))


_SUFFIXES = ", ".join(f"('{s}')" for s in dict.fromkeys(fixed.SUFFIXES))
_STOP = _quoted(fixed.STOP_WORDS)

EXPANSION = f"""
, dist as (select plan_id, term, min(pos) as pos from toks group by plan_id, term),
keyed as (select plan_id, term, pos, {_ASCII.format('lower(term)')} as key, 0 as kpos from dist
  union all
  select plan_id, term, pos, left(key, length(key) - length(s)), length(s) from (
    select *, {_ASCII.format('lower(term)')} as key from dist), (values {_SUFFIXES}) suf(s)
  where key like concat('%', s) and length(key) - length(s) >= 3),
syn(key, vpos, variant) as (values {_synonym_values()}),
vars as (select plan_id, term, pos, kpos, vpos, variant from keyed join syn using (key)),
wide as (
  select plan_id, term, pos, kpos, vpos, variant from vars where length(term) >= 3 and term not in ({_STOP})
  union all
  select plan_id, term, pos, 0, b, case b when 0 then term else {_ASCII.format('term')} end
  from dist d, (values (0), (1)) two(b)
  where length(term) >= 3 and term not in ({_STOP})
    and not exists (select 1 from vars v where v.plan_id = d.plan_id and v.term = d.term)),
expanded as (
  select plan_id, arg_min(variant, (pos, kpos, vpos)) as term, row_number() over (
    partition by plan_id order by min((pos, kpos, vpos))) as pos
  from wide where length(trim(variant)) >= 3 and lower(variant) not in ({_STOP})
  group by plan_id, lower(variant)),
ascii_main as (
  select plan_id, arg_min(w, pos) as term, min(pos) as pos, 1 as pref from (
    select plan_id, pos, trim(regexp_replace(term, '[^\\x00-\\x7F]', '', 'g')) as w from expanded)
  where w <> '' group by plan_id, lower(w)),
ascii_raw as (
  select plan_id, arg_min(w, pos) as term, min(pos) as pos, 2 as pref from (
    select plan_id, pos, trim(regexp_replace({_ASCII.format('term')}, '[^\\x00-\\x7F]', '', 'g')) as w from dist)
  where w <> '' group by plan_id, lower(w)),
english as (
  select plan_id, term, row_number() over (partition by plan_id order by pos) as pos from (
    select *, min(pref) over (partition by plan_id) as best from (
      select * from ascii_main union all select * from ascii_raw)) where pref = best),
basic as (
  select plan_id, arg_min(v, (pos, kpos, vpos)) as term, row_number() over (
    partition by plan_id order by min((pos, kpos, vpos))) as pos from (
      select v.plan_id, pos, kpos, vpos, variant as v from vars v
      where length(trim(regexp_replace({_ASCII.format('v.term')}, '[^\\x00-\\x7F]', '', 'g'))) >= 3
      union all
      select plan_id, pos, 0, 0, w from (
        select *, trim(regexp_replace({_ASCII.format('term')}, '[^\\x00-\\x7F]', '', 'g')) as w from dist) d
      where length(w) >= 3
        and not exists (select 1 from vars v where v.plan_id = d.plan_id and v.term = d.term))
  where lower(v) not in ({_STOP}) group by plan_id, lower(v)),
tried as (
  select plan_id, 1 as strategy, string_agg(case when contains(term, ' ') then concat('"', term, '"') else term end,
    ' OR ' order by pos) as q from english where pos <= 16 group by plan_id
  union all
  select plan_id, 2, string_agg(term, ' OR ' order by pos) from basic where pos <= 16 group by plan_id),
searches as (
  select plan_id, q, row_number() over (partition by plan_id order by min(strategy)) as strategy
  from tried group by plan_id, q
  union all
  select plan_id, '{" OR ".join(fixed.DEFAULT_TERMS)}', 1 from prompts
  where plan_id not in (select plan_id from tried))"""


def _listing(table: str, limit: int | None = None) -> str:
    cut = f" and x.pos <= {limit}" if limit else ""
    return f""" select p.plan_id, coalesce(string_agg(x.term, '|' order by x.pos), '') as terms
  from prompts p left join {table} x on p.plan_id = x.plan_id{cut} group by p.plan_id"""


# --- tokens and expansion ----------------------------------------------------------------------------

@query("t1_tokens", PROMPT_TOKENS + _listing("toks"), ("prompts",))
def t1(c: Inputs):
    return terms.with_tokens(c.prompts).select("plan_id", joined("tokens").alias("terms"))


@query("t1_tokens_of_posts", token_ctes("select id as plan_id, 1 as src, selftext as text from posts")
       + " select plan_id as id, count(*) as n, sum(length(term))::bigint as letters from toks group by 1")
def t1_posts(c: Inputs):
    found = t.tokens(F.col("selftext"))
    listed = c.posts.select("id", F.explode(found).alias("term"))
    return listed.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.length("term")).alias("letters"))


@query("t2_stop_words", PROMPT_TOKENS + f"""
select p.plan_id, coalesce(string_agg(x.term, '|' order by x.pos), '') as terms
from prompts p left join toks x on p.plan_id = x.plan_id and length(x.term) >= 3 and x.term not in ({_STOP})
group by p.plan_id""", ("prompts",))
def t2(c: Inputs):
    kept = t.drop_stop_words(F.col("tokens"))
    return terms.with_tokens(c.prompts).select("plan_id", joined(kept).alias("terms"))


@query("t3_lookup_keys", PROMPT_TOKENS + f"""
select plan_id, string_agg({_ASCII.format('lower(term)')}, '|' order by pos) as keys from toks group by plan_id""",
       ("prompts",))
def t3(c: Inputs):
    listed = terms.with_tokens(c.prompts).where(F.size("tokens") > 0)
    return listed.select("plan_id", joined(F.transform("tokens", t.lookup_key)).alias("keys"))


@query("t4_stems", PROMPT_TOKENS + f"""
select plan_id, term, coalesce(string_agg(left(key, length(key) - length(s)), '|' order by length(s)), '') as stems
from (select distinct plan_id, term, {_ASCII.format('lower(term)')} as key from toks)
left join (values {_SUFFIXES}) suf(s) on key like concat('%', s) and length(key) - length(s) >= 3
group by plan_id, term""", ("prompts",))
def t4(c: Inputs):
    words = terms.with_tokens(c.prompts).select("plan_id", F.explode(F.array_distinct("tokens")).alias("term"))
    return words.select("plan_id", "term", joined(t.stems(t.lookup_key(F.col("term")))).alias("stems"))


@query("t6_keywords", PROMPT_TOKENS + EXPANSION + _listing("expanded"), ("prompts",))
def t6(c: Inputs):
    return terms.prompt_terms(c.prompts, c.synonyms).select("plan_id", joined("expanded").alias("terms"))


@query("t7_english_keywords", PROMPT_TOKENS + EXPANSION + _listing("english"), ("prompts",))
def t7(c: Inputs):
    return terms.prompt_terms(c.prompts, c.synonyms).select("plan_id", joined("english").alias("terms"))


@query("t8_basic_terms", PROMPT_TOKENS + EXPANSION + _listing("basic"), ("prompts",))
def t8(c: Inputs):
    return terms.prompt_terms(c.prompts, c.synonyms).select("plan_id", joined("basic").alias("terms"))


@query("t9_search_strategies", PROMPT_TOKENS + EXPANSION + """
select plan_id, strategy, q as terms from searches""", ("prompts",))
def t9(c: Inputs):
    found = terms.prompt_terms(c.prompts, c.synonyms)
    tried = terms.search_strategies(F.col("english"), F.col("basic"))
    return found.select("plan_id", F.posexplode(tried).alias("strategy", "list")).select(
        "plan_id", (F.col("strategy") + 1).cast("long").alias("strategy"), terms.search_query(F.col("list")).alias("terms")
    )


_E1 = PROMPT_TOKENS + EXPANSION + """
select d.plan_id, d.term, coalesce(string_agg(variant, '|' order by kpos, vpos), '') as variants
from dist d left join vars v using (plan_id, term) group by d.plan_id, d.term"""


@query("t5_synonym_variants", _E1, ("prompts",))
def t5(c: Inputs):
    found = terms.with_variants(terms.with_tokens(c.prompts), c.synonyms)
    return found.select("plan_id", F.explode("found").alias("f")).select(
        "plan_id", "f.term", joined("f.variants").alias("variants")
    )


@query("e1_synonym_join", PROMPT_TOKENS + EXPANSION + """
select variant, count(*) as n from vars group by variant""", ("prompts",))
def e1(c: Inputs):
    words = terms.with_tokens(c.prompts).select("plan_id", F.explode(F.array_distinct("tokens")).alias("term"))
    keys = words.select("plan_id", F.explode(t.lookup_keys(F.col("term"))).alias("key"))
    return keys.join(c.synonyms, "key").groupBy("variant").agg(F.count("*").alias("n"))


# --- lists -------------------------------------------------------------------------------------------

def _unique(source: str, limit: int | None = None) -> str:
    """Ordered case-insensitive de-duplication of ``source(plan_id, items)``."""
    cut = f" where pos <= {limit}" if limit else ""
    return f"""select plan_id, string_agg(x, '|' order by pos) as items from (
    select plan_id, x, row_number() over (partition by plan_id order by seq) as pos from (
      select plan_id, arg_min(x, seq) as x, min(seq) as seq from (
        select plan_id, trim(unnest(items)) as x, generate_subscripts(items, 1) as seq from ({source}))
      where x <> '' group by plan_id, lower(x))){cut} group by plan_id"""


def _unique_all(source: str, limit: int | None = None) -> str:
    return f"""select p.plan_id, coalesce(u.items, '') as items from prompts p
  left join ({_unique(source, limit)}) u on p.plan_id = u.plan_id"""


_MERGED = "select plan_id, string_split(concat(must_terms, ',', should_terms, ',', warnings), ',') as items from prompts"


@query("t10_ordered_dedupe", _unique_all(_MERGED), ("prompts",))
def t10(c: Inputs):
    split = [F.split(n, ",") for n in ("must_terms", "should_terms", "warnings")]
    return c.prompts.select("plan_id", joined(lists.merge(*split)).alias("items"))


@query("t11_list_cap", _unique_all(_MERGED, 2), ("prompts",))
def t11(c: Inputs):
    split = [F.split(n, ",") for n in ("must_terms", "should_terms", "warnings")]
    return c.prompts.select("plan_id", joined(lists.cap(lists.merge(*split), 2)).alias("items"))


# A plain keyword list: elements with a space are phrases, so the SQL quotes them for its tokeniser.
_LIST_AS_TEXT = """select plan_id, 1 as src, prompt as text from prompts union all
  select plan_id, 2, coalesce(string_agg(case when contains(x, ' ') then concat('"', x, '"') else x end, ' ' order by seq), '')
  from (select plan_id, unnest(items) as x, generate_subscripts(items, 1) as seq from (
    select plan_id, string_split({0}, ',') as items from prompts)) where trim(x) <> '' group by plan_id"""


@query("t12_prepared_keywords", token_ctes(_LIST_AS_TEXT.format("concat(must_terms, ',', should_terms)")) + EXPANSION
       + _listing("english", 24), ("prompts",))
def t12(c: Inputs):
    asked = c.prompts.withColumn("keyword_list", F.split(F.concat_ws(",", "must_terms", "should_terms"), ","))
    found = terms.prepare_keywords(asked, c.synonyms)
    return found.select("plan_id", joined("keywords").alias("terms"))


_FOCUS = _LIST_AS_TEXT.format("concat(must_terms, ',', should_terms, ',', replace(replace(keywords, chr(34), ''), ' ', ','))")


@query("t13_focus_terms", token_ctes(_FOCUS) + EXPANSION + _listing("english", 32), ("prompts",))
def t13(c: Inputs):
    return terms.focus_terms(c.plans, c.synonyms).select("plan_id", joined("focus_terms").alias("terms"))


@query("t14_filter_lists", f"""
select m.plan_id, m.items as must, s.items as should, x.items as exclude, 'en' as languages
from ({_unique_all("select plan_id, string_split(must_terms, ',') as items from prompts")}) m
join ({_unique_all("select plan_id, string_split(should_terms, ',') as items from prompts")}) s using (plan_id)
join ({_unique_all("select plan_id, string_split(exclude_terms, ',') as items from prompts")}) x using (plan_id)""",
       ("prompts",))
def t14(c: Inputs):
    parts = terms.filter_lists(F.col("filters"))
    listed = c.plans.select("plan_id", *parts)
    return listed.select("plan_id", *[joined(n).alias(n) for n in ("must", "should", "exclude", "languages")])


_ENTRY = "array<struct<name:string,confidence:double,why:string,flags:array<string>>>"


def _seed_entries():
    """Seed entries of each prompt: its community names with a confidence by position."""
    names = F.filter(F.split("communities", "[, ]+"), lambda x: x != "")
    return F.transform(
        names,
        lambda n, i: F.struct(
            n.alias("name"), (F.lit(1.0) / (i + 1)).alias("confidence"), F.concat(F.lit("why "), n).alias("why"),
            F.when(i % 2 == 0, F.array(F.lit("generic?"))).alias("flags"),
        ),
    ).cast(_ENTRY)


_NAMES = """select plan_id, unnest(items) as name, generate_subscripts(items, 1) as pos from (
  select plan_id, regexp_extract_all(communities, '[^, ]+') as items from prompts)"""
_TAGGED = f"""select plan_id, arg_min(tag, pos) as tag, min(pos) as pos from (
  select plan_id, pos, case when lower(name) like 'r/%' then name
    else concat('r/', regexp_extract(name, '[^/]*$')) end as tag from ({_NAMES})) group by plan_id, lower(tag)"""


@query("t15_seed_keywords", f"""
select p.plan_id, coalesce(n.communities, '') as communities, k.items as keywords, x.items as exclude
from prompts p
left join (select plan_id, string_agg(tag, '|' order by pos) as communities from ({_TAGGED}) group by plan_id) n using (plan_id)
join ({_unique_all("select plan_id, list_concat(string_split(concat(must_terms, ',', should_terms), ','), regexp_extract_all(replace(keywords, '@', ''), '[^ @]+')) as items from prompts".replace("replace(keywords, '@', '')", "replace(keywords, chr(34), '')"))}) k using (plan_id)
join ({_unique_all("select plan_id, string_split(exclude_terms, ',') as items from prompts")}) x using (plan_id)""",
       ("prompts",))
def t15(c: Inputs):
    split = lambda n: F.split(n, ",")
    empty = F.array().cast("array<string>")
    seeds = c.prompts.select(
        "plan_id", _seed_entries().alias("subreddits"), empty.alias("keywords"),
        F.struct(split("must_terms").alias("must_include"), split("should_terms").alias("should_include"),
                 split("exclude_terms").alias("exclude")).alias("filters"),
        F.replace("keywords", F.lit('"'), F.lit("")).alias("user_keywords"),
    )
    found = terms.seed_keywords(seeds)
    return found.select("plan_id", *[joined(n).alias(n) for n in ("communities", "keywords", "exclude")])


# --- planning ----------------------------------------------------------------------------------------

_CURATED_VALUES = ", ".join(
    f"('{w}', {i}, '{n}')" for w, names in fixed.CURATED_COMMUNITIES.items() for i, n in enumerate(names)
)
_PROMPT_WORDS = r"""words as (select plan_id, unnest(items) as word, generate_subscripts(items, 1) as seq from (
  select plan_id, regexp_extract_all(regexp_replace(lower(prompt), '[^a-z0-9\s]', ' ', 'g'), '\S+') as items from prompts)),
""" + f"cur(word, pos, community) as (values {_CURATED_VALUES})"


def _curated(c: Inputs):
    return fixed.community_table(c.spark, fixed.CURATED_COMMUNITIES)


@query("e2_curated_join", f""", {_PROMPT_WORDS}
select plan_id, string_agg(community, '|' order by seq, pos) as communities from (
  select plan_id, arg_min(community, (seq, pos)) as community, min(seq) as seq, arg_min(pos, (seq, pos)) as pos
  from words join cur using (word) group by plan_id, lower(community)) group by plan_id""", ("prompts",))
def e2(c: Inputs):
    return planning.curated_communities(c.prompts, _curated(c)).select("plan_id", joined("curated").alias("communities"))


_FALLBACK_VALUES = ", ".join(
    f"('{stem}', {s}, {i}, '{n}')" for s, (stem, names) in enumerate(fixed.FALLBACK_COMMUNITIES.items())
    for i, n in enumerate(names)
)


@query("e3_fallback_communities", PROMPT_TOKENS + EXPANSION + f""",
pieces as (select plan_id, pos, 0 as cpos, lower(term) as piece from english
  union all select plan_id, pos, generate_subscripts(items, 1), unnest(items) from (
    select plan_id, pos, string_split(lower(term), ' ') as items from english)),
fb(stem, spos, npos, community) as (values {_FALLBACK_VALUES}),
offers as (select plan_id, arg_min(community, (pos, cpos, spos, npos)) as community,
  row_number() over (partition by plan_id order by min((pos, cpos, spos, npos))) as rank
  from pieces join fb on contains(piece, stem) group by plan_id, lower(community))
select p.plan_id, coalesce(string_agg(community, '|' order by rank), '') as communities
from prompts p left join offers o on p.plan_id = o.plan_id and rank <= 8 group by p.plan_id""", ("prompts",))
def e3(c: Inputs):
    lists_ = terms.prompt_terms(c.prompts, c.synonyms)
    return discover.fallback_communities(lists_).select("plan_id", joined("communities").alias("communities"))


_TYPE_CASES = " ".join(
    f"when list_has_any(items, [{_quoted(words)}]) then '{name}'" for name, words in fixed.REPORT_TYPES.items()
)
_TYPE = f"""case when report_type <> 'auto' then report_type {_TYPE_CASES} else '{fixed.DEFAULT_REPORT_TYPE}' end"""
_WITH_ITEMS = r"""select *, regexp_extract_all(regexp_replace(lower(prompt), '[^a-z0-9\s]', ' ', 'g'), '\S+') as items
  from prompts"""


@query("l2_report_type", f"select plan_id, {_TYPE} as report_type from ({_WITH_ITEMS})", ("prompts",))
def l2(c: Inputs):
    return c.prompts.select("plan_id", planning.report_type(F.col("prompt"), F.col("report_type")).alias("report_type"))


_SEED_LIST = r"""seedlist as (select plan_id, arg_min(tag, pos) as tag, min(pos) as pos from (
  select plan_id, concat('r/', regexp_extract(name, '[^/]*$')) as tag, pos from (
    select plan_id, unnest(items) as name, generate_subscripts(items, 1) as pos from (
      select plan_id, regexp_extract_all(communities, '[^,\s]+') as items from prompts))) group by plan_id, lower(tag))"""


@query("l6_community_lists", f""", {_SEED_LIST}
select plan_id, string_agg(tag, '|' order by pos) as communities from (
  select *, row_number() over (partition by plan_id order by pos) as rn from seedlist) where rn <= 8 group by plan_id""",
       ("prompts",))
def l6(c: Inputs):
    parsed = lists.cap(planning.parse_communities(F.col("communities")), 8)
    listed = c.prompts.select("plan_id", parsed.alias("list")).where(F.size("list") > 0)
    return listed.select("plan_id", joined("list").alias("communities"))


_HEURISTIC = f""", {_PROMPT_WORDS}, {_SEED_LIST},
offered as (select plan_id, 1 as src, pos as a, 0 as b, tag from seedlist
  union all select plan_id, 2, seq, pos, community from words join cur using (word)),
picked as (select plan_id, arg_min(tag, (src, a, b)) as tag, row_number() over (
  partition by plan_id order by min((src, a, b))) as rank from offered group by plan_id, lower(tag)),
heur as (select p.plan_id, coalesce(string_agg(tag, '|' order by rank), '') as communities,
  any_value(p.conv) as conv, any_value(p.kind) as report_type
  from (select plan_id, plan_id // 100 as conv, {_TYPE} as kind from ({_WITH_ITEMS})) p
  left join picked k on p.plan_id = k.plan_id and rank <= 8 group by p.plan_id)"""


def _heuristics(c: Inputs):
    asked = c.prompts.withColumn("seeds", planning.parse_communities(F.col("communities")))
    return planning.heuristic_plans(asked, _curated(c))


@query("l1_heuristic_plans", _HEURISTIC + """
select plan_id, communities, report_type, cast(12 as int) as months, cast(20 as int) as min_upvotes,
  cast(1000 as int) as "limit" from heur""", ("prompts",))
def l1(c: Inputs):
    return _heuristics(c).select("plan_id", joined("communities").alias("communities"), "report_type", "params.*")


@query("l3_plan_assembly", _HEURISTIC + """
select plan_id, case when conv % 3 = 0 then concat('r/Prop', conv, '|r/extra') else communities end as communities,
  case when conv % 3 = 0 then 'trend' else report_type end as report_type,
  case when conv % 3 = 0 then cast(6 as int) else cast(12 as int) end as months,
  case when conv % 3 = 0 then 'llm' else 'heuristic' end as rationale from heur""", ("prompts",))
def l3(c: Inputs):
    conv = F.expr("plan_id div 100")
    proposals = c.prompts.where(conv % 3 != 2).select(
        "plan_id",
        F.when(conv % 3 == 0, F.array(F.concat(F.lit("x/Prop"), conv.cast("string")), F.lit("extra"), F.lit("r/EXTRA")))
        .otherwise(F.array().cast("array<string>")).alias("communities"),
        F.struct(F.lit(6).alias("months"), F.lit(5).alias("min_upvotes"), F.lit(50).alias("limit")).alias("params"),
        F.lit("trend").alias("report_type"),
    )
    plans = planning.assemble(_heuristics(c), proposals)
    return plans.select("plan_id", joined("communities").alias("communities"), "report_type", "params.months", "rationale")


@query("l4_keyword_filters", """
select plan_id, keywords <> '' as has_filters, nullif(replace(replace(keywords, chr(34), ''), ' ', '|'), '') as keywords from prompts""",
       ("prompts",))
def l4(c: Inputs):
    block = planning.keyword_filters(F.col("filters.keywords"))
    return c.plans.select("plan_id", block.isNotNull().alias("has_filters"), joined(block["keywords"]).alias("keywords"))


@query("l5_seed_merge", f"""
select p.plan_id, case when p.warnings <> '' then replace(p.warnings, ',', '|') else coalesce(u.items, '') end as warnings
from prompts p left join ({_unique("select plan_id, string_split(seed_warnings, ',') as items from prompts")}) u
  on p.plan_id = u.plan_id""", ("prompts",))
def l5(c: Inputs):
    own = F.when(F.size("warnings") > 0, F.col("warnings"))
    merged = planning.seed_defaults(own, F.col("seed_warnings"))
    return c.plans.select("plan_id", joined(merged).alias("warnings"))


_CAND = r"""cand as (select plan_id, pos, community, concat('r/', regexp_extract(community, '[^/]*$')) as tag from (
  select plan_id, unnest(items) as community, generate_subscripts(items, 1) - 1 as pos from (
    select plan_id, regexp_extract_all(communities, '[^, ]+') as items from prompts)) where pos < 8)"""
_VET = f""", {_CAND},
good as (select plan_id, string_agg(p.community, '|' order by pos) as good from cand c join profiles p
  on lower(replace(c.community, 'r/', '')) = lower(replace(p.community, 'r/', ''))
  where not coalesce(over18, false) and coalesce(subscribers, 0) >= 10000 group by plan_id),
clean as (select plan_id, string_agg(tag, '|' order by pos) as clean from (
  select plan_id, arg_min(tag, pos) as tag, min(pos) as pos from cand
  where tag not in ({_quoted(fixed.VETTING_BLOCKLIST)}) group by plan_id, lower(tag)) group by plan_id),
vetted as (select plan_id, coalesce(good, clean, '') as vetted from (select plan_id from prompts)
  left join good using (plan_id) left join clean using (plan_id))"""


def _vetted(c: Inputs):
    blocked = fixed.inline_table(c.spark, "community", [(n,) for n in fixed.VETTING_BLOCKLIST])
    return planning.vet(c.plans, c.profiles, blocked)


@query("l7_vet_communities", _VET + " select plan_id, vetted as communities from vetted", ("prompts", "profiles"))
def l7(c: Inputs):
    return _vetted(c).select("plan_id", joined("vetted").alias("communities"))


@query("l8_patch_plans", _VET + r"""
select plan_id, case when vetted <> '' then vetted
  else array_to_string(regexp_extract_all(communities, '[^, ]+'), '|') end as communities
from vetted join prompts using (plan_id)""", ("prompts", "profiles"))
def l8(c: Inputs):
    return planning.patch(c.plans, _vetted(c)).select("plan_id", joined("communities").alias("communities"))


@query("g6_ordered_unique_communities", f""", {_CAND}
select plan_id, community from (select plan_id, arg_min(tag, pos) as community,
  row_number() over (partition by plan_id order by min(pos)) as rn from cand group by plan_id, lower(tag)) where rn <= 3""",
       ("prompts",))
def g6(c: Inputs):
    tagged = planning.with_candidates(c.plans).withColumn("community", t.community_tag(F.col("community")))
    return planning.ordered_unique(tagged, 3).select("plan_id", "community")


@query("h4_cap_before_vetting", f", {_CAND} select plan_id, cast(pos as int) as pos, community from cand", ("prompts",))
def h4(c: Inputs):
    return planning.with_candidates(c.plans)


@query("e8_profile_join", f""", {_CAND}
select plan_id, tag, over18, subscribers from cand left join profiles p on tag = p.community""", ("prompts", "profiles"))
def e8(c: Inputs):
    tagged = planning.with_candidates(c.plans).select("plan_id", t.community_tag(F.col("community")).alias("tag"))
    return tagged.join(c.profiles, tagged.tag == c.profiles.community, "left").select(
        "plan_id", "tag", "over18", F.col("subscribers").cast("long").alias("subscribers")
    )


@query("b20_seed_metadata", f"""
select plan_id, name, 1.0::double / pos as confidence, concat('why ', name) as why,
  case when pos % 2 = 1 then 'generic?' else '' end as flags from ({_NAMES})""", ("prompts",))
def b20(c: Inputs):
    entries = planning.seed_metadata(_seed_entries())
    listed = c.prompts.select("plan_id", F.explode(entries).alias("e")).select("plan_id", "e.*")
    return listed.withColumn("flags", joined("flags"))


# --- notes -------------------------------------------------------------------------------------------

_NOTE = """concat(case when theme = '' then 'theme' else theme end, ' (audience: -; pains: ',
  case when pains = '' then '-' else array_to_string(string_split(pains, ',')[1:3], ', ') end, '; outcomes: ',
  coalesce(nullif(array_to_string(list_filter(string_split(must_terms, ','), lambda x: x <> '')[1:2], ', '), ''), '-'), ')')"""


@query("b15_theme_notes", f"""
select plan_id, case when pains = '' then '(none)' else concat({_NOTE}, ' | ', {_NOTE}) end as notes from prompts""",
       ("prompts",))
def b15(c: Inputs):
    return c.plans.select("plan_id", evidence.theme_notes(F.col("topic_themes")).alias("notes"))


@query("b16_warning_notes", f"""
select p.plan_id, coalesce(replace(u.items, '|', '; '), '(none)') as notes from prompts p left join (
  {_unique("select plan_id, string_split(case when warnings <> '' then warnings else seed_warnings end, ',') as items from prompts")}
) u on p.plan_id = u.plan_id""", ("prompts",))
def b16(c: Inputs):
    return c.plans.select("plan_id", evidence.warning_notes(F.col("warnings"), F.col("seed_warnings")).alias("notes"))


@query("b17_coverage_note", f"""
select id, case when num_comments % 4 = 0 then '{fixed.COVERAGE_EMPTY}' when upvotes % 8 = 0 then '{fixed.COVERAGE_NONE}'
  when upvotes % 8 < 5 then '{fixed.COVERAGE_THIN}' else '{fixed.COVERAGE_GOOD}' end as note from posts""")
def b17(c: Inputs):
    return c.posts.select("id", evidence.coverage_note(F.col("upvotes") % 8, F.col("num_comments") % 4).alias("note"))


@query("b18_sample_line", """
select id, concat(case when upvotes % 3 = 0 then concat('- ', title) else concat('- [', title, '](', url, ')') end,
  case when num_comments % 5 = 0 then '' else printf(' (pain %.2f)', cast(upvotes as double) / 8) end) as line from posts""")
def b18(c: Inputs):
    url = F.when(F.col("upvotes") % 3 != 0, F.col("url"))
    pain = F.when(F.col("num_comments") % 5 != 0, F.col("upvotes").cast("double") / 8)
    return c.posts.select("id", evidence.sample_line(F.col("title"), url, pain).alias("line"))


@query("b19_planning_context", r"""
select plan_id, concat('Prompt: ', prompt, chr(10), 'Report type hint: ', report_type, chr(10), 'Max subreddits: 8', chr(10),
  'Defaults: months=12, min_upvotes=20, limit=1000', chr(10), 'Candidate subreddits from search: ',
  coalesce(nullif(array_to_string(regexp_extract_all(communities, '[^, ]+'), ', '), ''), '(none)')) as context
from prompts""", ("prompts",))
def b19(c: Inputs):
    asked = c.plans.withColumn("seed_communities", F.col("communities"))
    return evidence.planning_context(asked)


@query("b21_report_header", r"""
select plan_id, array_to_string(regexp_extract_all(communities, '[^, ]+'), ', ') as communities,
  'months=1, min_upvotes=20, limit=100' as params, coalesce(nullif(replace(keywords, chr(34), ''), ''), '—') as keywords, report_type
from prompts""", ("prompts",))
def b21(c: Inputs):
    return evidence.report_header(c.plans)
