"""Selection, discovery, evidence, coverage, sentiment, features and summaries over posts."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.inputs import AS_OF, SEARCH_PLANS, SEARCH_PROMPTS, SINCE, STOP, Inputs
from checks.registry import query
from checks.term_queries import EXPANSION, token_ctes
from checks.text_queries import _ENGLISH, _POST_SQL, TEXT, _quoted
from postlens import fixed_values as fixed
from postlens import schemas
from postlens.config import recovery_point, shared_folder, written
from postlens.functions import match
from postlens.functions import text as t
from postlens.operators import cluster, coverage, discover, evidence, features, select, sentiment, summarise, termjoin, terms
from postlens.operators.topn import first_per_key, top_n
from postlens.plans import flows
from postlens.sources import readers, writers
from postlens.sources.posts import newest_first, to_posts
from postlens.streaming import ingest

# --- search with fixed arguments ---------------------------------------------------------------------

_NAMES = [f"r/src{i}" for i in range(0, 20, 2)]


@query("a7_search_by_community", f"""
select id, community, upvotes from (
  select id, concat('r/', subreddit) as community, cast(coalesce(score, 0) as int) as upvotes,
    row_number() over (partition by subreddit order by created_utc desc, id) as rn
  from raw where created_utc > {SINCE} and concat('r/', subreddit) in ({_quoted(_NAMES)})) where rn <= 20 and upvotes >= 50""",
       ("raw",))
def a7(c: Inputs):
    return select.search_communities(c.raw, _NAMES, SINCE, 20, 50).select("id", "community", "upvotes")


_TERMS = ["trash", "export", "log in"]
_ANY = " or ".join(f"contains(lower(concat(title, ' ', selftext)), '{w}')" for w in _TERMS)


@query("a8_search_by_keywords", f"""
select id, community, upvotes from (
  select id, concat('r/', subreddit) as community, cast(coalesce(score, 0) as int) as upvotes
  from raw where created_utc > {SINCE} and ({_ANY}) order by created_utc desc, id limit 300) where upvotes >= 50""",
       ("raw",))
def a8(c: Inputs):
    return select.search_keywords(c.raw, _TERMS, SINCE, 300, 50).select("id", "community", "upvotes")


@query("g3_newest_per_community", """
select community, id, rn::int as rank from (select community, id,
  row_number() over (partition by community order by created_utc desc, id) as rn from posts) where rn <= 60""")
def g3(c: Inputs):
    narrow = c.posts.select("community", "id", "created_utc")
    return top_n(narrow, ["community"], select.newest(), 60, salt_on="id").select("community", "id", "rank")


@query("h1_newest_first", "select id, created_utc from posts order by created_utc desc, id")
def h1(c: Inputs):
    return newest_first(c.posts.select("id", "created_utc"))


@query("g1_first_per_id", """
select id, created_utc, num_comments, left(selftext, 6) = 'again ' as again from (
  select *, row_number() over (partition by id order by created_utc desc) as rn from raw) where rn = 1""", ("raw",))
def g1(c: Inputs):
    narrow = c.raw.select("id", "created_utc", "num_comments", F.col("selftext").startswith("again ").alias("again"))
    return first_per_key(narrow, ["id"], [-F.col("created_utc")])


@query("i2_distinct_by_key", """
select community, arg_max(id, (upvotes, id)) as id, max(upvotes) as upvotes from posts group by community""")
def i2(c: Inputs):
    last = F.struct("upvotes", "id")
    best = c.posts.groupBy("community").agg(F.max(last).alias("best"))
    return best.select("community", "best.id", "best.upvotes")


# --- search for a table of plans ---------------------------------------------------------------------

def _rows(rows) -> str:
    """Literal rows; whole numbers are 64-bit, as plan ids are."""

    def literal(v) -> str:
        return _quoted([v]) if isinstance(v, str) else f"{v}::bigint"

    return ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)


_SEARCHES_OF_PLANS = """
items as (select *, lower(concat(title, ' ', selftext)) as low from raw),
pass1 as (select * from (
  select p.plan_id, 1 as pass_no, cpos, r.*, p.min_upvotes, p.lim,
    row_number() over (partition by p.plan_id, cpos order by created_utc desc, id) as rn
  from items r join asked a using (subreddit) join plans p on p.plan_id = a.plan_id and created_utc > since)
  where rn <= lim and coalesce(score, 0) >= min_upvotes),
pass2 as (select * from (
  select p.plan_id, 2 as pass_no, 0 as cpos, r.*, p.min_upvotes, p.lim,
    row_number() over (partition by p.plan_id order by created_utc desc, id) as rn
  from items r join plans p on created_utc > since
  where exists (select 1 from kw where kw.plan_id = p.plan_id and contains(low, kw.term)))
  where rn <= lim and coalesce(score, 0) >= min_upvotes),
both_passes as (select * from pass1 union all select * from pass2),
uniq as (select * from (select *, row_number() over (partition by plan_id, id
  order by pass_no, cpos, created_utc desc, selftext) as first from both_passes) where first = 1),
judged as (select u.*, exists (select 1 from ex where ex.plan_id = u.plan_id and contains(low, ex.term)) as excluded,
  not exists (select 1 from kw where kw.plan_id = u.plan_id)
    or exists (select 1 from kw where kw.plan_id = u.plan_id and contains(low, kw.term)) as included from uniq u)"""
_SELECTION = f"""
, plans(plan_id, since, min_upvotes, lim) as (values {_rows(
    (p, AS_OF - m * fixed.SECONDS_PER_MONTH, u, n) for p, _, _, _, m, u, n in SEARCH_PLANS)}),
asked(plan_id, cpos, subreddit) as (values {_rows(
    (p, i, name.replace('r/', '')) for p, names, *_ in SEARCH_PLANS for i, name in enumerate(names))}),
kw(plan_id, term) as (values {_rows((p, k.lower()) for p, _, ks, *_ in SEARCH_PLANS for k in ks)}),
ex(plan_id, term) as (values {_rows((p, k.lower()) for p, _, _, xs, *_ in SEARCH_PLANS for k in xs)}),
""" + _SEARCHES_OF_PLANS
_ALL_SELECTION = f"""
, plans as (select plan_id, {SINCE} as since, 20 as min_upvotes, 40 as lim from prompts),
asked as (select plan_id, i - 1 as cpos, replace(name, 'r/', '') as subreddit from (
  select plan_id, unnest(c) as name, generate_subscripts(c, 1) as i from (
    select plan_id, regexp_extract_all(communities, '[^, ]+') as c from prompts))),
kw as (select distinct plan_id, lower(trim(t)) as term from (
  select plan_id, unnest(string_split(concat(must_terms, ',', should_terms), ',')) as t from prompts) where trim(t) <> ''),
ex as (select distinct plan_id, lower(trim(t)) as term from (
  select plan_id, unnest(string_split(exclude_terms, ',')) as t from prompts) where trim(t) <> ''),
""" + _SEARCHES_OF_PLANS


@query("e5_posts_of_plan_communities", _SELECTION + " select plan_id, id, subreddit, created_utc from pass1", ("raw",))
def e5(c: Inputs):
    found = select.community_pass(c.raw, select.Searches.of(c.search_plans, AS_OF))
    return found.select(
        "plan_id", "id", F.replace("community", F.lit("r/"), F.lit("")).alias("subreddit"),
        F.col("created_utc").cast("double").alias("created_utc"),
    )


@query("e5_communities_of_bucketed_table", _ALL_SELECTION + " select plan_id, id, subreddit, created_utc from pass1", ("raw", "prompts"))
def e5_bucketed(c: Inputs):
    """The communities of a plan for every prompt, joined with a table in buckets: its rows are not shuffled for that."""
    name = f"raw_{uuid4().hex}"
    writers.write_bucketed_table(c.raw, name, _folder(c, "buckets"), buckets=16, slices=4)
    searches = select.Searches.of(c.all_search_plans, AS_OF)
    found = select.community_pass(readers.read_table(c.spark, name), searches, slices=4, max_broadcast=0)
    return found.select(
        "plan_id", "id", F.replace("community", F.lit("r/"), F.lit("")).alias("subreddit"),
        F.col("created_utc").cast("double").alias("created_utc"),
    )


@query("i1_union_of_passes", _SELECTION + """
select plan_id, pass_no::int as pass_no, id, cast(created_utc as bigint) as created_utc from both_passes""", ("raw",))
def i1(c: Inputs):
    both = select.both_passes(c.raw, select.Searches.of(c.search_plans, AS_OF), c.synonyms)
    return both.select("plan_id", "pass_no", "id", "created_utc")


@query("select_posts", _SELECTION + """
select plan_id, id, concat('r/', subreddit) as community, cast(created_utc as bigint) as created_utc,
  cast(coalesce(score, 0) as int) as upvotes,
  case pass_no when 1 then 'community_search' else 'keyword_search' end as source
from judged where included and not excluded""", ("raw",))
def select_posts(c: Inputs):
    found = select.select_posts(c.raw, c.search_plans, c.synonyms, AS_OF)
    return found.select("plan_id", "id", "community", "created_utc", "upvotes", "source")


@query("select_posts_all_prompts", _ALL_SELECTION + """
select plan_id, id, concat('r/', subreddit) as community, cast(created_utc as bigint) as created_utc,
  cast(coalesce(score, 0) as int) as upvotes,
  case pass_no when 1 then 'community_search' else 'keyword_search' end as source
from judged where included and not excluded""", ("raw", "prompts"))
def select_posts_all(c: Inputs):
    """The posts of a plan for every prompt of the table, all at once."""
    found = select.select_posts(c.raw, c.all_search_plans, c.synonyms, AS_OF)
    return found.select("plan_id", "id", "community", "created_utc", "upvotes", "source")


@query("select_posts_of_stored_table", _SELECTION + """
select plan_id, id, concat('r/', subreddit) as community, cast(created_utc as bigint) as created_utc,
  md5(trim(regexp_replace(selftext, '\\s+', ' ', 'g'))) as text, cast(coalesce(score, 0) as int) as upvotes
from judged where included and not excluded""", ("raw",))
def select_posts_stored(c: Inputs):
    """The same from a stored table with a folder per month: rows are ranked by where they are, texts fetched last."""
    folder = _folder(c, "raw")
    writers.write_raw_table(c.raw, folder)
    found = select.select_posts(readers.read_parquet(c.spark, folder), c.search_plans, c.synonyms, AS_OF)
    return found.select("plan_id", "id", "community", "created_utc", "upvotes", F.md5("selftext").alias("text"))


@query("f7_funnel", _SELECTION + """
select plan_id, a.community_rows, a.keyword_rows, b.unique_rows, b.excluded_rows, b.kept_rows from (
  select plan_id, count(*) filter (pass_no = 1) as community_rows, count(*) filter (pass_no = 2) as keyword_rows
  from both_passes group by plan_id) a join (
  select plan_id, count(*) as unique_rows, count(*) filter (excluded) as excluded_rows,
    count(*) filter (included and not excluded) as kept_rows from judged group by plan_id) b using (plan_id)""", ("raw",))
def f7(c: Inputs):
    return select.selection_funnel(c.raw, c.search_plans, c.synonyms, AS_OF)


# --- many term lists ---------------------------------------------------------------------------------

_LONG_WORDS = r"""terms as (select distinct item_id, unnest(regexp_extract_all(lower(text), '[a-z]{9,}')) as term from benchmark)"""


@query("e4_terms_of_many_lists", f""", {_LONG_WORDS}
select item_id, count(distinct id) as posts from posts join terms
  on contains(lower(concat(title, ' ', selftext)), term) group by item_id""")
def e4(c: Inputs):
    words = c.table("benchmark").select(
        "item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), F.lit(0))).alias("term")
    )
    posts = c.posts.select("id", t.match_text(F.col("title"), F.col("selftext")).alias("text"))
    found = termjoin.group_posts(posts, words, "item_id", ["id"])
    return found.groupBy("item_id").agg(F.count("*").alias("posts"))


_EXCLUDED = ["trash", "stupid", "export"]


@query("e6_posts_without_terms", f"""
, bad(term) as (values {_rows((w,) for w in _EXCLUDED)})
select id from posts where not exists (select 1 from bad where contains(lower(concat(title, ' ', selftext)), term))""")
def e6(c: Inputs):
    text = t.match_text(F.col("title"), F.col("selftext"))
    return c.posts.where(match.exclude_filter(text, _EXCLUDED)).select("id")


# --- discovery ---------------------------------------------------------------------------------------

_SEARCH_PROMPTS = f", prompts(plan_id, prompt, keywords, report_type) as (values {_rows(SEARCH_PROMPTS)})"
_DEPTH = 800
_FOUND = token_ctes(
    "select plan_id, 1 as src, prompt as text from prompts union all select plan_id, 2, keywords from prompts"
) + EXPANSION + f""",
wanted as (select plan_id, strategy, replace(unnest(string_split(q, ' OR ')), '"', '') as term from searches),
found as (select plan_id, strategy, id, community, row_number() over (
    partition by plan_id, strategy order by created_utc desc, id) as rn
  from (select distinct plan_id, strategy, id, community, created_utc from posts join wanted
    on contains(lower(concat(title, ' ', selftext)), lower(term)) where created_utc > {SINCE})),
counts as (select plan_id, community, n from (
  select plan_id, strategy, community, count(*) as n, min(strategy) over (partition by plan_id) as first
  from found where rn <= {_DEPTH} group by plan_id, strategy, community) where strategy = first),
ranked as (select plan_id, community, row_number() over (partition by plan_id order by rank) as pos from (
  select plan_id, community, row_number() over (partition by plan_id order by n desc, community) as rank from counts)
  where rank <= 64 and lower(community) not in ({_quoted(fixed.DISCOVERY_BLOCKLIST)}))"""


@query("f1_community_counts", _SEARCH_PROMPTS + _FOUND + " select plan_id, community, n from counts")
def f1(c: Inputs):
    lists = terms.prompt_terms(c.search_prompts, c.synonyms)
    return discover.strategy_counts(c.posts, terms.strategy_terms(lists), SINCE, _DEPTH)


def _folded(sql: str) -> str:
    """SQL that matches sharp s as two letters, as the library does; the prompts of the table have such words."""
    sql = sql.replace("contains(lower(concat(title, ' ', selftext)), lower(term))",
                      "contains(replace(lower(concat(title, ' ', selftext)), 'ß', 'ss'), replace(lower(term), 'ß', 'ss'))")
    sql = sql.replace("contains(lower(concat(title, ' ', selftext)), lower(w.term))",
                      "contains(replace(lower(concat(title, ' ', selftext)), 'ß', 'ss'), replace(lower(w.term), 'ß', 'ss'))")
    return sql.replace("contains(lower(text), f.term)", "contains(replace(lower(text), 'ß', 'ss'), replace(f.term, 'ß', 'ss'))")


@query("f1_community_counts_all_prompts", _folded(_FOUND) + " select plan_id, community, n from counts", ("posts", "prompts"))
def f1_all(c: Inputs):
    """The same for every prompt of the table: too many terms and prompts to be literals."""
    lists = terms.prompt_terms(c.prompts, c.synonyms)
    return discover.strategy_counts(c.posts, terms.strategy_terms(lists), SINCE, _DEPTH)


@query("h2_most_common_communities", """
select community, n from (select community, count(*) as n from posts group by community)
order by n desc, community limit 64""")
def h2(c: Inputs):
    counts = discover.community_counts(c.posts)
    return counts.orderBy(F.desc("n"), "community").limit(discover.MOST_COMMON)


_FALLBACK_VALUES = ", ".join(
    f"('{stem}', {s}, {i}, '{n}')" for s, (stem, names) in enumerate(fixed.FALLBACK_COMMUNITIES.items())
    for i, n in enumerate(names)
)


_DISCOVERY = f""",
pieces as (select plan_id, pos, 0 as cpos, lower(term) as piece from english
  union all select plan_id, pos, generate_subscripts(items, 1), unnest(items) from (
    select plan_id, pos, string_split(lower(term), ' ') as items from english)),
fb(stem, spos, npos, community) as (values {_FALLBACK_VALUES}),
offers as (select plan_id, arg_min(community, (pos, cpos, spos, npos)) as community,
  row_number() over (partition by plan_id order by min((pos, cpos, spos, npos))) as pos
  from pieces join fb on contains(piece, stem) group by plan_id, lower(community)),
chosen as (select plan_id, pos, community from ranked where pos <= 8 union all
  select plan_id, pos, community from offers where pos <= 8 and plan_id not in (select plan_id from counts))
select p.plan_id, coalesce(string_agg(community, '|' order by pos), '') as communities
from prompts p left join chosen c on p.plan_id = c.plan_id group by p.plan_id"""


@query("f2_discover", _SEARCH_PROMPTS + _FOUND + _DISCOVERY)
def f2(c: Inputs):
    found = discover.discover(c.search_prompts, c.posts, c.synonyms, AS_OF, months=1)
    return found.select("plan_id", F.array_join("communities", "|").alias("communities"))


@query("f2_discover_all_prompts", _folded(_FOUND + _DISCOVERY), ("posts", "prompts"))
def f2_all(c: Inputs):
    found = discover.discover(c.prompts, c.posts, c.synonyms, AS_OF, months=1)
    return found.select("plan_id", F.array_join("communities", "|").alias("communities"))


# --- sentiment ---------------------------------------------------------------------------------------

_LEX = ", ".join(f"('{w}', {v}::double)" for w, v in fixed.SEED_LEXICON.items())
_WORD = r"[\p{L}\p{N}]+(?:''[\p{L}\p{N}]+)*"
_PLAIN = f"""
, lex(token, valence) as (values {_LEX}),
ready as (select *, {TEXT} as text from posts where length({TEXT}) > 20 and {_ENGLISH}),
hits as (select id, unnest(regexp_extract_all(lower(text), '{_WORD}')) as token from ready),
sums as (select id, sum(valence) as s from hits join lex using (token) group by id),
scored as (select r.*, round(coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15), 4) as sentiment
  from ready r left join sums using (id)),
pained as (select *, round(greatest(0.0, -sentiment) * (1 + ln(1 + upvotes + num_comments)), 3) as pain_score from scored)"""


@query("k1_lexicon_sentiment", _PLAIN + " select id, sentiment, pain_score from pained")
def k1(c: Inputs):
    return sentiment.scored(c.posts, c.lexicon, rules=False).select("id", "sentiment", "pain_score")


@query("e7_lexicon_join", _PLAIN + " select token, count(*) as n from hits join lex using (token) group by token")
def e7(c: Inputs):
    words = sentiment.prepared(c.posts).select(F.explode(t.words(F.lower("text"))).alias("token"))
    return words.join(c.lexicon, "token").groupBy("token").agg(F.count("*").alias("n"))


def _rule_ctes() -> str:
    boosters = [(w, fixed.BOOST) for w in fixed.AMPLIFIERS] + [(w, -fixed.BOOST) for w in fixed.DAMPENERS]
    boost_rows = ", ".join(f"('{w}', {b}::double)" for w, b in boosters)

    def look_back(d: int) -> str:
        """The value after the word ``d`` places back; v is the value so far."""
        cap = f"case when c{d} and mixed then case when v > 0 then {fixed.CAPITALS_BOOST} else -{fixed.CAPITALS_BOOST} end else 0 end"
        step = f"case when b{d} is not null then b{d} * (case when v < 0 then -1 else 1 end) + {cap} else 0 end"
        return (f"case when w{d} is null or l{d} is not null then v else "
                f"(v + ({step}) * {fixed.BOOST_DECAY[d - 1]}::double) * (case when n{d} then {fixed.NEGATION_FACTOR} else 1 end) end")

    lags = ", ".join(
        f"lag({c}, {d}) over w as {a}{d}" for d in (1, 2, 3)
        for c, a in (("low", "w"), ("valence", "l"), ("step", "b"), ("negates", "n"), ("capital", "c"))
    )
    keep = ", ".join(f"{a}{d}" for d in (1, 2, 3) for a in "wlbnc")
    return f"""
, lex(token, valence) as (values {_LEX}),
boost(token, step) as (values {boost_rows}),
ready as (select *, {TEXT} as text from posts where length({TEXT}) > 20 and {_ENGLISH}),
spoken as (select id, unnest(items) as word, generate_subscripts(items, 1) as pos from (
  select id, regexp_extract_all(text, '{_WORD}') as items from ready)),
marked as (select s.*, lower(word) as low, valence, step, lower(word) in ({_quoted(fixed.NEGATIONS)}) as negates,
  upper(word) = word and lower(word) <> word as capital
  from spoken s left join lex on lex.token = lower(word) left join boost on boost.token = lower(word)),
about as (select id, bool_or(capital) and bool_or(not capital) as mixed,
  coalesce(min(pos) filter (low = 'but'), 0) as but from marked group by id),
lagged as (select *, {lags} from marked window w as (partition by id order by pos)),
base as (select id, pos, but, mixed, {keep}, valence + case when capital and mixed then
    case when valence > 0 then {fixed.CAPITALS_BOOST} else -{fixed.CAPITALS_BOOST} end else 0 end as v
  from lagged join about using (id) where valence is not null and step is null),
back1 as (select * replace ({look_back(1)} as v) from base),
back2 as (select * replace ({look_back(2)} as v) from back1),
back3 as (select * replace ({look_back(3)} as v) from back2),
sums as (select id, sum(v * case when but = 0 or pos = but then 1 when pos < but then {fixed.BEFORE_BUT}
  else {fixed.AFTER_BUT} end) as s from back3 group by id),
stressed as (select r.id, coalesce(s, 0) as s,
  least(length(text) - length(replace(text, '!', '')), {fixed.EXCLAMATION_CAP}) * {fixed.EXCLAMATION_BOOST}
  + case when q <= 1 then 0 when q <= 3 then q * {fixed.QUESTION_BOOST} else {fixed.QUESTION_CAP_SCORE} end as extra
  from (select *, length(text) - length(replace(text, '?', '')) as q from ready) r left join sums using (id)),
totals as (select id, (s + case when s > 0 then extra when s < 0 then -extra else 0 end)::double as s from stressed)"""


@query("k2_rule_sentiment", _rule_ctes() + """
select id, round(s / sqrt(s * s + 15), 4) as sentiment from totals""")
def k2(c: Inputs):
    ready = sentiment.prepared(c.posts)
    return sentiment.with_sentiment(ready, c.lexicon).select("id", "sentiment")


# --- groups ------------------------------------------------------------------------------------------

def _pained(c: Inputs):
    return sentiment.scored(c.posts, c.lexicon, rules=False)


@query("g2_painful_posts", _PLAIN + """
select community, id, title, upvotes, num_comments, pain_score, rank::int as rank from (
  select *, row_number() over (partition by community order by pain_score desc, id) as rank from pained) where rank <= 5""")
def g2(c: Inputs):
    best = summarise.top_posts(_pained(c), "community")
    return best.select("community", "id", "title", "upvotes", "num_comments", "pain_score", "rank")


@query("f3_group_sizes", _PLAIN + """
select community, count(*) as size, round(avg(pain_score), 6) as avg_pain from pained group by community""")
def f3(c: Inputs):
    return summarise.sizes(_pained(c), "community").withColumn("avg_pain", F.round("avg_pain", 6))


@query("f4_mean_sentiment", _PLAIN + " select round(coalesce(avg(sentiment), 0), 6) as avg_sentiment from pained")
def f4(c: Inputs):
    return evidence.mean_sentiment(_pained(c)).select(F.round("avg_sentiment", 6).alias("avg_sentiment"))


_GAP_ALL = " union all ".join(
    f"""select community, nth, {i} as pno, generate_subscripts(f, 1) as m, trim(unnest(f)) as gap from (
      select community, nth, regexp_extract_all(low, '{p.replace("'", "''")}') as f from heads)"""
    for i, p in enumerate(fixed.COMPLAINT_PATTERNS)
)
_GAPS = f""", heads as (select community, nth, low from (select community, lower({TEXT}) as low,
    row_number() over (partition by community order by created_utc desc, id) as nth from posts) where nth <= 500),
phrases as (select * from (select *, row_number() over (partition by community, nth order by pno, m) as k
  from ({_GAP_ALL})) where k <= 5)"""


@query("f6_gap_examples", _GAPS + """
select community, pos::int as pos, gap from (select community, gap, row_number() over (
  partition by community order by min((nth, k))) as pos from phrases group by community, gap) where pos <= 10""")
def f6(c: Inputs):
    posts = c.posts.withColumn("text", t.analysis_text(F.col("title"), F.col("selftext")))
    return summarise.gap_examples(posts, "community")


@query("g4_first_posts_per_group", """
select community, count(*) as n, min(created_utc) as oldest from (select *, row_number() over (
  partition by community order by created_utc desc, id) as rn from posts) where rn <= 500 group by community""")
def g4(c: Inputs):
    narrow = c.posts.select("community", "id", "created_utc")
    first = top_n(narrow, ["community"], select.newest(), summarise.POSTS_READ_FOR_GAPS, salt_on="id")
    return first.groupBy("community").agg(F.count("*").alias("n"), F.min("created_utc").alias("oldest"))


# --- evidence ----------------------------------------------------------------------------------------

_MATCHING = token_ctes("""
  select plan_id, 1 as src, prompt as text from prompts
  union all select plan_id, 2, replace(keywords, '"', '') from prompts""") + EXPANSION + """,
focus as (select plan_id, lower(term) as term from english where pos <= 32),
matched as (select plan_id, id, title, url, pain_score from prompts p, pained x
  where exists (select 1 from focus f where f.plan_id = p.plan_id and contains(lower(text), f.term))),
counted as (select p.plan_id, count(m.id) as matched, (select count(*) from pained) as total
  from prompts p left join matched m on p.plan_id = m.plan_id group by p.plan_id)"""
_EVIDENCE = _PLAIN + _SEARCH_PROMPTS + _MATCHING


def _matches(c: Inputs):
    return evidence.matches(_pained(c), terms.focus_terms(c.evidence_plans, c.synonyms))


@query("c9_evidence_match", _EVIDENCE + " select plan_id, id, pain_score from matched")
def c9(c: Inputs):
    return _matches(c).rows().select("plan_id", "id", "pain_score")


@query("f5_matched_and_total", _EVIDENCE + " select plan_id, matched, total from counted")
def f5(c: Inputs):
    return evidence.counted(_matches(c), _pained(c), c.evidence_plans)


@query("f5_matched_and_total_all_prompts", _PLAIN + _folded(_MATCHING) + " select plan_id, matched, total from counted",
       ("posts", "prompts"))
def f5_all(c: Inputs):
    plans = c.evidence_plans_of(c.prompts)
    return evidence.counted(evidence.matches(_pained(c), terms.focus_terms(plans, c.synonyms)), _pained(c), plans)


_LINES = """,
sampled as (select plan_id, id, title, url, pain_score from matched union all
  select plan_id, id, title, url, pain_score from counted, pained where matched = 0),
best as (select *, row_number() over (partition by plan_id order by pain_score desc, id) as rank from sampled),
lines as (select plan_id, string_agg(concat('- [', title, '](', url, ') (pain ', printf('%.2f', pain_score), ')'), chr(10)
  order by rank) as lines from best where rank <= 8 group by plan_id)"""


@query("h3_sample_posts", _EVIDENCE + _LINES + " select plan_id, lines from lines")
def h3(c: Inputs):
    found = evidence.samples(_matches(c), _pained(c), c.evidence_plans)
    return found.select("plan_id", F.array_join("lines", "\n").alias("lines"))


_NOTE = f"""case when total = 0 then '{fixed.COVERAGE_EMPTY}' when matched = 0 then '{fixed.COVERAGE_NONE}'
  when matched < 5 then '{fixed.COVERAGE_THIN}' else '{fixed.COVERAGE_GOOD}' end"""


@query("e9_evidence_rows", _EVIDENCE + _LINES + f"""
select plan_id, matched, total, {_NOTE} as coverage_note, lines from counted join lines using (plan_id)""")
def e9(c: Inputs):
    rows = evidence.evidence(recovery_point(_pained(c)), c.evidence_plans, c.synonyms)
    return rows.drop("context").withColumn("lines", F.array_join("lines", "\n"))


@query("e9_evidence_rows_all_prompts", _PLAIN + _folded(_MATCHING) + _LINES + f"""
select plan_id, matched, total, {_NOTE} as coverage_note, lines from counted join lines using (plan_id)""", ("posts", "prompts"))
def e9_all(c: Inputs):
    rows = evidence.evidence(written(_pained(c), "scored"), c.evidence_plans_of(c.prompts), c.synonyms)
    return rows.drop("context").withColumn("lines", F.array_join("lines", "\n"))


@query("b19_evidence_context", _EVIDENCE + _LINES + f""",
musts as (select plan_id, string_agg(x, ', ' order by i) as must from (
  select plan_id, arg_min(x, i) as x, min(i) as i from (select plan_id, unnest(k) as x, generate_subscripts(k, 1) as i from (
    select plan_id, string_split(replace(keywords, '"', ''), ' ') as k from prompts)) where x <> '' group by plan_id, lower(x))
  group by plan_id),
focused as (select plan_id, string_agg(term, ', ' order by pos) as terms from english where pos <= 32 group by plan_id)
select p.plan_id, concat('Context:', chr(10), '- User prompt: ', prompt, chr(10), '- Report type: ', report_type, chr(10),
  '- Subreddits: r/src1, r/src2', chr(10), '- Params: months=1, min_upvotes=20, limit=100', chr(10),
  '- Seed filters -> must: ', coalesce(must, '(none)'), '; should: (none); exclude: (none); languages: (none)', chr(10),
  '- Keyword focus terms: ', coalesce(terms, '(none)'), chr(10), '- Topic themes: (none)', chr(10), '- Warnings: (none)', chr(10),
  '- Matched posts: ', matched, '/', total, chr(10), '- Data coverage: ', {_NOTE}, chr(10), '- Sample posts:', chr(10),
  lines) as context
from prompts p join counted using (plan_id) join lines using (plan_id) left join musts using (plan_id)
left join focused using (plan_id)""")
def b19(c: Inputs):
    rows = evidence.evidence(recovery_point(_pained(c)), c.evidence_plans, c.synonyms)
    return rows.select("plan_id", "context")


@query("f4_sentiment_section", _PLAIN + _SEARCH_PROMPTS + """
select plan_id, case when report_type = 'sentiment' then (select round(avg(sentiment), 6) from pained) end as avg_sentiment
from prompts""")
def f4_section(c: Inputs):
    rows = evidence.sentiment_section(c.evidence_plans, _pained(c))
    return rows.withColumn("avg_sentiment", F.round("avg_sentiment", 6))


# --- coverage ----------------------------------------------------------------------------------------

_SEARCHES = token_ctes(
    "select plan_id, 1 as src, prompt as text from prompts union all select plan_id, 2, keywords from prompts"
) + EXPANSION + f""",
asked(plan_id, community) as (values {_rows((p, n) for p, names, *_ in SEARCH_PLANS for n in names)}),
wanted as (select plan_id, strategy, replace(unnest(string_split(q, ' OR ')), '"', '') as term from searches),
hits as (
  select s.plan_id, s.strategy, count(distinct p.id) as items, count(*) over (partition by s.plan_id) as searches
  from searches s join wanted w on s.plan_id = w.plan_id and s.strategy = w.strategy
  left join posts p on created_utc > {SINCE} and contains(lower(concat(title, ' ', selftext)), lower(w.term)) group by s.plan_id, s.strategy),
checks as (
  select a.plan_id, concat('community:', replace(a.community, 'r/', '')) as label, count(p.id) as items
  from asked a left join posts p on a.community = p.community and created_utc > {SINCE} group by all
  union all
  select plan_id, case when searches = 1 then 'search_query' else concat('search_query_', strategy) end, items from hits h
  where strategy <= coalesce((select min(strategy) from hits f where f.plan_id = h.plan_id and items > 0), strategy))"""

_CHECKS = _SEARCH_PROMPTS + _SEARCHES


def _checks(c: Inputs, prompts=None):
    expected = c.search_plans.select("plan_id", F.explode("communities").alias("community"))
    lists = terms.prompt_terms(prompts or c.search_prompts, c.synonyms)
    searches = coverage.search_checks(c.posts, terms.strategy_terms(lists), SINCE)
    return coverage.community_checks(c.posts, expected, SINCE).unionByName(searches)


@query("f8_coverage_checks", _CHECKS + " select plan_id, label, items, items > 0 as ok from checks")
def f8(c: Inputs):
    return _checks(c)


@query("f8_coverage_checks_all_prompts", _folded(_SEARCHES) + " select plan_id, label, items, items > 0 as ok from checks",
       ("posts", "prompts"))
def f8_all(c: Inputs):
    return _checks(c, c.prompts)


@query("f8_coverage_status", _CHECKS + """
select plan_id, count(*) as checks, count(*) filter (items = 0) as failed,
  case when bool_and(items > 0) then 'healthy' else 'degraded' end as status from checks group by plan_id""")
def f8_status(c: Inputs):
    return coverage.overall_status(_checks(c))


# --- features and clusters ---------------------------------------------------------------------------

_STOP = _quoted(STOP)
_UNI = rf""", uni as (select id, community, w, row_number() over (partition by id order by i) as pos from (
  select id, community, unnest(f) as w, generate_subscripts(f, 1) as i from (
    select id, community, regexp_extract_all(lower({TEXT}), '[\p{{L}}\p{{N}}_]{{2,}}') as f from posts))
  where w not in ({_STOP})),
n_terms as (select id, w as term, 0 as kind, pos from uni union all
  select id, concat(w, ' ', nxt), 1, pos from (
    select *, lead(w) over (partition by id order by pos) as nxt from uni) where nxt is not null)"""
_VOCAB = _UNI + """,
tf as (select id, term, count(*) as tf from n_terms group by id, term),
vocab as (select term, count(*) as docs, sum(tf)::bigint as total from tf group by term
  having count(*) >= 5 and count(*) <= 0.7 * (select count(*) from posts) order by total desc, term limit 20000),
weighted as (select id, term, tf * (ln((1.0 + (select count(*) from posts)) / (1.0 + docs)) + 1) as w from tf join vocab using (term)),
tfidf as (select id, term, w / sqrt(sum(w * w) over (partition by id)) as tfidf from weighted)"""


def _texts(c: Inputs):
    return c.posts.withColumn("text", t.analysis_text(F.col("title"), F.col("selftext")))


@query("j1_terms", _UNI + """
select id, string_agg(term, '|' order by kind, pos) as terms from n_terms group by id""")
def j1(c: Inputs):
    found = features.with_terms(_texts(c).select("id", "text"), STOP).where(F.size("terms") > 0)
    return found.select("id", F.array_join("terms", "|").alias("terms"))


@query("j2_vocabulary", _VOCAB + " select term, docs, total from vocab")
def j2(c: Inputs):
    found = features.with_terms(_texts(c).select("id", "text"), STOP)
    return features.vocabulary(features.term_counts(found), c.posts.count())


@query("j3_tfidf", _VOCAB + """
select id, count(*) as terms, round(sum(tfidf), 6) as mass, round(sum(tfidf * tfidf), 6) as norm,
  arg_max(term, (round(tfidf, 9), term)) as top from tfidf group by id""")
def j3(c: Inputs):
    termed = features.with_terms(_texts(c).select("id", "text"), STOP)
    model = features.TfIdf.fit(termed)
    entries = model.long_form(model.transform(termed), c.spark)
    return entries.groupBy("id").agg(
        F.count("*").alias("terms"), F.round(F.sum("tfidf"), 6).alias("mass"),
        F.round(F.sum(F.col("tfidf") * F.col("tfidf")), 6).alias("norm"),
        F.max_by("term", F.struct(F.round("tfidf", 9), "term")).alias("top"),
    )


_TOP_TERMS = _UNI + """,
tf as (select id, community, w as term, count(*) as tf from uni group by all),
sizes as (select community, count(*) as size from posts group by community),
kept as (select * from (select community, term, count(*) as docs, row_number() over (
  partition by community order by sum(tf) desc, term) as rn from tf group by community, term) where rn <= 2000),
w as (select id, community, term, tf * (ln((1.0 + size) / (1.0 + docs)) + 1) as w, size
  from tf join kept using (community, term) join sizes using (community)),
means as (select community, term, round(sum(share) / max(size), 9) as weight from (
  select *, w / sqrt(sum(w * w) over (partition by id)) as share from w) group by community, term),
ranks as (select *, row_number() over (partition by community order by weight desc, term) as rank from means)"""


@query("j7_top_terms", _TOP_TERMS + " select community, rank::int as rank, term, round(weight, 6) as weight from ranks where rank <= 10")
def j7(c: Inputs):
    found = summarise.top_terms(_texts(c), "community", STOP)
    return found.withColumn("weight", F.round("weight", 6))


@query("g5_top_terms_of_languages", _TOP_TERMS.replace("community", "lang").replace(
    "from posts)", "from (select p.*, d.lang from posts p join documents d on p.id = concat('p', d.doc_id)))").replace(
    "from posts group by lang", "from documents group by lang") + """
select lang, rank::int as rank, term, round(weight, 6) as weight from ranks where rank <= 10""")
def g5(c: Inputs):
    langs = c.table("documents").select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("id"), "lang")
    found = summarise.top_terms(_texts(c).join(langs, "id"), "lang", STOP)
    return found.withColumn("weight", F.round("weight", 6))


@query("j5_silhouette", """
with pairs as (select a.vec_id, a.label, b.label as other, avg(list_sum(list_transform(list_zip(a.embedding, b.embedding),
    lambda z: power(z[1]::double - z[2]::double, 2)))) filter (a.vec_id <> b.vec_id) as d
  from embeddings a, embeddings b group by a.vec_id, a.label, b.label),
ab as (select vec_id, max(d) filter (label = other) as a, min(d) filter (label <> other) as b from pairs group by vec_id)
select round(avg(case when a is null then 0 else (b - a) / greatest(a, b) end), 6) as silhouette from ab""", ())
def j5(c: Inputs):
    from pyspark.ml.functions import array_to_vector

    vectors = c.table("embeddings").select(array_to_vector(F.col("embedding")).alias("features"), "label")
    score = cluster.silhouette(vectors, label="label")
    return c.spark.createDataFrame([(round(score, 6),)], "silhouette double")


@query("j8_single_cluster", "select id, cast(0 as int) as cluster from posts")
def j8(c: Inputs):
    posts, _ = cluster.clustered(_texts(c).select("id", "text"), stop_words=STOP, min_docs=10**9)
    return posts.select("id", "cluster")


def _lloyd_ctes(name: str, k: int, rounds: int) -> str:
    """``{name}_label(id, cluster)`` of ``pt(id)`` and ``vec(id, term, x)``: centres far apart, then rounds of means."""

    def distances(centres: str) -> str:
        return f"""select p.id, c.cluster, round(greatest(0, p.sq + c.sq - 2 * coalesce(dot, 0)), 9) as d
  from sq p cross join (select n.cluster, coalesce(sum(x * x), 0) as sq from (select unnest(range({k})) as cluster) n
    left join {centres} e on n.cluster = e.cluster group by n.cluster) c
  left join (select v.id, e.cluster, sum(v.x * e.x) as dot from vec v join {centres} e using (term) group by all) t
    on t.id = p.id and t.cluster = c.cluster"""

    parts = [f"{name}_c0 as materialized (select cluster, term, x from far join vec using (id) where cluster < {k})"]
    for r in range(rounds + 1):
        parts.append(f"{name}_a{r} as materialized (select id, arg_min(cluster, (d, cluster)) as cluster from ({distances(f'{name}_c{r}')}) group by id)")
        parts.append(f"""{name}_c{r + 1} as materialized (
  select cluster, term, sum(x) / any_value(n) as x from {name}_a{r} join vec using (id) join (
    select cluster, count(*) as n from {name}_a{r} group by cluster) using (cluster) group by cluster, term
  union all select cluster, term, x from {name}_c{r} where cluster not in (select cluster from {name}_a{r}))""")
    parts.append(f"{name}_label as materialized (select id, cluster::int as cluster from {name}_a{rounds})")
    return ",\n".join(parts)


def _far_ctes(k: int) -> str:
    """``far(id, cluster)``: the first point by id, then always the one farthest from those before."""
    to = "round(greatest(0, p.sq + c.sq - 2 * coalesce(sum(v.x * w.x), 0)), 9)"
    parts = ["sq as materialized (select id, coalesce(sum(x * x), 0) as sq from pt left join vec using (id) group by id)",
             "f0 as materialized (select min(id) as id from pt)"]
    for i in range(1, k):
        before = f"join m{i - 1} b using (id)" if i > 1 else ""
        least = "least(b.d, e.d)" if i > 1 else "e.d"
        parts.append(f"""m{i} as materialized (select id, {least} as d from (
  select p.id, {to} as d from sq p cross join (select sq.id, sq.sq from sq join f{i - 1} using (id)) c
  left join vec v on v.id = p.id left join vec w on w.id = c.id and w.term = v.term group by p.id, p.sq, c.sq) e {before})""")
        parts.append(f"f{i} as materialized (select arg_min(id, (-d, id)) as id from m{i})")
    parts.append("far(id, cluster) as materialized (" + " union all ".join(f"select id, {i} from f{i}" for i in range(k)) + ")")
    return ",\n".join(parts)


_POST_POINTS = _VOCAB + ", pt as (select id from posts), vec as materialized (select id, term, tfidf as x from tfidf), "


@query("j4_kmeans_from_far_points", _POST_POINTS + _far_ctes(6) + ", " + _lloyd_ctes("k6", 6, 3) + """
select id, cluster from k6_label""")
def j4_far(c: Inputs):
    """The cluster of every post: six centres far apart, three rounds."""
    termed = features.with_terms(_texts(c).select("id", "text"), STOP)
    vectors = recovery_point(features.TfIdf.fit(termed).transform(termed).select("id", "features"))
    centres = cluster.fit_from_far(vectors, 6, rounds=3)
    return cluster.labelled(cluster.points(vectors, "features", "id"), centres).select("id", "cluster")


_KS = (2, 3, 4)
_VECTOR_POINTS = """with pt as (select vec_id as id from embeddings), vec as materialized (
  select vec_id as id, generate_subscripts(embedding, 1) as term, unnest(embedding)::double as x from embeddings), """


def _score_ctes(name: str) -> str:
    """``{name}_score(score)``: the silhouette over squared distances, from sizes, means and mean squares of clusters."""
    return f"""{name}_of as materialized (select cluster, count(*) as n, avg(sq) as sq from {name}_label join sq using (id) group by cluster),
{name}_mean as materialized (select cluster, term, sum(x) / any_value(n) as x from {name}_label join vec using (id) join {name}_of using (cluster) group by all),
{name}_d as materialized (select l.id, l.cluster as own, o.cluster, n, greatest(0, s.sq + o.sq - 2 * coalesce(dot, 0)) as d
  from {name}_label l join sq s using (id) cross join {name}_of o
  left join (select v.id, m.cluster, sum(v.x * m.x) as dot from vec v join {name}_mean m using (term) group by all) t
    on t.id = l.id and t.cluster = o.cluster),
{name}_ab as (select id, max(case when n > 1 then d * n / (n - 1) end) filter (cluster = own) as a, min(d) filter (cluster <> own) as b
  from {name}_d group by id),
{name}_score as materialized (select round(avg(case when a is null then 0 else (b - a) / greatest(a, b) end), 9) as score from {name}_ab)"""


@query("j6_best_k_from_far_points", _VECTOR_POINTS + _far_ctes(max(_KS)) + ", " + ", ".join(
    _lloyd_ctes(f"k{k}", k, 2) + ", " + _score_ctes(f"k{k}") for k in _KS) + ", scores as (" + " union all ".join(
    f"select {k} as k, score from k{k}_score" for k in _KS) + "), best as (select arg_max(k, (score, -k)) as k from scores) " + " union all ".join(
    f"select id as vec_id, cluster, {k}::int as k from k{k}_label where (select k from best) = {k}" for k in _KS), ())
def j6_far(c: Inputs):
    """The k of the best silhouette and the cluster of every vector."""
    from pyspark.ml.functions import array_to_vector

    vectors = c.table("embeddings").select(F.col("vec_id").alias("id"), array_to_vector(F.col("embedding")).alias("features"))
    centres = cluster.best_k_from_far(vectors, _KS[0], _KS[-1], rounds=2)
    found = cluster.labelled(cluster.points(vectors, "features", "id"), centres)
    return found.select(F.col("id").alias("vec_id"), "cluster", F.lit(len(centres)).alias("k"))


# The labels of random starts are no matter of SQL; see the two queries above for labels that are compared.
@query("j4_kmeans_clusters")
def j4(c: Inputs):
    termed = features.with_terms(_texts(c).select("id", "text"), STOP)
    vectors = recovery_point(features.TfIdf.fit(termed).transform(termed).select("id", "features"))
    model = cluster.fit_kmeans(vectors.select("features"), 6)
    return model.transform(vectors).agg(
        F.count("*").alias("points"), F.every(F.col("cluster").between(0, 5)).alias("labels_within_bounds")
    )


@query("j6_best_k")
def j6(c: Inputs):
    posts, k = cluster.clustered(_texts(c).select("id", "text"), stop_words=STOP)
    return posts.agg(
        F.count("*").alias("points"), F.every(F.col("cluster").between(0, k - 1)).alias("labels_within_bounds"),
        F.lit(6 <= k <= 12).alias("k_within_bounds"),
    )


def _report(cluster_of: str, k: int, before: str = "") -> str:
    """``report(line_no, line)`` of the scored posts in the given clusters, which may need more tables ``before``."""
    grouped = lambda sql: sql.replace("from posts", "from grouped")
    return _PLAIN + before + f", grouped as (select * replace (cast({cluster_of} as varchar) as community) from pained)" + grouped(
        _TOP_TERMS) + grouped(_GAPS) + f""",
gaps as (select community, gap, row_number() over (partition by community order by min((nth, k))) as pos from phrases group by community, gap),
best as (select *, row_number() over (partition by community order by pain_score desc, id) as rank from grouped),
body as (
  select community, 0 as kind, 0 as pos, concat('## Cluster ', community, ' — size ', count(*), ' — avg pain ', printf('%.2f', avg(pain_score))) as line
  from grouped group by community
  union all select community, 1, 0, concat('**Top terms:** ', string_agg(term, ', ' order by rank)) from ranks where rank <= 10 group by community
  union all select community, 2, 0, '**Gap hints:**' from gaps group by community
  union all select community, 2, pos, concat('- ', gap) from gaps where pos <= 10
  union all select community, 3, 0, '**Painful posts:**' from best group by community
  union all select community, 3, rank, concat('- [', title, '](', url, ')  (↑', upvotes, ', 💬', num_comments, ', pain ', pain_score, ')')
  from best where rank <= 5
  union all select community, 4, 0, '' from grouped group by community),
report as (
  select (community::int * 1000 + 999 + row_number() over (partition by community order by kind, pos))::int as line_no, line from body
  union all select unnest([0, 1, 2, 3])::int, unnest(['# Pain Map', concat('- Items: **', n, '**'), '- Clusters: **{k}**', ''])
  from (select count(*) as n from grouped))"""


@query("f9_cluster_report", _report(r"regexp_extract(community, '\d+')", 20) + " select line_no, line from report")
def f9(c: Inputs):
    grouped = recovery_point(_pained(c).withColumn("cluster", F.regexp_extract("community", r"\d+", 0).cast("int")))
    summaries = summarise.cluster_summaries(grouped, stop_words=STOP)
    return summarise.report_lines(summaries, grouped, 20)


# Clusters of the scored posts themselves: six centres far apart, three rounds.
_FAR_OF_SCORED = ", found as materialized (with posts as (select * from pained)" + _POST_POINTS + _far_ctes(6) + ", " + _lloyd_ctes(
    "k6", 6, 3) + " select id, cluster from k6_label)"
_FAR_REPORT = _report("(select cluster from found where found.id = pained.id)", 6, _FAR_OF_SCORED) + " select line_no, line from report"
_FAR = {"kmin": 6, "kmax": 6, "rules": False, "stop_words": STOP, "start": "far", "rounds": 3}


@query("f9_report_of_found_clusters", _FAR_REPORT)
def f9_found(c: Inputs):
    """All posts scored, clustered and reported."""
    _, _, report = flows.analyse(c.posts, c.lexicon, **_FAR)
    return report


@query("research_of_a_plan", _SELECTION + f""", selected as ({_POST_SQL} from judged
  where plan_id = {SEARCH_PLANS[0][0]} and included and not excluded)
select line_no, line from (with posts as (select * from selected) {_FAR_REPORT})""", ("raw",))
def research(c: Inputs):
    """From a plan and raw items to the report: searched, filtered, scored, clustered, summarised."""
    asked = c.search_plans.where(F.col("plan_id") == SEARCH_PLANS[0][0]).withColumnRenamed("filters", "asked")
    plan = c.evidence_plans.drop("communities", "params").join(asked, "plan_id").withColumn("filters", F.col("filters").withField(
        "keywords", F.col("asked.keywords")).withField("exclude", F.col("asked.exclude"))).drop("asked")
    _, _, report, _ = flows.research(c.raw, plan, c.synonyms, c.lexicon, AS_OF, **_FAR)
    return report


# --- streaming ---------------------------------------------------------------------------------------

def _folder(c: Inputs, purpose: str) -> str:
    """A new folder for what a query writes and reads back, in the shared folder."""
    return f"{shared_folder(c.spark).rstrip('/')}/postlens-{purpose}-{uuid4().hex}"


@query("m1_stream_ingest", _PLAIN + """
select id, community, sentiment, pain_score from pained where upvotes >= 20""")
def m1(c: Inputs):
    folder = _folder(c, "stream")
    raw = c.posts.select(
        "id", F.replace("community", F.lit("r/"), F.lit("")).alias("subreddit"),
        F.col("created_utc").cast("double").alias("created_utc"), "title", "selftext", F.col("url").alias("full_link"),
        F.col("upvotes").cast("long").alias("score"), F.col("num_comments").cast("long").alias("num_comments"),
    )
    repeated = raw.unionByName(raw.where(F.col("score") % 5 == 0))
    repeated.write.json(f"{folder}/in")
    stream = ingest.ingest(ingest.read_stream(c.spark, f"{folder}/in", 3), c.lexicon, min_upvotes=20, rules=False)
    ingest.write_stream(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    return c.spark.read.parquet(f"{folder}/out").select("id", "community", "sentiment", "pain_score")


@query("m1_stream_with_ledger", _PLAIN + """
select id, community, sentiment, pain_score from pained where upvotes >= 20""")
def m1_once(c: Inputs):
    """Two runs of a stream, the second with every item again: the ledger of the sink leaves those out."""
    folder = _folder(c, "ledger")
    raw = c.posts.select(
        "id", F.replace("community", F.lit("r/"), F.lit("")).alias("subreddit"),
        F.col("created_utc").cast("double").alias("created_utc"), "title", "selftext", F.col("url").alias("full_link"),
        F.col("upvotes").cast("long").alias("score"), F.col("num_comments").cast("long").alias("num_comments"),
    )
    for part in (raw.where("score % 2 = 0"), raw):
        part.write.mode("append").json(f"{folder}/in")
        stream = ingest.read_stream(c.spark, f"{folder}/in")
        ingest.write_once(stream, c.lexicon, f"{folder}/out", f"{folder}/state", 20, rules=False).awaitTermination()
    return c.spark.read.parquet(f"{folder}/out/posts").select("id", "community", "sentiment", "pain_score")


@query("b13_fetch_stamp", "select count(*) as posts, 1::bigint as stamps, 0::bigint as missing, true as recent from raw", ("raw",))
def b13(c: Inputs):
    """All posts of one query have one stamp, that of its start."""
    posts = to_posts(c.raw, "query")
    return posts.agg(
        F.count("*").alias("posts"), F.count_distinct("fetched_at").alias("stamps"), F.count_if(F.col("fetched_at").isNull()).alias("missing"),
        F.every(F.col("fetched_at") > F.current_timestamp() - F.expr("interval 1 day")).alias("recent"),
    )


# --- sources and sinks that write ----------------------------------------------------------------------

@query("a1_a2_jsonl_round_trip", "select id, subreddit, created_utc, selftext, score, num_comments from raw", ("raw",))
def a1(c: Inputs):
    folder = _folder(c, "jsonl")
    writers.write_jsonl(c.raw, folder)
    back = readers.read_jsonl(c.spark, folder).where(F.col("_corrupt_record").isNull())
    return back.select("id", "subreddit", "created_utc", "selftext", "score", "num_comments")


@query("a3_posts_by_cluster", """
select community, count(*) as posts, sum(upvotes)::bigint as upvotes from posts where upvotes % 7 = 3 group by community""")
def a3(c: Inputs):
    folder = _folder(c, "posts")
    writers.write_posts(c.posts.withColumn("cluster", F.col("upvotes") % 7), folder, by_cluster=True)
    one = readers.read_parquet(c.spark, folder).where(F.col("cluster") == 3)
    return one.groupBy("community").agg(F.count("*").alias("posts"), F.sum("upvotes").alias("upvotes"))


@query("a5_a6_plan_round_trip", r"""
select plan_id, prompt, array_to_string(regexp_extract_all(communities, '[^, ]+'), '|') as communities, 1::int as months,
  array_to_string(list_filter(string_split(must_terms, ','), lambda x: x <> ''), '|') as must, report_type from prompts""",
       ("prompts",))
def a5(c: Inputs):
    folder = _folder(c, "plans")
    writers.write_plans(c.plans, folder)
    back = c.spark.read.schema(schemas.PLAN).json(folder)
    return back.select(
        "plan_id", "prompt", F.array_join("communities", "|").alias("communities"), "params.months",
        F.array_join("filters.must_include", "|").alias("must"), "report_type",
    )


@query("a9_empty_input_report", "select * from (values (999::int, '# Pain Map'), (1000::int, '- Items: **0**'), (1001::int, '- Clusters: **0**'), (1002::int, concat(chr(10), '> nothing written in the future'))) t(line_no, line) where (select count(*) from posts where created_utc > 4102444800) = 0")
def a9(c: Inputs):
    future = recovery_point(_pained(c).where(F.col("created_utc") > 4_102_444_800).withColumn("cluster", F.col("upvotes") % 1))
    summaries = summarise.cluster_summaries(future, stop_words=STOP)
    lines = summarise.report_lines(summaries, future, 1, reason="nothing written in the future")
    return lines.withColumn("line_no", F.row_number().over(Window.orderBy("line_no")) + 998)


@query("a11_report_sink", _report("upvotes % 6", 6) + """
select unnest(string_split(line, chr(10))) as value from report""")
def a11(c: Inputs):
    grouped = written(_pained(c).withColumn("cluster", F.col("upvotes") % 6), "grouped")
    folder = _folder(c, "report")
    summaries = summarise.cluster_summaries(grouped, stop_words=STOP)
    writers.write_report(summarise.report_lines(summaries, grouped, 6), folder)
    return c.spark.read.text(folder)
