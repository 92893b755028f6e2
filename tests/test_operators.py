from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from postlens import fixed_values as fixed
from postlens import schemas
from postlens.operators import coverage, discover, evidence, select, termjoin, terms
from postlens.operators.topn import first_per_key, top_n
from postlens.plans import planning
from postlens.sources import documents, locate, readers, writers
from postlens.sources.locate import Late


@pytest.fixture(scope="module")
def synonyms(spark):
    return fixed.synonym_table(spark).cache()


def test_top_n_with_a_hot_group(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.7 else f"g{i % 9}", rng.randrange(500)) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, grp string, score int").repartition(16)
    for n in (3, 120):
        found = top_n(df, ["grp"], [F.desc("score"), F.asc("id")], n, salt_on="id")
        expected = {
            (g, rank, i)
            for g, members in itertools.groupby(sorted(rows, key=lambda r: r[1]), key=lambda r: r[1])
            for rank, (i, _, _) in enumerate(sorted(members, key=lambda r: (-r[2], r[0]))[:n], 1)
        }
        assert {(r.grp, r["rank"], r.id) for r in found.collect()} == expected
        assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()


def test_first_per_key_with_many_copies(spark):
    rows = [("dup", i, f"t{i}") for i in range(500)] + [(f"k{i}", 0, "x") for i in range(50)] + [(None, 2, "a"), (None, 1, "b")]
    df = spark.createDataFrame(rows, "id string, at int, t string")
    found = {r.id: r.t for r in first_per_key(df, ["id"], [F.col("at")]).collect()}
    assert len(found) == 52 and found["dup"] == "t0" and found[None] == "b"


def test_all_ways_of_matching_agree(spark):
    rng = random.Random(5)
    letters = "abcde ß"
    posts = [(f"p{i}", "".join(rng.choice(letters) for _ in range(rng.randrange(0, 60)))) for i in range(150)]
    wanted = [(g, "".join(rng.choice("abcdeß") for _ in range(rng.randrange(1, 7)))) for g in range(8) for _ in range(6)]
    wanted += [(9, "A"), (9, " "), (10, "zz")]
    posts_df = spark.createDataFrame(posts, "id string, text string")
    terms_df = spark.createDataFrame(wanted, "grp long, term string")
    fold = lambda s: s.lower().replace("ß", "ss")
    expected = {(g, i) for g, term in wanted for i, text in posts if term.strip() and fold(term.strip()) in fold(text)}
    for options in _WAYS:
        found = termjoin.group_posts(posts_df, terms_df, "grp", ["id"], **options).collect()
        assert {(r.grp, r.id) for r in found} == expected and len(found) == len(expected)


_WAYS = (
    {}, {"max_groups": 0}, {"max_literals": 0}, {"max_literals": 0, "max_grams": 0}, {"max_literals": 0, "max_broadcast": 0},
    {"max_literals": 0, "max_grams": 0, "max_broadcast": 0},
)


def test_a_term_is_looked_up_by_its_rarest_gram(spark):
    texts = [("the common words",)] * 40 + [("uncommon words are rare",)] * 3 + [(None,)]
    texts = spark.createDataFrame(texts, "_text string")
    wanted = spark.createDataFrame([("the common words",), ("common words are",), ("zzz",), ("absent thing",)], "term string")
    found = {r.term: (r.gram, r.docs) for r in termjoin.rarest_grams(texts, wanted, 1.0).collect()}
    assert found["zzz"] == ("zzz", 0) and found["absent thing"][1] == 0
    assert found["common words are"] == (" are", 3) and found["the common words"][1] == 40


def test_many_terms_shuffle_no_text(spark):
    """Neither the way that verifies in place nor the narrow join sends a text through the join on grams."""
    posts = spark.createDataFrame([(i, f"some text of number {i}") for i in range(300)], "id long, text string")
    wanted = spark.createDataFrame([(i % 7, f"number {i}") for i in range(0, 300, 3)], "grp long, term string")
    ids = lambda df: sorted((r.grp, r.id) for r in df.collect())
    inline = termjoin.group_posts(posts, wanted, "grp", ["id"], max_literals=0)
    plan = inline._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan.split("Exchange")[0] and "BroadcastHashJoin" in plan
    narrow = termjoin.group_posts(posts, wanted, "grp", ["id"], max_literals=0, max_broadcast=0)
    assert ids(inline) == ids(narrow) == ids(termjoin.group_posts(posts, wanted, "grp", ["id"]))


def test_every_way_of_matching_keeps_each_row(spark):
    posts = [("a", "red blue"), ("a", "red blue"), (None, "red"), (None, "red"), (None, "blue red"), ("b", None), ("c", "green")]
    wanted = [(-1, 2, "red"), (-1, 2, "blue"), (2**62, 0, "red"), (-1, 1, "green"), (5, 1, "nothing")]
    posts_df = spark.createDataFrame(posts, "id string, text string")
    terms_df = spark.createDataFrame(wanted, "plan_id long, strategy int, term string")
    expected = sorted(
        [(-1, 2, i) for i, t in posts[:5]] + [(2**62, 0, i) for i, t in posts[:5]] + [(-1, 1, "c")], key=repr
    )
    for options in _WAYS:
        found = termjoin.group_posts(posts_df, terms_df, ["plan_id", "strategy"], ["id"], **options).collect()
        assert sorted(map(tuple, found), key=repr) == expected


def test_counts_and_first_rows_are_those_of_all_rows(spark, monkeypatch):
    """Many groups: bits of terms are counted in tiles, only the first rows of a term meet the groups."""
    monkeypatch.setattr(termjoin, "_TILE_ROWS", 30)
    monkeypatch.setattr(termjoin, "_TILE_GROUPS", 5)
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdeß ") for _ in range(n))
    posts = [(None if i % 9 == 0 else f"p{i % 40}", rng.randrange(6), i, text(rng.randrange(50))) for i in range(120)] + [("n", 1, 999, None)]
    wanted = [(None if g == 3 else g, g % 2, text(rng.randrange(1, 4))) for g in range(12) for _ in range(5)] + [(50, 0, "zzzz")]
    posts_df = spark.createDataFrame(posts, "id string, at int, nth int, text string")
    terms_df = spark.createDataFrame(wanted, "plan_id long, strategy int, term string")
    search, order = ["plan_id", "strategy"], [F.desc("at"), F.asc_nulls_first("id"), F.asc("nth")]
    for options in ({}, {"max_literals": 0}, {"max_groups": 0}, {"max_literals": 0, "max_broadcast": 0}):
        found = termjoin.Matches(posts_df, terms_df, search, ["id", "at", "nth"], **options)
        rows = found.rows().collect()
        expected = sorted(((r.plan_id, r.strategy, n) for r, n in _tally(rows)), key=repr)
        assert sorted(map(tuple, found.counts().collect()), key=repr) == expected and expected
        firsts = {(r.plan_id, r.strategy, r["rank"]): (r.id, r.at, r.nth) for r in found.first(order, 4).collect()}
        best = {}
        for r in sorted(rows, key=lambda r: (-r.at, r.id is not None, r.id or "", r.nth)):
            rank = 1 + sum(1 for p, s, _ in best if (p, s) == (r.plan_id, r.strategy))
            if rank <= 4:
                best[r.plan_id, r.strategy, rank] = (r.id, r.at, r.nth)
        assert firsts == best


def _tally(rows):
    groups = itertools.groupby(sorted(rows, key=lambda r: repr(r[:2])), key=lambda r: repr(r[:2]))
    return [(members[0], len(members)) for members in (list(m) for _, m in groups)]


def test_many_ranked_rows_are_not_broadcast(spark, tmp_path):
    spark.range(50).selectExpr("id", "concat('t', id) as title").write.parquet(str(tmp_path / "t"))
    rows = locate.located(spark.read.parquet(str(tmp_path / "t")))
    ranked = rows.select(*locate.LOCATOR, F.explode(F.sequence(F.lit(1), F.lit(30))).alias("plan_id"))
    found = locate.fetched(rows, ranked, ["title"], max_fetched=100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and found.count() == 1500


def test_a_row_that_many_plans_find_is_ranked_without_its_text(spark, synonyms):
    """Of items that are no stored table, too: what 300 plans find is ranked by where it is."""
    raw = spark.createDataFrame([(f"p{i}", "a", float(i), "big red thing", "x" * 50, None, 30, 0) for i in range(20)], "id string, subreddit string, created_utc double, title string, selftext string, full_link string, score long, num_comments long")
    plans = spark.range(300).selectExpr(
        "id as plan_id", "array() as communities", "named_struct('months', 1, 'min_upvotes', 0, 'limit', 3) as params",
        "named_struct('keywords', array('red thing'), 'exclude', array()) as filters")
    hits = select.both_hits(select._items(raw), select.Searches.of(plans, 1_000_000), synonyms)
    assert "selftext" not in hits.columns and hits.count() == 900
    found = select.select_posts(raw, plans, synonyms, 1_000_000).groupBy("plan_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    assert {tuple(r.ids) for r in found.collect()} == {("p17", "p18", "p19")} and found.count() == 300
    # A plan that comes twice shares its limit of three rows.
    twice = select.keyword_hits(select._items(raw), select.Searches.of(plans.union(plans), 1_000_000), synonyms)
    assert twice.count() == 900 and twice.select("id").distinct().count() == 2


def test_full_plans(spark):
    prompts = spark.createDataFrame(
        [(1, "trend of cats", "auto", ["k", "K", " "]), (2, "cats", "faq", []), (3, "dogs", "auto", None)],
        "plan_id long, prompt string, report_type string, keywords array<string>",
    )
    curated = spark.createDataFrame([("dogs", 0, "dogpark")], "word string, pos int, community string")
    text = (
        '{"plan_id": 1, "communities": ["a", "b"], "params": {"months": 2}, "report_type": "trend", "warnings": ["own"],'
        ' "filters": {"exclude": ["x"], "keywords": ["theirs"]}}'
    )
    proposals = documents.plans(spark.createDataFrame([(text,), ('{"plan_id": 2, "subreddits": []}',)], "document string"))
    seeded = '{"plan_id": %d, "subreddits": ["s1"], "warnings": ["seed"], "topic_themes": [{"name": "t"}]}'
    seeds = documents.seeds(spark.createDataFrame([(seeded % 1,), (seeded % 2,)], "document string"))
    made = planning.plan_rows(prompts, curated, seeds, proposals)
    assert [f.name for f in schemas.PLAN] == made.columns
    rows = {r.plan_id: r for r in made.collect()}
    one, two, three = rows[1], rows[2], rows[3]
    assert (one.rationale, one.communities, one.warnings, one.params.months) == ("llm", ["r/a", "r/b"], ["own"], 2)
    assert (one.filters.keywords, one.filters.exclude, one.topic_themes[0].name, len(one.seed)) == (["k"], ["x"], "t", 1)
    assert (two.rationale, two.communities, two.warnings, two.filters) == ("heuristic", ["r/s1"], ["seed"], None)
    assert (three.rationale, three.communities, three.filters, three.seed) == ("heuristic", ["r/dogpark"], None, None)


def test_the_keyword_filter_step(spark, synonyms):
    posts = spark.createDataFrame([(1, "haptic glove", ""), (2, "nothing", "bad haptic"), (3, "else", None)], "id long, title string, selftext string")
    ids = lambda *a, **k: sorted(r.id for r in select.keyword_filter_step(posts, *a, **k).collect())
    assert ids("haptic", synonyms) == [1, 2] and ids("", synonyms, '["glove"]') == [1]
    assert ids("haptic", synonyms, exclude_json='["BAD"]') == [1] and ids("", synonyms, "{}", '["haptic"]') == [1, 2, 3]
    assert ids("nothing bad", synonyms, mode="all") == [2] and ids("nothing else", synonyms) == [2, 3]


def test_searches_stop_at_the_first_that_finds(spark):
    raw = [("p1", "r/a", 50, "red", ""), ("p2", "r/", 60, "blue red", "")]
    posts = spark.createDataFrame(raw, "id string, community string, created_utc long, title string, selftext string")
    strategies = spark.createDataFrame(
        [(-1, 0, "none"), (-1, 1, "red"), (-1, 2, "zzz"), (7, 0, "zzz")], "plan_id long, strategy int, term string"
    )
    checks = coverage.search_checks(posts, strategies, 0).collect()
    assert sorted(map(tuple, checks)) == [
        (-1, "search_query_1", 0, False), (-1, "search_query_2", 2, True), (7, "search_query", 0, False)
    ]
    counts = discover.strategy_counts(posts, strategies, 0, 10).collect()
    assert [tuple(r) for r in counts] == [(-1, "r/a", 1)]


def _prompts(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "plan_id long, prompt string, keywords string")


def test_term_lists(spark, synonyms):
    rows = terms.prompt_terms(
        _prompts(
            spark,
            ("haptic glove market", ""), ('mobil uygulamalar güvenlik "Face Reading"', ""), ("the of and", ""), ("", ""),
            ("müşteri", None), ("ab Cde cde", "CDE x9z"),
        ),
        synonyms,
    ).collect()
    by_id = {r.plan_id: r for r in rows}
    assert by_id[0].expanded[:3] == ["haptic", "haptic technology", "haptic glove"]
    assert by_id[0].english == ["haptic", "haptic technology", "haptic glove", "glove", "market", "market positioning"]
    assert by_id[1].english[0] == "mobile" and "app" in by_id[1].english and by_id[1].english[-1] == "face reading"
    assert by_id[2].expanded == [] and by_id[2].english == ["the", "of", "and"] and by_id[2].basic == []
    assert by_id[3].english == [] and by_id[3].basic == []
    assert by_id[4].expanded == ["müşteri", "musteri"] and by_id[4].english == ["mteri", "musteri"]
    assert by_id[5].expanded == ["cde", "x9z"] and by_id[5].basic == ["cde", "x9z"]


def test_search_strategies(spark, synonyms):
    lists = terms.prompt_terms(_prompts(spark, ('"face reading" tool', ""), ("", "")), synonyms)
    tried = {
        r.plan_id: r.s
        for r in lists.select("plan_id", terms.search_strategies(F.col("english"), F.col("basic")).alias("s")).collect()
    }
    assert tried[0] == [['"face reading"', "tool"], ["face reading", "tool"]]
    assert tried[1] == [fixed.DEFAULT_TERMS]


def _raw(spark, rows):
    columns = "id string, subreddit string, created_utc double, title string, selftext string, full_link string, score long, num_comments long"
    return spark.createDataFrame(rows, columns)


def _plans(spark, rows):
    kind = """plan_id long, communities array<string>, params struct<months:int,min_upvotes:int,limit:int>,
      filters struct<keywords:array<string>,exclude:array<string>>"""
    return spark.createDataFrame(rows, kind)


AS_OF = 10_000_000


def test_select_posts(spark, synonyms):
    raw = _raw(spark, [
        ("a", "one", AS_OF - 10.0, "export tool", "x", None, 50, 1),
        ("a", "one", AS_OF - 20.0, "export older copy", "x", None, 50, 1),
        ("b", "one", AS_OF - 30.0, "nothing", "x", "", 5, 1),
        ("c", "two", AS_OF - 40.0, "an EXPORT elsewhere", "x", "http://c", 30, 1),
        ("d", "two", AS_OF - 50.0, "export idiot", "x", None, 30, 1),
        ("e", "one", AS_OF - 3_000_000.0, "export too old", "x", None, 90, 1),
        ("f", "one", AS_OF - 60.0, "export null score", "x", None, None, 1),
        ("g", "one", AS_OF - 70.0, "export beyond limit", "x", None, 99, 1),
    ])
    plans = _plans(spark, [
        (1, ["r/one"], (1, 20, 4), (["export"], ["IDIOT"])),
        (2, ["r/one", "r/two"], (0, 0, 100), ([], [])),
        (3, [], (1, 0, 10), ([], [])),
    ])
    rows = select.select_posts(raw, plans, synonyms, AS_OF).collect()
    first = {r.id: r for r in rows if r.plan_id == 1}
    assert set(first) == {"a", "c"}
    assert first["a"].title == "export tool" and first["a"].source == select.COMMUNITY_SOURCE
    assert first["c"].source == select.KEYWORD_SOURCE and first["c"].url == "http://c"
    assert {r.id for r in rows if r.plan_id == 2} == {"a", "b", "c", "d", "f", "g"}
    assert not [r for r in rows if r.plan_id == 3]
    after_limit = select.search_communities(raw, ["r/one"], AS_OF - 2_592_000, 2, 20).collect()
    assert [r.id for r in after_limit] == ["a", "a"]
    wanted_first = select.search_communities(raw, ["r/one"], AS_OF - 2_592_000, 3, 20, limit_after_filter=True)
    assert sorted(r.id for r in wanted_first.collect()) == ["a", "a", "g"]


def test_select_posts_of_a_stored_table(spark, synonyms, tmp_path):
    """Ids that repeat or are missing, several files: the same posts as from rows, and no sort that holds a text."""
    rng = random.Random(8)
    rows = [
        (None if i % 13 == 0 else f"p{i % 70}", rng.choice(["one", "two", "three"]), AS_OF - 10.0 * i, f"title {i}",
         rng.choice(["export of words", "log in please", "nothing", "export idiot"]) + f" {i}", None, rng.randrange(60), 1)
        for i in range(200)
    ]
    raw = _raw(spark, rows).repartition(5)
    plans = _plans(spark, [
        (1, ["r/one"], (1, 20, 40), (["export"], ["IDIOT"])), (2, ["r/one", "r/two"], (0, 0, 100), ([], [])),
        (3, [], (1, 0, 60), (["log in", "export"], [])),
    ])
    writers.write_raw_table(raw, str(tmp_path / "raw"))
    stored = readers.read_parquet(spark, str(tmp_path / "raw"))
    counters = Observation("searched"), Observation("judged")
    found = select.select_posts(stored, plans, synonyms, AS_OF, counters)
    key = lambda r: (r.plan_id, r.id or "", r.title, r.selftext, r.upvotes, r.source)
    rows_found = sorted(map(key, found.collect()))
    assert rows_found == sorted(map(key, select.select_posts(raw, plans, synonyms, AS_OF).collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Sort [" in line and "selftext" in line]
    funnel = select.selection_funnel(stored, plans, synonyms, AS_OF).collect()
    assert sorted(map(tuple, funnel)) == sorted(map(tuple, select.selection_funnel(raw, plans, synonyms, AS_OF).collect()))
    told = {**counters[0].get, **counters[1].get}
    assert all(total == sum(r[name] for r in funnel) for name, total in told.items()) and told["kept_rows"] == len(rows_found)
    for limit in (7, 90):
        asked = (["export", "log in"], AS_OF - 2_592_000, limit, 10)
        ids = lambda df: sorted((r.id or "", r.title) for r in df.collect())
        assert ids(select.search_keywords(stored, *asked)) == ids(select.search_keywords(raw, *asked))
        asked = (["r/one", "r/two"], AS_OF - 2_592_000, limit, 10)
        assert ids(select.search_communities(stored, *asked)) == ids(select.search_communities(raw, *asked))


def test_many_communities_of_a_bucketed_table(spark, tmp_path):
    """Beyond the bound of a broadcast, posts in buckets are joined without being shuffled, and the rows are the same."""
    rng = random.Random(5)
    names = [f"s{i}" for i in range(300)]
    # One community holds a third of all rows; some rows have no id or none of the asked communities.
    rows = [
        (None if i % 17 == 0 else f"p{i}", "s0" if i % 3 == 0 else rng.choice([*names, "elsewhere", None]), AS_OF - 10.0 * i,
         f"title {i}", "text", None, rng.randrange(60), 1)
        for i in range(3000)
    ]
    raw = _raw(spark, rows)
    plans = _plans(spark, [(p, [f"r/{rng.choice(names)}" for _ in range(110)], (1, 10, 15), ([], [])) for p in range(200)])
    writers.write_bucketed_table(raw, "many_communities", str(tmp_path / "raw"), buckets=6, slices=3)
    stored, searches = readers.read_table(spark, "many_communities"), select.Searches.of(plans, AS_OF)
    assert searches.plans.selectExpr("sum(size(communities))").first()[0] > select.MAX_INLINE_ROWS
    few = {"slices": 3, "max_broadcast": 100}  # there are more names than these
    files = [p.name for p in (tmp_path / "raw").rglob("*.parquet")]
    assert len(files) <= 6 * len(list((tmp_path / "raw").glob("created_month=*")))
    found = select.community_pass(stored, searches, **few)
    key = lambda r: (r.plan_id, r.community_pos, r.community, r.id or "", r.title, r.created_utc, r.upvotes)
    assert sorted(map(key, found.collect())) == sorted(map(key, select.community_pass(raw, searches).collect()))
    assert sorted(map(key, found.collect())) == sorted(map(key, select.community_pass(raw, searches, max_broadcast=100).collect()))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        plan = select.community_hits(Late(stored, select._WIDE), searches, **few)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "SelectedBucketsCount: 6 out of 6" in plan
    # The names of communities are shuffled to the buckets, the posts are not.
    assert len(re.findall(r"Exchange hashpartitioning\(subreddit#\d+, community_slice", plan)) == 1
    # Plans meet ranked rows only: the ranks are below the join with them.
    assert re.search(r"SortMergeJoin[^\n]*Inner(.|\n)*Window(.|\n)*SortMergeJoin[^\n]*LeftSemi", plan)


def test_select_posts_without_plans(spark, synonyms):
    assert select.select_posts(_raw(spark, []), _plans(spark, []), synonyms, AS_OF).count() == 0


def test_discover_and_fallback(spark, synonyms):
    posts = spark.createDataFrame(
        [(f"p{i}", "r/all" if i % 3 == 0 else f"r/c{i % 2}", AS_OF - i, "haptic glove", "") for i in range(30)],
        "id string, community string, created_utc long, title string, selftext string",
    )
    prompts = _prompts(spark, ("haptic glove", ""), ("mobile security", ""), ("", ""))
    found = {r.plan_id: r.communities for r in discover.discover(prompts, posts, synonyms, AS_OF).collect()}
    assert found[0] == ["r/c0", "r/c1"]
    assert found[1][:4] == fixed.FALLBACK_COMMUNITIES["mobile"] and "r/cybersecurity" in found[1]
    assert found[2] == []


def test_evidence_rows(spark, synonyms):
    posts = spark.createDataFrame(
        [(f"p{i}", f"title {i}", f"http://{i}", "trash talk" if i < 3 else "calm talk", -0.5, i / 8.0) for i in range(12)],
        "id string, title string, url string, text string, sentiment double, pain_score double",
    )
    lists = "array<string>"
    kind = f"""plan_id long, prompt string, communities {lists}, params struct<months:int,min_upvotes:int,limit:int>,
      filters struct<keywords:{lists},must_include:{lists},should_include:{lists},exclude:{lists},languages:{lists}>,
      report_type string, keywords {lists}, warnings {lists},
      topic_themes array<struct<name:string,audience:string,pain_points:{lists},desired_outcomes:{lists}>>"""
    plans = spark.createDataFrame(
        [
            (1, "trash", ["r/a"], (1, 2, 3), ([], [], [], [], ["en"]), "faq", [], ["w", "W"], None),
            (2, "zebra", [], None, None, None, None, None, [("n", None, ["a", "b", "c", "d"], [])]),
        ],
        kind,
    )
    rows = {r.plan_id: r for r in evidence.evidence(posts, plans, synonyms).collect()}
    assert (rows[1].matched, rows[1].total, rows[1].coverage_note) == (3, 12, fixed.COVERAGE_THIN)
    assert rows[1].lines == ["- [title 2](http://2) (pain 0.25)", "- [title 1](http://1) (pain 0.12)", "- [title 0](http://0) (pain 0.00)"]
    assert "Warnings: w\n" in rows[1].context and "languages: en" in rows[1].context
    assert rows[2].coverage_note == fixed.COVERAGE_NONE and len(rows[2].lines) == 8
    assert "n (audience: -; pains: a, b, c; outcomes: -)" in rows[2].context
    assert "months=-, min_upvotes=-, limit=-" in rows[2].context and "Report type: auto" in rows[2].context
    nothing = {r.plan_id: r for r in evidence.evidence(posts.limit(0), plans, synonyms).collect()}
    assert nothing[1].coverage_note == fixed.COVERAGE_EMPTY and fixed.NO_SAMPLES in nothing[1].context


def test_blocklist_rules(spark):
    candidates = spark.createDataFrame(
        [(1, 0, "r/all"), (1, 1, "r/ok"), (2, 0, "r/ALL"), (3, 0, "r/askreddit")], "plan_id long, pos int, community string"
    )
    blocked = spark.createDataFrame([("r/all",), ("r/AskReddit",)], "community string")

    def left(**options):
        return {(r.plan_id, r.community) for r in planning.without_blocked(candidates, blocked, **options).collect()}

    assert left() == {(1, "r/ok")}
    assert left(case_sensitive=True) == {(1, "r/ok"), (2, "r/ALL"), (3, "r/askreddit")}
    assert left(keep_if_empty=True) == {(1, "r/ok"), (2, "r/ALL"), (3, "r/askreddit")}


def test_vetting_falls_back_to_the_blocklist(spark):
    plans = spark.createDataFrame(
        [(1, ["r/big", "r/small", "r/adult"]), (2, ["x/r/unknown", "r/all", "UNKNOWN"]), (3, [])],
        "plan_id long, communities array<string>",
    )
    profiles = spark.createDataFrame(
        [("r/Big", False, 20000), ("r/small", None, 5), ("r/adult", True, 99999)],
        "community string, over18 boolean, subscribers long",
    )
    blocked = spark.createDataFrame([("r/all",)], "community string")
    vetted = planning.vet(plans, profiles, blocked)
    assert {r.plan_id: r.vetted for r in vetted.collect()} == {1: ["r/Big"], 2: ["r/unknown"], 3: []}
    patched = {r.plan_id: r.communities for r in planning.patch(plans, vetted).collect()}
    assert patched == {1: ["r/Big"], 2: ["r/unknown"], 3: []}
