"""Filters of many plans judge a post once for each different pair of filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens import fixed_values as fixed
from postlens.operators import select


def test_plans_meet_narrow_rows_when_posts_are_judged(spark):
    kind = "id string, subreddit string, created_utc double, title string, selftext string, full_link string, score long, num_comments long"
    texts = ["red thing", "red idiot", "blue", None]
    raw = spark.createDataFrame([(f"p{i}", "a", float(i), texts[i % 4], "x" * 50, None, 30, 0) for i in range(20)], kind)
    plans = spark.range(40).selectExpr(
        "id as plan_id", "array('r/a') as communities", "named_struct('months', 1, 'min_upvotes', 0, 'limit', 30) as params",
        "named_struct('keywords', if(id % 2 = 0, array('RED'), array()), 'exclude', if(id % 4 < 2, array('idiot'), array())) as filters")
    plans = plans.union(plans.where("plan_id = 0"))
    synonyms = fixed.synonym_table(spark)
    items, searches = select._items(raw), select.Searches.of(plans, 1_000_000)
    rows = select.judged(items, select.unique_hits(items, select.both_hits(items, searches, synonyms)), searches)
    assert "selftext" not in rows.columns and "title" not in rows.columns
    # A plan that comes twice is judged twice.
    assert rows.count() == 41 * 20 and rows.where("excluded").count() == 21 * 5 and rows.where("included").count() == 21 * 10 + 20 * 20
    found = select.select_posts(raw, plans, synonyms, 1_000_000).groupBy("plan_id").agg(F.count("*").alias("n"))
    assert {r.plan_id: r.n for r in found.collect()} == {i: {0: 5, 1: 15, 2: 10, 3: 20}[i % 4] * (2 if i == 0 else 1) for i in range(40)}
