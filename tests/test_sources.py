from __future__ import annotations

import json

from pyspark.sql import functions as F

from postlens import fixed_values as fixed
from postlens import schemas
from postlens.operators import select
from postlens.operators.sentiment import prepared
from postlens.sources import documents, readers, writers
from postlens.sources.posts import to_posts
from postlens.streaming import ingest


def _raw_rows(n):
    return [
        (f"p{i}", "c", 1000.5 + i, f"title number {i}", "some english words, trash" if i % 2 else "idiot here", None, 5 * i, i)
        for i in range(n)
    ]


def test_jsonl_round_trip_keeps_bad_lines_aside(spark, tmp_path):
    raw = spark.createDataFrame(_raw_rows(20), schemas.RAW_POST)
    writers.write_jsonl(raw, str(tmp_path / "raw"))
    (tmp_path / "raw" / "more.json").write_text('{"id": "x", "extra": 1}\n{broken\n')
    back = readers.read_jsonl(spark, str(tmp_path / "raw")).cache()
    assert back.where("_corrupt_record is null").count() == 21
    assert [r._corrupt_record for r in back.where("_corrupt_record is not null").collect()] == ["{broken"]
    assert {r.id for r in back.collect() if r.id} == {f"p{i}" for i in range(20)} | {"x"}


def test_raw_table_prunes_months(spark, tmp_path):
    raw = spark.createDataFrame(_raw_rows(5), schemas.RAW_POST).withColumn("created_utc", F.col("num_comments") * 3_000_000.0)
    writers.write_raw_table(raw, str(tmp_path / "t"))
    table = readers.read_parquet(spark, str(tmp_path / "t")).where("created_month >= '1970-03' and created_utc > 1.0")
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_month" in plan and "GreaterThan(created_utc,1.0)" in plan
    assert table.count() == 3


def test_selectors_prune_months(spark, tmp_path):
    raw = spark.createDataFrame(_raw_rows(5), schemas.RAW_POST).withColumn("created_utc", F.col("num_comments") * 3_000_000.0)
    writers.write_raw_table(raw, str(tmp_path / "t"))
    table = readers.read_parquet(spark, str(tmp_path / "t"))
    plans = spark.createDataFrame(
        [(1, ["r/c"], (1, 0, 5), (["idiot"], []))],
        "plan_id long, communities array<string>, params struct<months:int,min_upvotes:int,limit:int>,"
        " filters struct<keywords:array<string>,exclude:array<string>>",
    )
    as_of = 12_100_000
    found = select.select_posts(table, plans, fixed.synonym_table(spark), as_of)
    assert "created_month" in found._jdf.queryExecution().optimizedPlan().toString()
    assert found._jdf.queryExecution().executedPlan().toString().count("PartitionFilters: [isnotnull(created_month") == 2
    plain = select.select_posts(raw, plans, fixed.synonym_table(spark), as_of)
    columns = [c for c in plain.columns if c != "fetched_at"]
    assert sorted(found.select(columns).collect()) == sorted(plain.select(columns).collect()) and plain.count() > 0


def test_seed_and_plan_documents_of_all_layouts(spark):
    seed = {
        "original_prompt": "p", "timeframe_months": 6, "confidence": 0.7, "keywords": ["k"],
        "subreddits": [
            {"name": "src3", "meta": {"confidence": 0.5, "why": "w", "flags": ["f"]}}, "r/SRC3", "x/r/src7", {"subreddit": "src8", "why": "y"},
            {"name": " "}, "",
        ],
    }
    plan = {
        "original_prompt": "q", "subreddits": ["src1", {"name": "r/src2"}], "params": {"months": 3},
        "keyword_plan": {"core": ["alpha", {"phrase": "beta"}], "long_tail": [{"keyword": "gamma"}]},
        "seed_metadata": seed, "filters": {"exclude": ["e"]}, "warnings": ["w"],
    }
    texts = spark.createDataFrame([(json.dumps(seed),), ("no json",), (None,)], "document string")
    rows = documents.seeds(texts).collect()
    entries = [tuple(e) for e in rows[0].subreddits]
    assert entries == [
        ("r/src3", 0.5, "w", ["f"]), ("r/src7", 0.0, "seed suggestion", []), ("r/src8", None, "y", []),
    ]
    assert rows[0].prompt == "p" and rows[0].timeframe_months == 6 and rows[1].subreddits == rows[2].subreddits == []
    assert {f.name for f in schemas.SEED} == set(rows[0].asDict())
    made = documents.plans(spark.createDataFrame([(json.dumps(plan),)], "document string"))
    row = made.first()
    assert row.communities == ["r/src1", "r/src2"] and row.params.months == 3 and row.filters.exclude == ["e"]
    assert [tuple(x) for x in row.keyword_plan.core] == [("alpha", None), ("beta", None)]
    assert [tuple(x) for x in row.keyword_plan.long_tail] == [(None, "gamma")] and len(row.seed) == 3
    assert set(made.columns) == {f.name for f in schemas.PLAN}


def test_posts_round_trip_by_cluster(spark, tmp_path):
    posts = to_posts(spark.createDataFrame(_raw_rows(6), schemas.RAW_POST), "s").withColumn("cluster", F.col("upvotes") % 2)
    writers.write_posts(posts, str(tmp_path / "p"), by_cluster=True)
    back = readers.read_parquet(spark, str(tmp_path / "p"))
    assert sorted(back.select(*posts.columns).drop("fetched_at").collect()) == sorted(posts.drop("fetched_at").collect())
    assert posts.where("fetched_at is null").count() == 0


def test_plan_documents(spark, tmp_path):
    plan = {
        "plan_id": 1, "prompt": "p", "communities": ["r/a"], "params": {"months": 3, "min_upvotes": 2, "limit": 9},
        "filters": {"keywords": ["k"]}, "topic_themes": [{"name": "n", "pain_points": ["x"]}],
    }
    (tmp_path / "plan.json").write_text(json.dumps(plan, indent=2))
    plans = readers.read_json_document(spark, str(tmp_path / "plan.json"))
    row = plans.first()
    assert row.communities == ["r/a"] and row.params.months == 3 and row.topic_themes[0].pain_points == ["x"]
    writers.write_plans(plans, str(tmp_path / "plans"))
    assert spark.read.schema(schemas.PLAN).json(str(tmp_path / "plans")).first() == row


def test_report_keeps_line_order(spark, tmp_path):
    lines = spark.range(200).repartition(8).select((200 - F.col("id")).alias("line_no"), F.concat(F.lit("l"), 200 - F.col("id")).alias("line"))
    writers.write_report(lines, str(tmp_path / "r"))
    files = sorted((tmp_path / "r").glob("part-*"))
    assert [l for f in files for l in f.read_text().split()] == [f"l{i}" for i in range(1, 201)]


def test_missing_columns_and_text(spark):
    bare = spark.createDataFrame([("a", None)], "id string, title string")
    row = readers.with_defaults(bare).first()
    assert (row.title, row.selftext, row.upvotes, row.num_comments) == ("", "", 0, 0)
    posts = spark.createDataFrame([("t", None)], "title string, selftext string")
    assert readers.with_text(posts).first().text == "t "
    assert readers.empty_posts(spark).schema == schemas.ANALYSED_POST


def test_numbers_in_text_do_not_fail(spark):
    rows = [("a", "12.7", "x"), ("b", None, None), ("c", "3", "5")]
    posts = spark.createDataFrame(
        [(i, "a long enough title", "and a body to go with it", u, n) for i, u, n in rows],
        "id string, title string, selftext string, upvotes string, num_comments string",
    )
    found = {r.id: (r.upvotes, r.num_comments) for r in prepared(posts).collect()}
    assert found == {"a": (12, 0), "b": (0, 0), "c": (3, 5)}


def test_the_first_copy_counts_even_if_excluded(spark):
    raw = spark.createDataFrame(
        [("a", "s", 20.0, "a title of some length", "a bad body of text", None, 50, 1),
         ("a", "s", 10.0, "a title of some length", "a good body of text", None, 50, 1)],
        schemas.RAW_POST,
    )
    assert ingest.ingest(raw, fixed.lexicon_table(spark), exclude=["bad"]).count() == 0


def test_no_id_is_written_twice(spark, tmp_path):
    """Three runs with ids that come again long after; a batch that is done again changes nothing."""
    raw = spark.createDataFrame(_raw_rows(60), schemas.RAW_POST).cache()
    nameless = raw.limit(3).withColumn("id", F.lit(None).cast("string"))
    lexicon = fixed.lexicon_table(spark)
    source, out = tmp_path / "in", str(tmp_path / "out")
    for part in range(3):
        later = raw.where(F.col("num_comments") % 3 == part).unionByName(raw.where("num_comments < 20")).unionByName(nameless)
        later.withColumn("selftext", F.concat("selftext", F.lit(f" in run {part}"))).coalesce(1).write.mode("append").json(str(source))
        stream = ingest.read_stream(spark, str(source), 1)
        ingest.write_once(stream, lexicon, out, str(tmp_path / "state"), 10, exclude=["number 7"]).awaitTermination()
    ids = lambda name: [r.id for r in spark.read.parquet(f"{out}/{name}").collect()]
    assert len(ids("posts")) == len(set(ids("posts"))) and len(ids("ledger")) == len(set(ids("ledger")))
    batch = ingest.ingest(raw, lexicon, 10, exclude=["number 7"])
    assert {i for i in ids("posts") if i} == {r.id for r in batch.collect()}
    runs = {r.id: r.selftext[-1] for r in spark.read.parquet(f"{out}/posts").collect() if r.id}
    first = {r.id: str(0 if r.num_comments < 20 else r.num_comments % 3) for r in raw.collect()}
    assert runs and all(first[i] == run for i, run in runs.items())


def test_stream_equals_batch(spark, tmp_path):
    raw = spark.createDataFrame(_raw_rows(90), schemas.RAW_POST).cache()
    lexicon = fixed.lexicon_table(spark)
    source = tmp_path / "in"
    for part in range(3):
        piece = raw.where(F.col("num_comments") % 3 == part).unionByName(raw.where("num_comments < 10"))
        piece.coalesce(1).write.mode("append").json(str(source))
        stream = ingest.ingest(ingest.read_stream(spark, str(source), 1), lexicon, 10, exclude=["number 7"])
        ingest.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out")).drop("fetched_at")
    batch = ingest.ingest(raw, lexicon, 10, exclude=["number 7"]).drop("fetched_at")
    assert sorted(streamed.collect()) == sorted(batch.select(*streamed.columns).collect())
    assert streamed.count() == 77
