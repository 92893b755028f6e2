from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from postlens import fixed_values as fixed
from postlens.operators import cluster, features, sentiment, summarise, wordcount
from postlens.plans import flows

LEXICON = {"good": 1.9, "bad": -2.5, "awful": -3.0, "but": 0.1, "rather": 0.2, "hardly": -0.4}


def _compound(total):
    return round(total / math.sqrt(total * total + 15), 4)


RULE_CASES = [
    ("", 0), ("nothing to see", 0), ("it is bad", -2.5), ("it is very bad", -2.5 - 0.293),
    ("it is not bad", -2.5 * -0.74), ("it is not very bad", (-2.5 - 0.293) * -0.74),
    ("a BAD day", -2.5 - 0.733), ("A BAD DAY", -2.5), ("it is bad!!", -2.5 - 0.584), ("is it bad??", -2.5 - 0.36),
    ("is it bad?????", -2.5 - 0.96), ("bad!!!!!!", -2.5 - 4 * 0.292),
    ("it is VERY bad", -2.5 - 0.293 - 0.733), ("it is slightly bad", -2.5 + 0.293),
    ("bad but good", -2.5 * 0.5 + 0.1 + 1.9 * 1.5),
    ("can't be so awful, good", (-3.0 - 0.293) * (-0.74) + 1.9 + 0.293 * 0.95),
    ("good good", 3.8), ("very", 0.0), ("hardly", 0.0), ("hardly bad", -2.5), ("rather hardly", 0.2),
]


def test_rule_sentiment(spark):
    lexicon = spark.createDataFrame(list(LEXICON.items()), "token string, valence double")
    posts = spark.createDataFrame([(text, text) for text, _ in RULE_CASES], "id string, text string")
    found = {r.id: r.sentiment for r in sentiment.with_sentiment(posts, lexicon).collect()}
    assert found == pytest.approx({text: _compound(total) for text, total in RULE_CASES}, abs=2e-4)


def test_large_lexicons_score_the_same(spark):
    rng = random.Random(1)
    vocabulary = list(LEXICON) + fixed.NEGATIONS[:5] + fixed.AMPLIFIERS[:5] + ["VERY", "BAD", "day", "but", "ünder", "!"]
    posts = spark.createDataFrame(
        [(f"p{i}", " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 25)))) for i in range(200)],
        "id string, text string",
    )
    lexicon = spark.createDataFrame(list(LEXICON.items()), "token string, valence double")
    for rules in (True, False):
        inline = {r.id: r.sentiment for r in sentiment.with_sentiment(posts, lexicon, rules).collect()}
        joined = {r.id: r.sentiment for r in sentiment.with_sentiment(posts, lexicon, rules, max_inline=1).collect()}
        assert inline == pytest.approx(joined, abs=1e-4) and len(inline) == 200


def _documents(n=60, seed=7):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["the", "Éa", "x"]
    return [(f"d{i}", " ".join(rng.choice(words) for _ in range(rng.randrange(0, 15)))) for i in range(n)]


def _grams(text, stop):
    words = [w for w in text.lower().split() if len(w) > 1 and w not in stop]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def test_tfidf_matches_its_formula(spark):
    docs = _documents()
    termed = features.with_terms(spark.createDataFrame(docs, "id string, text string"), ["the"])
    model = features.TfIdf.fit(termed, min_docs=3, max_share=0.5, size=40)
    counts = {i: Counter(_grams(text, {"the"})) for i, text in docs}
    df, total = Counter(), Counter()
    for c in counts.values():
        df.update(c.keys())
        total.update(c)
    usable = [w for w in df if 3 <= df[w] <= 0.5 * len(docs)]
    kept = set(sorted(usable, key=lambda w: (-total[w], w))[:40])
    assert set(model.terms) == kept
    found = {(r.id, r.term): r.tfidf for r in model.long_form(model.transform(termed), spark).collect()}
    expected = {}
    for i, c in counts.items():
        row = {w: n * (math.log((1 + len(docs)) / (1 + df[w])) + 1) for w, n in c.items() if w in kept}
        norm = math.sqrt(sum(v * v for v in row.values()))
        expected.update({(i, w): v / norm for w, v in row.items()})
    assert found == pytest.approx(expected)


def test_vocabulary_counts_pairs_of_possible_winners_only(spark, monkeypatch):
    docs = [*_documents(), ("d1", "w1 w1 w1 w2"), (None, None), ("e", "w1\u00e9 w1\u00e9"), *_documents(20, 3)]
    termed = features.with_terms(spark.createDataFrame(docs, "id string, text string").repartition(3), ["the"])
    counted = []
    plain = features.pair_counts
    monkeypatch.setattr(features, "pair_counts", lambda df, words, known: counted.append(known) or plain(df, words, known))
    whole = features.term_counts(termed)
    for min_docs, max_share, size in ((2, 0.7, 9), (5, 0.3, 40), (1, 1.0, 10_000), (0, 1.0, 1), (3, 0.0, 5)):
        limits = {"min_docs": min_docs, "max_share": max_share, "size": size}
        expected = sorted(map(tuple, features.vocabulary(whole, len(docs), **limits).collect()))
        for max_known in (200_000, 2):
            found = features.fitted_vocabulary(termed, len(docs), max_known=max_known, **limits)
            assert sorted(map(tuple, found.select("term", "docs", "total").collect())) == expected
    assert 0 < len(counted[0]) < 15 and counted[1] is None
    del counted[:]
    assert features.fitted_vocabulary(termed, len(docs), min_docs=10**9).count() == 0 and not counted
    # Terms that are not those of the words any more are counted as they are.
    own = termed.withColumn("terms", F.array(F.lit("x y")))
    assert [tuple(r) for r in features.fitted_vocabulary(own, len(docs), max_share=1.0).collect()] == [("x y", len(docs), len(docs))]


def test_words_are_counted_in_tables_of_bounded_size(monkeypatch):
    monkeypatch.setattr(wordcount, "WORDS_AT_ONCE", 4)
    rows = [["a", "b"], None, [], ["a"] * 9, ["b", "a", "b"], ["c"]]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], ["w"])
    tables = list(wordcount.gathered(iter([batch.slice(0, 2), batch.slice(2)]), "w"))
    assert [row for t in tables for row in t.column("w").to_pylist()] == rows
    assert all(t.num_rows == 1 or sum(len(w or []) for w in t.column("w").to_pylist()) <= 4 for t in tables)


def test_top_terms_do_not_depend_on_the_name_of_the_group(spark):
    posts = spark.createDataFrame(_documents(), "id string, text string").withColumn("cluster", F.length("text") % 2)
    by_cluster = summarise.top_terms(posts, stop_words=["the"]).collect()
    by_other = summarise.top_terms(posts.withColumnRenamed("cluster", "topic"), "topic", ["the"]).collect()
    assert sorted(map(tuple, by_cluster)) == sorted(map(tuple, by_other)) and len(by_cluster) == 20


def _top_terms(rows, stop, vocabulary, n):
    """By a plain calculation, each row a document of its own."""
    out = []
    for g in {r[1] for r in rows}:
        docs = [Counter(w for w in r[2].lower().split() if len(w) > 1 and w not in stop) for r in rows if r[1] == g]
        df, total, mean = Counter(), Counter(), Counter()
        for d in docs:
            df.update(d.keys())
            total.update(d)
        kept = sorted(total, key=lambda t: (-total[t], t))[:vocabulary]
        for d in docs:
            w = {t: d[t] * (math.log((len(docs) + 1) / (df[t] + 1)) + 1) for t in kept if d[t]}
            length = math.sqrt(sum(x * x for x in w.values()))
            for t, x in w.items():
                mean[t] += x / length / len(docs)
        ranked = sorted(mean, key=lambda t: (-round(mean[t], 9), t))[:n]
        out += [(g, i, t, round(mean[t], 7)) for i, t in enumerate(ranked, 1)]
    return sorted(out, key=repr)


def test_top_terms_take_each_row_as_a_document(spark):
    """Ids that are null or repeat, in one group or in two, and a group without a name."""
    texts = [t for _, t in _documents(80, 3)]
    rows = [((None, "a", f"d{i % 5}")[i % 3], (None, 1, 2)[i % 7 % 3], t) for i, t in enumerate(texts)]
    posts = spark.createDataFrame(rows, "id string, cluster int, text string")
    for options in ({}, {"max_pairs": 0}):
        found = summarise.top_terms(posts, stop_words=["the"], vocabulary=8, n=6, **options)
        got = sorted(((r.cluster, r["rank"], r.term, round(r.weight, 7)) for r in found.collect()), key=repr)
        assert got == _top_terms(rows, {"the"}, 8, 6)
    plan = summarise.top_terms(posts, stop_words=["the"])._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(id" in line]


def test_gap_examples_without_ids(spark, tmp_path):
    """Posts without id, or with another's, keep their own phrases; a stored table gives the same."""
    rows = [(None, 0, 100 - i, f"i can't do it{i}") for i in range(6)] + [("a", 1, 50, "i can't see"), ("a", 1, 40, "i can't hear"), ("a", 0, 10, "fine")]
    posts = spark.createDataFrame(rows, "id string, cluster int, created_utc long, text string")
    posts.write.parquet(str(tmp_path / "posts"))
    expected = [(0, i + 1, f"i can't do it{i}") for i in range(4)] + [(1, 1, "i can't see"), (1, 2, "i can't hear")]
    for table in (posts, spark.read.parquet(str(tmp_path / "posts"))):
        assert sorted(map(tuple, summarise.gap_examples(table, read=4).collect())) == expected


def test_lexicons_of_any_kind_score_the_same_inline_and_joined(spark):
    rows = [(f"w{i}", (i - 1000) / 500) for i in range(2000)] + [("w7", 3.5), ("w7", -3.5), (None, 1.0), ("w8", None)]
    lexicon = spark.createDataFrame(rows, "token string, valence double")
    posts = spark.createDataFrame(
        [(None, "w1 and w7"), (None, "w1 and w7"), (None, "w9 w1999!"), ("a", "not W7"), ("a", "w8 but w3"), ("b", ""), ("c", None)],
        "id string, text string",
    )
    for rules in (True, False):
        inline = sentiment.with_sentiment(posts, lexicon, rules).collect()
        joined = sentiment.with_sentiment(posts, lexicon, rules, max_inline=1).select("id", "text", "sentiment").collect()
        assert sorted(map(repr, inline)) == sorted(map(repr, joined)) and len(inline) == 7


def _silhouette(points, labels):
    def d(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b))

    scores = []
    for p, own in zip(points, labels):
        mean = {}
        for g in set(labels):
            others = [q for q, l in zip(points, labels) if l == g and q is not p]
            mean[g] = sum(d(p, q) for q in others) / len(others) if others else None
        a, b = mean.pop(own), min(v for v in mean.values())
        scores.append(0.0 if a is None else (b - a) / max(a, b))
    return sum(scores) / len(scores)


def test_silhouette(spark):
    rng = random.Random(2)
    points = [[rng.gauss(3 * (i % 3), 1), rng.gauss(0, 1)] for i in range(40)]
    labels = [i % 3 for i in range(39)] + [7]
    rows = [(Vectors.dense(p), g) for p, g in zip(points, labels)]
    df = spark.createDataFrame(rows, ["features", "cluster"])
    assert cluster.silhouette(df) == pytest.approx(_silhouette(points, labels))
    assert cluster.silhouette(df.where("cluster = 0")) is None


def test_best_k_and_its_guards(spark):
    rng = random.Random(4)
    rows = [(Vectors.dense([10.0 * (i % 3) + rng.random(), rng.random()]),) for i in range(60)]
    vectors = spark.createDataFrame(rows, ["features"])
    model, k = cluster.best_k(vectors, 2, 5, n_init=2, max_iter=20)
    assert k == 3 and len(model.clusterCenters()) == 3
    posts = spark.createDataFrame(_documents(), "id string, text string")
    for few in (posts.limit(0), posts.limit(1), posts.limit(7)):
        alone, k = cluster.clustered(few, 4, 7, ["the"], min_docs=1, max_share=1.0, n_init=1)
        assert k == 1 and {r.cluster for r in alone.collect()} <= {0}
    alone, k = cluster.clustered(posts, 2, 3, ["the"], min_docs=1000)
    assert k == 1 and alone.count() == 60


def _far_and_lloyd(rows, k, rounds):
    """A plain calculation over ``(id, point)``."""
    d = lambda p, c: round(sum((a - b) ** 2 for a, b in zip(p, c)), 9)
    centres = [min(rows)[1]]
    while len(centres) < k:
        away = min(rows, key=lambda r: (-min(d(r[1], c) for c in centres), r))
        if min(d(away[1], c) for c in centres) == 0:
            break
        centres.append(away[1])
    label = lambda p: min(range(len(centres)), key=lambda j: (d(p, centres[j]), j))
    for _ in range(rounds):
        groups = [[p for _, p in rows if label(p) == j] for j in range(len(centres))]
        centres = [[sum(x) / len(g) for x in zip(*g)] if g else c for g, c in zip(groups, centres)]
    return {i: label(p) for i, p in rows}


def test_centres_that_start_far_apart(spark):
    rng = random.Random(6)
    rows = [(f"p{i:03}", [0.0 if rng.random() < 0.5 else rng.gauss(4 * (i % 3), 1) for _ in range(6)]) for i in range(80)]
    rows += [(f"q{i}", [0.0] * 6) for i in range(4)] + [("r0", rows[5][1]), ("r1", rows[5][1])]
    sparse = lambda p: Vectors.sparse(6, [(j, x) for j, x in enumerate(p) if x])
    for kind in (Vectors.dense, sparse):
        vectors = spark.createDataFrame([(i, kind(p)) for i, p in rows], ["id", "features"]).repartition(3)
        for k, rounds in ((1, 2), (4, 0), (5, 3)):
            centres = cluster.fit_from_far(vectors, k, rounds)
            found = cluster.labelled(cluster.points(vectors, "features", "id"), centres).collect()
            assert {r.id: r.cluster for r in found} == _far_and_lloyd(rows, k, rounds)
    few = spark.createDataFrame([("a", Vectors.dense([1.0])), ("b", Vectors.dense([1.0])), ("c", Vectors.dense([2.0]))], ["id", "features"])
    assert len(cluster.fit_from_far(few, 3)) == 2 and len(cluster.fit_from_far(few.limit(0), 3)) == 0
    assert len(cluster.best_k_from_far(few, 2, 3)) == 2


def test_rounds_from_far_points_move_sums_not_entries(spark):
    rows = [(f"p{i:03}", Vectors.dense([float(i % 7), 1.0, 0.0])) for i in range(200)]
    points = cluster.points(spark.createDataFrame(rows, ["id", "features"]).repartition(4), "features", "id")
    centres = np.array([[0.0, 1.0, 0.0], [6.0, 1.0, 0.0]])
    sums = cluster._sums(points, centres).collect()
    assert len(sums) <= 4 * 2 * (3 + 1) and sum(r.x for r in sums if r.i == -1) == 200
    assert sum(r.x for r in sums if r.i == 0) == sum(i % 7 for i in range(200))
    assert {r.distance for r in cluster._farthest(points, centres).collect()} == {9.0}


def test_best_runs_are_fitted_side_by_side(spark):
    rng = random.Random(8)
    thin = lambda: Vectors.sparse(50, {rng.randrange(50): 1.0, 3: rng.random()})
    vectors = spark.createDataFrame([(thin(),) for _ in range(60)], ["features"])
    alone = [KMeans(k=3, seed=42 + run, maxIter=9).fit(vectors).summary.trainingCost for run in range(4)]
    assert cluster._solver(vectors, "features") == "row"
    assert cluster.fit_kmeans(vectors, 3, n_init=4, max_iter=9).summary.trainingCost == pytest.approx(min(alone))
    assert [len(m.clusterCenters()) for m in cluster._best_fits(vectors, [2, 4], n_init=2, max_iter=5)] == [2, 4]


def test_clusters_from_far_points(spark):
    posts = spark.createDataFrame([*_documents(), (None, "w1 w2 w3"), (None, "w1 w2 w3")], "id string, text string")
    runs = []
    for parts in (1, 5):
        found, k = cluster.clustered(posts.repartition(parts), 2, 4, ["the"], min_docs=2, start="far", rounds=5)
        runs.append(sorted(map(repr, found.select("id", "text", "cluster").collect())))
        assert found.count() == 62 and 2 <= k <= 4
    assert runs[0] == runs[1]
    with pytest.raises(ValueError):
        cluster.clustered(posts, start="near")


def test_clusters_are_repeatable(spark):
    posts = spark.createDataFrame(_documents(), "id string, text string").where("length(text) > 0")
    runs = []
    for _ in range(2):
        labelled, k = cluster.clustered(posts, 2, 4, ["the"], min_docs=2, n_init=2, max_iter=20)
        runs.append({r.id: r.cluster for r in labelled.collect()})
        assert set(runs[-1].values()) <= set(range(k)) and len(runs[-1]) == posts.count()
    assert runs[0] == runs[1]


def test_gap_examples(spark):
    rows = [(f"p{i}", 0, 1000 - i, f"i can't do thing{i % 12}. i wish there was x{i}") for i in range(30)]
    rows.append(("q", 1, 5, "fine"))
    posts = spark.createDataFrame(rows, "id string, cluster int, created_utc long, text string")
    found = summarise.gap_examples(posts, read=4, n=3).orderBy("pos").collect()
    assert [(r.pos, r.gap) for r in found] == [
        (1, "i wish there was x0"), (2, "i can't do thing0"), (3, "i wish there was x1")
    ]


def _posts(spark, n):
    rng = random.Random(9)
    words = "app crash slow price export sync login battery screen update widget theme trash please".split()
    rows = [
        (f"p{i}", "r/a", 1000 + i, f"title number {i}", " ".join(rng.choice(words) for _ in range(20)) + ". i can't log in",
         f"http://{i}", i, i % 7)
        for i in range(n)
    ]
    kind = "id string, community string, created_utc long, title string, selftext string, url string, upvotes int, num_comments int"
    return spark.createDataFrame(rows, kind)


def test_analyse_end_to_end(spark):
    lexicon = fixed.lexicon_table(spark)
    analysed, summaries, report = flows.analyse(
        _posts(spark, 60), lexicon, 2, 3, stop_words=["in"], min_docs=2, n_init=1, max_iter=10
    )
    sizes = summaries.select("size", "top_terms", "sample_posts", "gap_examples").collect()
    assert sum(r["size"] for r in sizes) == analysed.count() == 60
    assert all(len(r.top_terms) == 10 and len(r.sample_posts) == min(5, r["size"]) for r in sizes)
    assert analysed.where("pain_score < 0 or sentiment not between -1 and 1").count() == 0
    lines = [r.line for r in report.orderBy("line_no").collect()]
    assert lines[:4] == ["# Pain Map", "- Items: **60**", f"- Clusters: **{len(sizes)}**", ""]
    assert lines[4].startswith("## Cluster 0 — size ") and "- i can't log in" in lines
    assert sum(line.startswith("- [title number") for line in lines) == sum(len(r.sample_posts) for r in sizes)


def test_analysed_posts_are_stored(spark):
    """Summaries read columns of stored rows; they do not look for the clusters again."""
    analysed, _, _ = flows.analyse(
        _posts(spark, 60), fixed.lexicon_table(spark), 2, 3, stop_words=["in"], min_docs=2, start="far", rounds=1
    )
    plan = analysed.select("id", "cluster")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "ReadSchema: struct<id:string,cluster:int>" in plan


def test_top_terms_shuffle_sums_of_tasks(spark):
    posts = spark.createDataFrame([(i % 2, "w1 w2 w2") for i in range(100)], "cluster int, text string").repartition(4)
    words = posts.select("cluster", features.unigrams(F.col("text"), ["the"]).alias("terms"))
    groups = spark.createDataFrame([(0, 0), (1, 1)], "_group int, _number int")
    weights = np.array([[3.0, 2.0], [1.0, 0.0]])
    found = summarise._shares_in_tasks(words, "cluster", pa.array(["w1", "w2"]), weights, groups)
    sums = {(r.cluster, r.term): r.share for r in found.collect()}
    assert sums == pytest.approx({(0, "w1"): 50 * 0.6, (0, "w2"): 50 * 0.8, (1, "w1"): 50.0})
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert summarise.top_terms(posts, stop_words=["the"]).count() == 4


def test_analyse_nothing(spark):
    analysed, summaries, report = flows.analyse(_posts(spark, 0), fixed.lexicon_table(spark), 2, 3)
    lines = [r.line for r in report.orderBy("line_no").collect()]
    assert analysed.count() == 0 and summaries.count() == 0
    assert lines == ["# Pain Map", "- Items: **0**", "- Clusters: **0**", "\n> No english/long enough posts"]
