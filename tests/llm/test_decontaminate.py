"""Against brute force, by both ways of finding windows."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from documents_fixture import documents  # noqa: F401
from postlens.llm import decontaminate as d

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return _WORD.findall((text or "").encode().lower())


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(item)
    out = []
    for doc, text in rows:
        w, hit, seen = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    seen |= windows[tuple(w[k : k + n])]
        ids = sorted(str(x) for x in seen if x is not None)
        digest = hashlib.sha256(",".join(ids).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(8)
    vocabulary = [rng.choice(["Übung", "the", "OF", "walk", "x1", "longestword", "a-b", "it's"]) + rng.choice(["", "s", "é"]) for _ in range(60)]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--", "\x00"]) for _ in range(n))
    items = [(i, text(rng.choice([3, 12, 13, 14, 40]))) for i in range(12)]
    items += [(100, None), (101, ""), (102, "?!"), (None, "null item words"), (1, items[1][1]), (103, items[2][1])]
    rows = []
    for i in range(40):
        item = rng.choice(items)[1] or ""
        rows.append((i, text(rng.randrange(0, 60)) + " " + (item.upper() if i % 2 else item) + " " + text(rng.randrange(0, 400))))
    rows += [(200, None), (201, ""), (202, "..."), (None, items[0][1]), (203, items[0][1] * 3), (203, items[0][1] * 3), (204, "null item words")]
    rows += [(205, "filler " * 20000 + items[3][1]), (206, "kelvin K İ words")]
    return rows, items


@pytest.mark.parametrize("bound", [d.MAX_WINDOWS, 0])
def test_contamination_matches_brute_force(spark, documents, bound):
    rows, items = cases()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = d.contamination(documents(rows), benchmark, max_windows=bound).drop("hits").collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows, items)


def test_hits_of_a_large_benchmark_do_not_rest_on_hashes(spark, documents, monkeypatch):
    rows, items = cases()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    few = lambda w: (F.pmod(F.xxhash64(w), F.lit(5)).alias("h1"), F.lit(1).alias("h2"))
    monkeypatch.setattr(d, "_hashes", few)
    rows = [(i, text) for i, text in rows if len(text or "") < 2000]
    found = d.contamination(documents(rows), benchmark, max_windows=0).drop("hits").collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows, items)


@pytest.mark.parametrize("bound", [d.MAX_WINDOWS, 0])
def test_empty_tables(spark, documents, bound):
    nothing = spark.createDataFrame([], "item_id long, text string")
    found = d.contamination(documents([(1, "a b"), (2, None)]), nothing, max_windows=bound).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in found) == [(1, 2, 0, False), (2, 0, 0, False)]
    assert d.contamination(documents([]), nothing, max_windows=bound).count() == 0


def test_removal_of_documents_and_spans(spark, documents):
    rows, items = cases()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(rows)
    bad = {i for i, *_, yes in brute(rows, items) if yes}
    kept = d.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(i) for i, _ in rows if i not in bad)
    cut = d.decontaminate(docs, benchmark, remove="spans")
    assert cut.columns == docs.columns and cut.count() == len(rows)
    short = spark.createDataFrame([(1, "Keep THIS: bad words here, and (this).")], "doc_id long, text string")
    item = spark.createDataFrame([(1, "bad words here")], "item_id long, text string")
    assert d.decontaminate(short, item, remove="spans").first().text == "Keep THIS: and (this)."
    with pytest.raises(ValueError):
        d.decontaminate(short, item, remove="all")


def test_no_python_on_the_way(spark, documents):
    rows, items = cases()
    df = d.contamination(documents(rows), spark.createDataFrame(items, "item_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
