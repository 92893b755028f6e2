"""Many terms in many posts: exact look-up, blocks of rows, one stored row per post."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from postlens.operators import lookup, termjoin


def _texts(rng, letters, n, longest, least=0):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(least, longest))) for _ in range(n)]


def test_lookup_finds_what_in_finds(monkeypatch):
    rng = random.Random(3)
    terms = sorted({*_texts(rng, "abcdeß é\n", 200, 6, 1), "abcd" * 12, "\n", "　", "d" * 30})
    texts = [*_texts(rng, "abcdeß  \n　é", 200, 120), "x" + "abcd" * 12 + "y", "abcd" * 11, "d" * 29, ""]
    expected = [[i for i, term in enumerate(terms) if term in text] for text in texts]
    monkeypatch.setattr(lookup, "_CHARACTERS_AT_ONCE", 50)
    monkeypatch.setattr(lookup, "_WORDS_KEPT", 40)
    found = lookup.Lookup(pa.array(terms))
    assert [x.tolist() for low in range(0, len(texts), 50) for x in found.numbers(texts[low : low + 50])] == expected
    none = lookup.Lookup(pa.array(["\n"]))
    assert [x.tolist() for x in none.numbers(["a", "a\nb"])] == [[], [0]]


def test_a_block_meets_lists():
    rng = random.Random(4)
    rows = [np.array(sorted(rng.sample(range(30), rng.randrange(9))), np.int64) for _ in range(150)]
    rows += [np.array([3, 29], np.int64)] * 50  # frequent terms are kept as bits
    lists = [np.array(sorted(rng.sample(range(40), rng.randrange(1, 6)))) for _ in range(2500)]
    block = lookup.Block.of(rows)
    again = lookup.Block(*(lookup.unpacked(lookup.packed(x), x.dtype.type) for x in (block.terms, block.ends.astype(np.uint32), block.rows)), 200)
    for some in (block, again):
        for low, met in some.met((np.cumsum([len(x) for x in lists]), np.concatenate(lists))):
            owner, row = lookup.first_rows(met, np.full(len(met), 4))
            for i, bits in enumerate(met):
                expected = [r for r, x in enumerate(rows) if set(x) & set(lists[low + i])]
                assert np.bitwise_count(bits).sum() == len(expected) and row[owner == i].tolist() == expected[:4]


def test_a_post_is_stored_once_however_many_terms_it_has(spark, monkeypatch):
    """The numbers of its terms stand in its row; groups with equal terms are one list, split over several passes or not."""
    posts = [(f"p{i}", f"c{i % 3}" if i % 7 else None, i, " ".join(f"w{j}x" for j in range(i % 40))) for i in range(90)]
    wanted = [(g, f"w{(g // 2 + j) % 45}x") for g in range(0, 60) for j in range(3)] + [(None, "w1x"), (99, "none")]
    posts_df = spark.createDataFrame(posts, "id string, community string, at long, text string").repartition(3)
    terms_df = spark.createDataFrame(wanted, "plan_id long, term string")
    lists = {}
    for g, term in wanted:
        lists.setdefault(g, set()).add(term)
    of = {g: [p for p in posts if terms & set(p[3].split())] for g, terms in lists.items()}
    firsts = {(g, r): p[0] for g, found in of.items() for r, p in enumerate(sorted(found, key=lambda p: -p[2])[:12], 1)}
    values = {}
    for g, found in of.items():
        for p in sorted(found, key=lambda p: -p[2])[:12]:
            values[g, p[1]] = values.get((g, p[1]), 0) + 1
    monkeypatch.setattr(termjoin, "_TILE_ROWS", 16)
    monkeypatch.setattr(termjoin, "_TILE_GROUPS", 20)
    monkeypatch.setattr(termjoin, "_TAKEN_ROWS", 100)
    for at_once in (1_000_000, 20):
        monkeypatch.setattr(termjoin, "_TERMS_A_PASS", at_once)
        found = termjoin.Matches(posts_df, terms_df, "plan_id", ["id", "community", "at"], max_groups=0)
        assert {r.plan_id: r.n for r in found.counts().collect()} == {g: len(rows) for g, rows in of.items() if rows}
        assert {(r.plan_id, r["rank"]): r.id for r in found.first([F.desc("at")], 12).collect()} == firsts
        assert {(r.plan_id, r.community): r.n for r in found.first_counts([F.desc("at")], 12, "community").collect()} == values
        assert found._hits.count() <= len(posts) * len(found._passes) and found._lists.count() < 60
    assert len(found._passes) > 1
