"""Source divergence, filter interactions and embedding near-duplicates against brute force."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.llm import divergence, interactions, neardup

DOCS = "doc_id long, text string, lang string, source string"


def _docs(spark, rows):
    """The rows with more columns, whose names the operators use inside."""
    extra = ("id", "part", "mask", "h", "segment", "term", "n", "docs", "bucket", "block", "p", "good", "v", "cell")
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in extra})


# --- source divergence -------------------------------------------------------------------------------

def _expected_divergence(rows, least_docs, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")) for _, text, lang, source in rows]
    docs = [(lang, source, ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]) for lang, source, words in docs]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        kept = [t for t, n in Counter(t for _, _, w in own for t in set(w)).items() if n >= least_docs]
        groups = {s: Counter() for _, s, _ in own}
        for _, s, w in own:
            groups[s].update(t for t in w if t in kept)
        whole = sum(groups.values(), Counter())
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        for s, counts in groups.items():
            p, q = shares(counts), shares(whole)
            pairs = [(o, sum(abs(p[t] - x) for t, x in shares(c).items())) for o, c in groups.items() if o != s]
            terms = [(t, p[t] - q[t]) for t in kept if counts[t] and p[t] > q[t]]
            for part, found, n in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:n]
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def _corpus():
    rng = np.random.default_rng(1)
    words = [f"{a}{b}" for a in ("Wort", "wört", "x", "Éa", "\U0001F600", "ｚ") for b in ("a", "b", "cc", "É", "é", "q", "z")]
    rows = []
    for i in range(300):
        source = None if i % 3 == 0 else f"s{i % 7}"
        some = rng.choice(words, size=int(rng.integers(0, 25)), p=np.arange(1, len(words) + 1) / (len(words) * (len(words) + 1) / 2))
        rows.append((i if i % 5 else None, "1".join(some) + ". x\u0085y-Z", ["en", "de", None][i % 3 if i % 2 else 0], source))
    return rows + [(1000, None, "en", "empty"), (1001, "", "fr", "a"), (1002, "only Once", "fr", "b"), (1003, "1 2\t3", "fr", ""),
                   (1004, "Long " * 50_000, "en", "s1"), (1005, "lone", "it", "one"), (7, "x y", "en", "s1"), (7, "x y", "en", "s1")]


@pytest.mark.parametrize("blocks", [{}, {"term_block": 3, "source_block": 2}])
def test_divergence(spark, blocks):
    rows = _corpus()
    found = divergence.divergence(_docs(spark, rows), least_docs=10, top=6, **blocks)
    assert sorted(map(tuple, found.collect())) == _expected_divergence(rows, 10, 6)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_divergence_hands_counters_on_and_keeps_counts(spark, monkeypatch):
    rows = _corpus()
    small = divergence._counted.__globals__
    monkeypatch.setitem(small, "_HELD", 5)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({c: pa.array([r[i] or "" for r in rows]) for c, i in (("text", 1), ("lang", 2), ("source", 3))})
    parts = pa.Table.from_batches(list(divergence._counted(iter([batch, batch.slice(0, 0)])))).to_pylist()
    monkeypatch.setitem(small, "_HELD", 400_000)
    whole = pa.Table.from_batches(list(divergence._counted(iter([batch])))).to_pylist()

    def added(table):
        total = Counter()
        for r in table:
            total[r["lang"], r["source"], r["term"]] += 1000 * r["n"] + r["docs"]
        return total

    assert len(parts) > len(whole) and added(parts) == added(whole)


def test_shares_are_exact_beyond_64_bits(spark):
    n, total, terms = 3 * 10**15 + 7, 10**16 + 1, 12_345
    row = spark.range(1).select(F.lit(n).alias("n"), F.lit(total).alias("total"), F.lit(terms).alias("terms"))
    assert row.select(F.expr(divergence._share("n", "total", "terms"))).first()[0] == 1 + 10**9 * (n + 5) // (total + 5 * terms)


def test_divergence_of_nothing(spark):
    assert divergence.divergence(_docs(spark, [])).count() == 0


# --- filter interactions -----------------------------------------------------------------------------

def _expected_interactions(rows, labels):
    least = {}
    for i, text, _, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    docs = []
    for i, text, lang, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)),
            "E": text in least and (i is None or least[text] < i),
        }
        docs.append((lang or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out = []
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        removed = Counter()
        lines = []
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [d for d in own if f in d[1] and not d[1] & before]
                removed[f] += len(gone)
                lines.append((
                    part, "".join(order), step, sum(not d[1] & (before | {f}) for d in own), len(gone),
                    sum(f in d[1] and bool(d[1] & before) for d in own), sum(d[1] == {f} for d in own),
                    sum(d[2] for d in gone), sum(d[3] for d in gone),
                ))
        out += [(*line, removed[line[1][line[2] - 1]]) for line in lines]
    return sorted(out)


def _odd_documents():
    long = " ".join(f"w{i}" for i in range(250))
    texts = [
        None, "", "  \t\n", "A B C", "a a a a", "é É x" * 80, long, long + " #", long + " " + "CAPS " * 40, "same " * 300, long.upper(),
        " ".join(["x"] * 10), "tail |", "x" * 300_000, long + "\x1c" + "one",
    ]
    rows = [(i, texts[i % len(texts)], [None, "", "en", "de"][i % 4], "s") for i in range(90)]
    return rows + [(None, long, "en", "s")] * 3 + [(None, "only nameless", "en", "s")] * 2 + [(None, "", None, "s"), (3, "A B C", "en", "s"), (6, long, "de", "s"),
                   (3, "another text of id 3", "en", "s")]


LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("counters", [interactions.MOST_COUNTERS, 512])
def test_interactions(spark, counters):
    """Also with a sketch too small for the table."""
    rows = _odd_documents()
    labels = [(i, i % 2, None if i % 3 else 1) for i in range(0, 60)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (5000, 1, 1), (8, None, None)]
    told = spark.createDataFrame(labels, LABELS).withColumns({"id": F.lit(1), "good": F.lit(7), "text": F.lit("x")})
    found = interactions.interactions(_docs(spark, rows), told, most_counters=counters)
    assert sorted(map(tuple, found.collect())) == _expected_interactions(rows, labels)


def test_interactions_of_little(spark):
    nothing = spark.createDataFrame([], LABELS)
    assert interactions.interactions(_docs(spark, []), nothing).count() == 0
    with pytest.raises(ValueError):
        interactions.masks(_docs(spark, []), most_counters=1000)
    one = interactions.interactions(_docs(spark, [(1, "x", None, None)]), nothing).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and sum(r.good_lost + r.toxic_lost for r in one) == 0


def test_sketch_clears_unique_texts(spark):
    """Of many texts that occur once nearly none is grouped; all that repeat are."""
    rows = [(i, f"text {i if i < 3000 else i % 100}", "en", "s") for i in range(3100)]
    h = interactions._hashes([r[1].encode() for r in rows])
    counters = interactions._counters(len(rows), interactions.LEAST_COUNTERS, interactions.MOST_COUNTERS)
    counts = np.bincount(interactions._places(h, counters).ravel().astype(np.int64), minlength=counters)
    possible = interactions._possible(h, np.packbits(counts > 1))
    assert possible[:100].all() and possible[3000:].all() and possible[100:3000].mean() < 0.05
    assert interactions._counters(10**12, 1 << 16, 1 << 28) == 1 << 28 and interactions._counters(0, 1 << 16, 1 << 28) == 1 << 16


# --- embedding near-duplicates -----------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def _expected_groups(rows, least):
    def usable(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    fine = [usable(v, label) for _, v, label in rows]
    unit = [np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) if f else None for (_, v, _), f in zip(rows, fine)]
    near = [[bool(fine[a] and fine[b]) and a != b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= least
             for b in range(len(rows))] for a in range(len(rows))]
    out = []
    for a in range(len(rows)):
        reach, todo = {a}, [a]
        while todo:
            todo = [b for x in todo for b in range(len(rows)) if near[x][b] and b not in reach and not reach.add(b)]
        ids = [rows[b][0] for b in reach if rows[b][0] is not None]
        low = min(ids) if ids else None
        out.append((rows[a][0], sum(near[a]), low, rows[a][0] == low))
    return sorted(out, key=repr)


def _vectors():
    rng = np.random.default_rng(3)
    rows = []
    for group, (copies, noise) in enumerate([(40, 0.02), (30, 0.035), (25, 0.05), (1, 0), (1, 0)] * 3):
        base = rng.normal(size=12)
        base /= np.linalg.norm(base)
        for c in range(copies):
            rows.append((len(rows) * 7 % 1000, (base + noise * rng.normal(size=12)).tolist(), group % 4 % 3))
    rows += [(len(rows) + i, rng.normal(size=12).tolist(), i % 3) for i in range(150)]
    one = rows[0][1]
    odd = [None, [], [0.0] * 12, [float("nan")] * 12, [float("inf")] + [1.0] * 11, [None] + [1.0] * 11, [0.0, -0.0]]
    rows += [(2000 + i, v, 1) for i, v in enumerate(odd)] + [(3000, one, None), (3001, one, None)]
    rows += [(3002, one, 0), (3002, one, 0), (None, one, 0), (None, one, 2), (None, one, 2), (3003, [5 * x for x in one], 0), (3004, one, 1)]
    rows += [(3005, [1.0, 0.0], 1), (3006, [1.0, -0.0], 1), (3007, [-1.0, 0.0], 1), (3008, [1e-30, 1e-32], 1), (3009, [3e38, 3e38], 1)]
    return rows


@pytest.mark.parametrize("settings", [{}, {"cells": 30, "block": 5}, {"least": 0.9, "cells": 6, "block": 9}, {"least": -0.5, "cells": 3}])
def test_near_duplicates(spark, settings):
    rows = _vectors()
    vectors = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(1) for c in ("id", "v", "n", "name", "m", "home", "cell", "low")})
    found = neardup.near_duplicates(vectors, **settings)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, found.collect()), key=repr) == _expected_groups(rows, settings.get("least", 0.98))


def test_no_vectors(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    only_odd = spark.createDataFrame([(1, None, 1), (None, [0.0], 2)], VECTORS)
    assert sorted(map(tuple, neardup.near_duplicates(only_odd).collect()), key=repr) == [(1, 0, 1, True), (None, 0, None, True)]


def test_visits_reach_every_similar_vector():
    """For random pairs at the bound, one of them always meets the other in a cell."""
    rng = np.random.default_rng(2)
    a = neardup.unit_rows(rng.normal(size=(4000, 8)))
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(axis=1)[:, None] * a
    b = 0.9 * a + np.sqrt(1 - 0.9**2) * neardup.unit_rows(side)
    centres = neardup.spherical_kmeans(a, 40, 0.7)
    (cell_a, visits_a), (cell_b, visits_b) = (neardup.cells_of(x, centres, 0.9) for x in (a, b))
    at = np.arange(len(a))
    met = (cell_a == cell_b).astype(int) + visits_a[at, cell_b] + visits_b[at, cell_a]
    assert (met == 1).all() and (cell_a != cell_b).mean() > 0.1 and visits_a.mean() < 0.4
    near = centres @ centres.T
    assert (near[~np.eye(len(centres), dtype=bool)] <= 0.7 + 1e-12).all()
