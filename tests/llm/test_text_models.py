from __future__ import annotations

import collections
import itertools
import math
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from documents_fixture import documents  # noqa: F401
from postlens.llm import language, licences, quality


def test_bradley_terry_finds_the_direction():
    draw = np.random.default_rng(0)
    better, worse = draw.normal(1, 1, (300, 3)), draw.normal(0, 1, (300, 3))
    better[:, 2], worse[:, 2] = 5, 5
    w = quality.bradley_terry(better, worse, pairs=5000)
    assert w[0] > 0.3 and w[1] > 0.3 and abs(w[2]) < 1e-6
    assert (quality.bradley_terry(better[:0], worse) == 0).all()


def _graded(spark, n=400):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["the", "of", "reading", "house", "green", "walks"]) for _ in range(rng.randrange(5, 80))) + "."
    bad = lambda: " ".join(rng.choice(["BUY!!", "### ###", "x | y |", "NOW!!"]) for _ in range(rng.randrange(5, 80)))
    rows = [(i, good() if i % 4 else bad(), int(i % 4 > 0)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_quality_of_held_out_documents(spark):
    docs = _graded(spark)
    found = quality.ranked(docs.drop("quality"), docs.select("doc_id", "quality")).join(docs, "doc_id").collect()
    assert len(found) == 400 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    held = [r for r in found if r.held_out]
    assert len(held) > 90 and sum(r.predicted == r.quality for r in held) / len(held) > 0.97


def test_quality_learns_nothing_from_the_held_out(spark):
    docs = _graded(spark)
    labels = docs.select("doc_id", "quality")
    flipped = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    plain, other = (sorted(map(tuple, quality.ranked(docs, x).collect())) for x in (labels, flipped))
    assert plain == other


def _plain_features(text):
    """The features of a text by plain loops, without the code under test."""
    data = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", data.lower()) if w]
    n = len(words)
    if not n:
        return [0.0] * len(quality.FEATURES)
    share = lambda k: math.log1p(100 * k / (n + 30))
    kinds = [share(sum(data.count(bytes([b])) for b in members)) for members in quality._KINDS.values()]
    runs = [len(list(g)) for _, g in itertools.groupby(words)]
    variety = math.log1p(len(set(words))) / math.log1p(n)
    size = len(data) / n
    return [*kinds, math.log1p(n), size, share(n - len(runs)), share(max(runs) - 1), variety, float(size < 4), float(size > 12)]


def test_quality_scores_equal_a_plain_calculation(spark):
    """Score and threshold from the weights by plain loops: repeated labels, tied texts and odd texts included."""
    docs = _graded(spark, 200).collect()
    rows = [(r.doc_id, r.text, r.quality) for r in docs] + [(200, docs[0].text, 0), (201, docs[0].text, 1), (202, "a  a\ta | B!", 0), (203, "", 1)]
    rows += [(204, None, 0), (205, "é ü " * 2000, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(4, 0), (4, 0), (5, None), (6, 7), (999, 1), (None, 0)], "doc_id long, quality int")
    model = quality.fit(table.select("doc_id", quality.features("text").alias("features")), labels)
    raw = {i: sum(w * x for w, x in zip(model.weights, _plain_features(text))) for i, text, _ in rows}
    for r in quality.ranked(table.drop("quality"), labels).collect():
        score = 1 / (1 + math.exp(model.threshold - raw[r.doc_id]))
        assert abs(r.score - score) < 1e-9 and (abs(score - 0.5) < 1e-9 or r.predicted == (score >= 0.5))
    # The threshold leaves the share of worse labels below it, as far as ties allow.
    known = [(raw[i], q) for i, q in labels.toLocalIterator() if q in (0, 1) and i in raw and zlib.crc32(str(i).encode()) % 3 != 1]
    worse = sum(q == 0 for _, q in known)
    below = sum(x < model.threshold - 1e-12 for x, _ in known)
    ties = collections.Counter(round(x, 9) for x, _ in known)
    assert worse <= below + 1e-9 < worse + max(ties.values())


def test_quality_odd_rows(documents, spark):
    rows = [(1, None), (1, ""), (2, " "), (None, "a b"), (3, "w " * 30000), (4, "##"), (4, "##")]
    labels = spark.createDataFrame([(1, None), (2, 7), (99, 1), (None, 0)], "doc_id long, quality int")
    found = quality.ranked(documents(rows), labels).collect()
    assert len(found) == 7 and {r.score for r in found} == {0.5}  # no pair of classes, so no weights
    assert quality.ranked(documents([]), labels).count() == 0
    kept = quality.keep_good(documents(rows), labels)
    assert kept.count() == 7 and kept.columns == documents(rows).columns


def _languages(spark):
    rng = random.Random(2)
    stems = {"aa": ["kato", "kita", "koto"], "bb": ["zuel", "zuem", "zuen"]}
    rows = []
    for i in range(300):
        lang = "aa" if i % 3 else "bb"
        rows.append((i, " ".join(rng.choice(stems[lang]) + rng.choice(["", "s", "n"]) for _ in range(12)), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages_of_held_out_documents(spark):
    docs = _languages(spark)
    found = language.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.lang_pred == r.lang and r.score > 0.9 for r in found) and sum(r.held_out for r in found) > 70


def test_unknown_words_back_off_to_shorter_n_grams(spark):
    model = language.fit(_languages(spark))
    new = spark.createDataFrame(
        [(1, "KATONITA"), (2, "xzue"), (3, None), (4, ""), (5, "12 !? ²½"), (6, "ж"), (None, "kita"), (6, "ж")], "doc_id long, text string"
    )
    found = sorted((r.lang_pred, r.doc_id or 0) for r in language.identified(new, model=model).collect())
    assert found == sorted([("aa", 1), ("bb", 2), ("und", 3), ("und", 4), ("und", 5), ("aa", 6), ("aa", 6), ("aa", 0)])
    assert model.tables[0].get("katonita") is None
    assert language.keep_known(_languages(spark).union(spark.createDataFrame([(1, "..", "aa")], "doc_id long, text string, lang string"))).count() == 300


def test_language_scores_equal_a_plain_calculation(spark):
    """Counts, smoothing, backing off and sums by plain loops over a few documents, words unseen in training included."""
    rng = random.Random(9)
    stems = {"aa": "lorem ipsum dolor amet sit".split(), "bb": "casa verde luna mar sol".split(), "cc": "haus baum mond see wind".split()}
    rows = [(i, " ".join(rng.choice(stems[lang]) + rng.choice(["", "s", "en"]) for _ in range(rng.randrange(1, 9))) + " 4!", lang)
            for i, lang in enumerate(rng.choices(sorted(stems), k=90))]
    rows += [(90, "Lunar baumhaus ipsumque", "aa"), (91, None, "aa"), (92, "12 -", "bb"), (93, "xyzzy", None), (94, "casa " * 3, "und"), (None, "sol", "bb")]
    learned = [(text, lang) for i, text, lang in rows if text is not None and lang not in (None, "und") and (i is None or zlib.crc32(str(i).encode()) % 3 != 1)]
    words = lambda text: re.findall(r"[^\W\d_]+", text.lower())
    pieces = lambda word, k: [f"_{word}_"[i : i + k] for i in range(len(word) + 3 - k)] if k else [word]
    counts = collections.Counter((k, p, lang) for text, lang in learned for w in words(text) for k in range(6) for p in pieces(w, k))
    known = {(k, p) for k, p, _ in counts}
    size = collections.Counter(k for k, _ in known)
    total = collections.Counter()
    for (k, _, lang), n in counts.items():
        total[k, lang] += n

    def log_share(word, lang):
        for k in (0, 5, 4, 3, 2, 1):
            some = [p for p in pieces(word, k) if (k, p) in known]
            if some:
                return sum(math.log((counts[k, p, lang] + 0.5) / (total[k, lang] + 0.5 * size[k])) for p in some) / len(some)
        return 0.0

    found = language.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    for i, text, _ in rows:
        if not words(text or ""):
            assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
            continue
        sums = {lang: sum(log_share(w, lang) for w in words(text)) for lang in sorted(stems)}
        best = max(sums, key=sums.get)
        share = 1 / sum(math.exp(x - sums[best]) for x in sums.values())
        assert abs(by_id[i].score - share) < 1e-9 and (by_id[i].lang_pred == best or share < 0.5 + 1e-9)


def _letters(i):
    return "".join(chr(97 + i // 26**k % 26) for k in range(4))


def test_a_word_keeps_its_count_in_every_language(spark):
    """``shared`` is rarer than 20,500 other words of bb, but there it is three times as frequent as in aa."""
    many = [_letters(i) for i in range(20_500)] * 4 + ["shared"] * 3
    few = [_letters(i) for i in range(30_000, 30_020)] * 4_100 + ["shared"] + [_letters(30_000)] * 2
    ids = [i for i in range(9) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = spark.createDataFrame(
        [(ids[0], " ".join(few), "aa"), (ids[1], " ".join(many), "bb")], "doc_id long, text string, lang string"
    )
    model = language.fit(docs)
    assert len(model.tables[0]) > 20_500 and np.argmax(model.word_scores("shared")) == 1
    found = language.identified(docs.select(F.lit(1).alias("doc_id"), F.lit("shared").alias("text")), model=model).collect()
    assert {r.lang_pred for r in found} == {"bb"}


def test_too_many_words_go_by_their_total_in_all_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_ENTRIES", 2)
    ids = [i for i in range(9) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(ids[0], "ka ka ka mo mo to", "aa"), (ids[1], "mo zu zu", "bb")]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model.tables[0]) == {"ka", "mo"}  # three each; zu and to are fewer
    assert np.allclose(np.exp(model.word_scores("mo")), [2.5 / (6 + 1), 1.5 / (3 + 1)])


def test_a_long_run_of_letters_is_read_whole(spark):
    model = language.fit(_languages(spark))
    mixed = "kato" * 10 + "zuem" * 700 + "kita" * 10
    text = spark.createDataFrame([(1, mixed), (1, "kato kita " + mixed.upper())], "doc_id long, text string")
    assert [r.lang_pred for r in language.identified(text, model=model).collect()] == ["bb", "bb"]


def test_a_long_run_of_letters_is_learned_whole(spark):
    ids = [i for i in range(9) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(ids[0], "ab" * 20 + "kato" * 500 + "ab" * 20, "aa"), (ids[1], "ab" * 20 + "zuem" * 500 + "ab" * 20, "bb")]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert not model.tables.get(0) and "katok" in model.tables[5]
    assert [int(np.argmax(model.word_scores(w))) for w in ("katoka", "zuemzu")] == [0, 1]


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "en"), (5, "def", "und")], "doc_id long, text string, lang string")
    found = language.identified(docs).collect()
    assert {(r.lang_pred, r.score) for r in found} == {("und", 0.0)} and len(found) == 3
    assert language.identified(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def model():
    rng = random.Random(3)
    words = "the of and house to green this that is walking free software you may use copy license rights".split()
    return licences.trained_on([" ".join(rng.choice(words) for _ in range(rng.randrange(6, 60))) for _ in range(300)])


def test_every_template_is_recognised(model):
    pairs = {i for g, i in model.features.items() if " " in g}
    for family, texts in licences.TEMPLATES.items():
        for text in texts:
            found = licences.findings(model, pairs, f"Some words before.\n{text.upper()}\nand more text after it")
            assert [(f["paragraph"], f["family"]) for f in found] == [(1, family)], text


def test_licences_unknown_and_none(model, documents):
    long = "word " * 5000
    rows = [
        (1, "Licensed under the Frobozz License."), (2, "the green house is free to walk"), (3, None), (4, ""),
        (5, f"{long} Released under the MIT License. {long}"), (5, "Released under the MIT License."), (None, "SPDX-License-Identifier: MPL-2.0"),
        (6, "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY 4.0.\nLicensed under CC BY-NC 4.0."),
    ]
    found = {(r.doc_id, tuple(r.families), r.n_unknown) for r in licences.scanned(documents(rows), model).collect()}
    assert found == {
        (1, (), 1), (2, (), 0), (3, (), 0), (4, (), 0), (5, ("MIT",), 0), (None, ("MPL",), 0),
        (6, ("Apache-2.0", "CC-BY", "CC-BY-NC"), 0),
    }
    assert licences.scanned(documents([]), model).count() == 0


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "-- ", "<!-- "])
def test_wrapped_headers_are_found_whole(model, mark):
    """The notices of every family, wrapped at 70 columns as comments, among other text: no piece of them is unknown."""
    pairs = {i for g, i in model.features.items() if " " in g}
    for family, texts in licences.TEMPLATES.items():
        lines = [line for text in texts for line in [*textwrap.wrap(text, 70), ""]]
        body = "\n".join(["some house", *(f"{mark}{line}".rstrip() for line in lines), "walking to the green house"])
        assert {f["family"] for f in licences.findings(model, pairs, body)} == {family}
        # One after the other in one paragraph.
        body = "\n".join(f"{mark}{line}" for line in textwrap.wrap(" ".join(t for t in texts if len(t) > 70), 70))
        assert {f["family"] for f in licences.findings(model, pairs, body)} <= {family}


def test_paragraphs_of_wrapped_lines():
    text = f"/* {'one ' * 12}\n * two three\n *\n * four\n */\nshort\nline\n\n{'five ' * 10}end.\n{'six ' * 12}\n   \nseven\n{'eight ' * 200}\nnine"
    found = [(number, sorted(set(p.split()))) for number, p in licences.unwrapped(text)]
    assert found == [
        (0, ["one", "three", "two"]), (3, ["four"]), (5, ["short"]), (6, ["line"]), (8, ["end.", "five"]), (9, ["six"]),
        (11, ["seven"]), (12, ["eight"]), (13, ["nine"]),
    ]
    assert list(licences.unwrapped("")) == [] and list(licences.unwrapped("\n # \n//\n")) == []


def test_a_model_from_a_corpus(documents):
    fitted = licences.fit(documents([(i, f"a paragraph of text number {i} with words") for i in range(30)] + [(40, None)]))
    assert licences.NONE in fitted.classes and 0 < fitted.threshold <= 1
