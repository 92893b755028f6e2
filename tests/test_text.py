from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from postlens.functions import lists, match
from postlens.functions import text as t


@pytest.mark.parametrize(
    "raw, clean",
    [(None, ""), ("", ""), ("a\r\nb", "a b"), ("\ta  b ", "a b"), ("a\x1cb", "a b"), ("  x  y  ", "x y")],
)
def test_clean_text(value, raw, clean):
    assert value(t.clean_text(F.col("x")), x=F.lit(raw).cast("string")) == clean


@pytest.mark.parametrize(
    "text, english",
    [
        ("12345 !!", True), ("", True), ("aaaaaaaééé", False), ("aaaaaaaaééé", True), ("漢字漢字abc", False),
        ("plain words 😀", True), ("ééé", False),
    ],
)
def test_is_english(value, text, english):
    assert value(t.is_english(F.col("x")), x=text) is english


@pytest.mark.parametrize(
    "raw, number", [("12", 12), ("12.7", 12), ("-3.9", -3), ("abc", 0), ("nan", 0), (None, 0), ("inf", 0), ("1e3", 1000)]
)
def test_whole_number(value, raw, number):
    assert value(t.whole_number(F.col("x")), x=F.lit(raw).cast("string")) == number


def test_pain_score(value):
    score = t.pain_score(F.col("s"), F.col("u"), F.col("c"))
    assert value(score, s=0.5, u=10, c=10) == 0.0
    assert value(score, s=-0.5, u=0, c=0) == 0.5
    assert value(score, s=-0.5, u=-10, c=2) == 0.5
    assert value(score, s=-0.8, u=100, c=20) == round(0.8 * (1 + math.log1p(120)), 3)


@pytest.mark.parametrize(
    "text, found",
    [
        ("I tried the app but it crashed. Fine", ["i tried the app but it crashed"]),
        ("I USED X but Y; i wish there were tools", ["i used x but y", "i wish there were tools"]),
        ("it doesn't work because rain", ["it doesn't work because rain"]),
        ("i can't a. i can't b. i can't c. i can't d. i can't e. i can't f. i wish there was g",
         ["i wish there was g", "i can't a", "i can't b", "i can't c", "i can't d"]),
        ("nothing here", []),
    ],
)
def test_complaints(value, text, found):
    assert value(t.complaints(F.col("x")), x=text) == found


@pytest.mark.parametrize(
    "text, found",
    [
        ("Haptic GLOVE, market!", ["haptic", "glove", "market"]),
        ('find "face reading" apps', ["find", "face reading", "apps"]),
        ("'voice  control' x", ["voice control", "x"]),
        ("it's a test", ["it", "s", "a", "test"]),
        ('a"b c"d e', ["ab cd", "e"]),
        ("c++ c# node.js e-mail a_b a/b", ["c++", "c#", "node.js", "e-mail", "a_b", "a/b"]),
        ("güvenlik ŞİFRE straße", ["güvenlik", "şi̇fre", "stra", "e"]),
        ("", []), (None, []), ('""', []),
    ],
)
def test_tokens(value, text, found):
    assert value(t.tokens(F.col("x")), x=F.lit(text).cast("string")) == found


def test_lookup_keys(value):
    assert value(t.lookup_keys(F.col("x")), x="özelliklerin") == ["ozelliklerin", "ozellikler"]
    assert value(t.lookup_keys(F.col("x")), x="uygulamalar") == ["uygulamalar", "uygulama"]
    assert value(t.lookup_keys(F.col("x")), x="ab") == ["ab"]


def test_community_tags(value):
    assert value(t.community_tag(F.col("x")), x="x/r/Name") == "r/Name"
    assert value(t.seed_community_tag(F.col("x")), x=" R/Name ") == "R/Name"
    assert value(t.seed_community_tag(F.col("x")), x="a/Name") == "r/Name"


def test_permalink(value):
    link = t.permalink(F.col("l"), F.col("c"), F.col("i"))
    assert value(link, l="http://x", c="a", i="1") == "http://x"
    assert value(link, l="", c="r/a", i="1").endswith("/r/a/comments/1/")
    assert value(link, l=F.lit(None).cast("string"), c="", i="1").endswith(".com/comments/1/")


def test_two_places_follow_the_binary_value(value):
    for number in (0.125, 0.375, 2.675, 1.005, 20.625, 1234.5):
        assert value(t.two_places(F.col("x")), x=number) == f"{number:.2f}"


def test_dedupe_keeps_first_spelling(value):
    items = F.array(*[F.lit(v) for v in ("B", " a ", "b", "", "A", "c")])
    assert value(lists.dedupe(F.concat(items, F.array(F.lit(None).cast("string"))))) == ["B", "a", "c"]
    assert value(lists.dedupe(F.lit(None).cast("array<string>"))) == []
    assert value(lists.merge(items, F.array(F.lit("C"), F.lit("d")))) == ["B", "a", "c", "d"]


def test_json_list(value):
    assert value(lists.json_list(F.col("x")), x='["a", " ", 3, null]') == ["a", "3"]
    assert value(lists.json_list(F.col("x")), x="{broken") == []


def test_matching(value):
    text = "He SAID the Straße is broken"
    terms = lambda *t: F.array(*[F.lit(v) for v in t]).cast("array<string>")
    assert value(match.contains_any(F.col("x"), terms("ai")), x=text)
    assert value(match.contains_any(F.col("x"), terms("STRASSE", "zzz")), x=text)
    assert not value(match.contains_all(F.col("x"), terms("strasse", "zzz")), x=text)
    assert value(match.contains_all(F.col("x"), terms("said the", "broken")), x=text)
    assert value(match.contains_any_of(F.col("x"), ["nope", "Said The"]), x=text)
    assert not value(match.contains_any(F.col("x"), terms("a")), x=F.lit(None).cast("string"))
    assert value(match.include_filter(F.col("x"), []), x=text)
    assert not value(match.evidence_filter(F.col("x"), terms()), x=text)
    assert value(match.exclude_filter(F.col("x"), ["zzz"]), x=F.lit(None).cast("string"))
