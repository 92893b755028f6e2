"""Sentiment and pain of posts.

A lexicon of usual size is checked, then becomes part of the expression, so scoring is a projection: text is
neither exploded nor shuffled. A larger lexicon is joined to the words, and each post's words come together
again by id; the scoring rules are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.config import MAX_INLINE_ROWS, small_rows
from postlens.functions import sentiment as s
from postlens.functions.text import analysis_text, is_english, pain_score, whole_number, words
from postlens.sources.readers import with_defaults
from postlens import fixed_values as fixed


def with_sentiment(posts: DataFrame, lexicon: DataFrame, rules: bool = True, text: str = "text",
                   max_inline: int = MAX_INLINE_ROWS) -> DataFrame:
    """Add ``sentiment`` in [-1, 1]; ``rules=False`` is the plain sum of valences.

    Of a token that the lexicon lists several times, the largest valence counts; null tokens and valences do
    not. Posts may have null or repeated ids. A stream takes a lexicon of up to ``max_inline`` tokens.
    """
    lexicon = lexicon.where("token is not null and valence is not null").groupBy("token").agg(
        F.max(F.col("valence").cast("double")).alias("valence")
    )
    rows = small_rows(lexicon, max_inline)
    if rows is None:
        if posts.isStreaming:
            raise ValueError(f"a stream takes a lexicon of at most {max_inline} tokens")
        return _joined(posts, lexicon, rules, text)
    known = {r.token: r.valence for r in rows}
    score = s.rule_sentiment if rules else s.lexicon_sentiment
    return posts.withColumn("sentiment", score(F.col(text), known))


def _joined(posts: DataFrame, lexicon: DataFrame, rules: bool, text: str) -> DataFrame:
    # Posts of one id and text have one score: repeated rows are counted once and joined back.
    key = [F.col("id"), F.xxhash64(text).alias("_text")]
    spoken = posts.select(*key, F.posexplode(words(F.col(text))).alias("pos", "word"))
    valued = spoken.join(
        lexicon.select(F.col("token").alias("low"), "valence"), F.lower("word") == F.col("low"), "left"
    )
    sentences = valued.groupBy("id", "_text").agg(
        F.sort_array(F.collect_set(F.struct("pos", "word", "valence"))).alias("_spoken")
    ).withColumnRenamed("id", "_id")
    same = posts["id"].eqNullSafe(sentences["_id"]) & (F.xxhash64(posts[text]) == sentences["_text"])
    scored = posts.join(sentences, same, "left").withColumn(
        "_spoken", F.coalesce("_spoken", F.array().cast("array<struct<pos:int,word:string,valence:double>>"))
    )
    if rules:
        spoken = s.spoken_words(F.transform("_spoken", lambda w: w["word"]), F.transform("_spoken", lambda w: w["valence"]))
        value = s.rule_compound(F.col(text), spoken)
    else:
        total = F.aggregate("_spoken", F.lit(0.0), lambda acc, w: acc + F.coalesce(w["valence"], F.lit(0.0)))
        value = s.compound(total)
    value = F.when(F.col(text).isNotNull(), value)
    return scored.withColumn("sentiment", value).drop("_spoken", "_id", "_text")


def prepared(posts: DataFrame) -> DataFrame:
    """Analysis text of English posts that are long enough; votes and comments as whole numbers."""
    whole = with_defaults(posts).withColumns(
        {
            "text": analysis_text(F.col("title"), F.col("selftext")),
            "upvotes": whole_number(F.col("upvotes")),
            "num_comments": whole_number(F.col("num_comments")),
        }
    )
    return whole.where(F.length("text") > fixed.MIN_TEXT_LENGTH).where(is_english(F.col("text")))


def with_pain(posts: DataFrame) -> DataFrame:
    return posts.withColumn("pain_score", pain_score(F.col("sentiment"), F.col("upvotes"), F.col("num_comments")))


def scored(posts: DataFrame, lexicon: DataFrame, rules: bool = True) -> DataFrame:
    """Prepared posts with ``sentiment`` and ``pain_score``."""
    return with_pain(with_sentiment(prepared(posts), lexicon, rules))
