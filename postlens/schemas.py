"""Explicit schemas; nothing in the library infers one."""

from __future__ import annotations

from pyspark.sql import types as T

TEXTS = T.ArrayType(T.StringType())


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_text, _int, _long, _double = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

RAW_POST = _struct(
    id=_text, subreddit=_text, created_utc=_double, title=_text, selftext=_text,
    full_link=_text, score=_long, num_comments=_long,
)

POST = _struct(
    id=_text, community=_text, created_utc=_long, title=_text, selftext=_text, url=_text,
    upvotes=_int, num_comments=_int, source=_text, fetched_at=T.TimestampType(),
)

ANALYSED_POST = T.StructType(
    POST.fields
    + _struct(text=_text, sentiment=_double, pain_score=_double, cluster=_int).fields
)

PARAMS = _struct(months=_int, min_upvotes=_int, limit=_int)

FILTERS = _struct(
    keywords=TEXTS, must_include=TEXTS, should_include=TEXTS, exclude=TEXTS, languages=TEXTS,
)

THEME = _struct(name=_text, audience=_text, pain_points=TEXTS, desired_outcomes=TEXTS)

SEED_ENTRY = _struct(name=_text, confidence=_double, why=_text, flags=TEXTS)

KEYWORD_ENTRY = _struct(phrase=_text, keyword=_text)

KEYWORD_PLAN = _struct(
    core=T.ArrayType(KEYWORD_ENTRY),
    long_tail=T.ArrayType(KEYWORD_ENTRY),
    exploratory=T.ArrayType(KEYWORD_ENTRY),
)

PLAN = _struct(
    plan_id=_long, prompt=_text, communities=TEXTS, params=PARAMS, filters=FILTERS,
    report_type=_text, rationale=_text, keywords=TEXTS, keyword_plan=KEYWORD_PLAN,
    warnings=TEXTS, validation_hints=TEXTS, topic_themes=T.ArrayType(THEME),
    seed=T.ArrayType(SEED_ENTRY),
)

SEED = _struct(
    plan_id=_long, prompt=_text, subreddits=T.ArrayType(SEED_ENTRY), topic_themes=T.ArrayType(THEME),
    keywords=TEXTS, filters=FILTERS, warnings=TEXTS, validation_hints=TEXTS, confidence=_text,
    timeframe_months=_int, min_upvotes=_int,
)

COMMUNITY = _struct(community=_text, over18=T.BooleanType(), subscribers=_long)
LEXICON = _struct(token=_text, valence=_double)
SYNONYM = _struct(key=_text, pos=_int, variant=_text)

#: Columns the analysis step adds when a post source lacks them, with their defaults.
REQUIRED_DEFAULTS = {"title": "", "selftext": "", "upvotes": 0, "num_comments": 0}
