"""End-to-end flows: plan → select → analyse → evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame

from postlens.config import recovery_point, written
from postlens.operators import cluster, evidence, select, sentiment, summarise


def analyse(posts: DataFrame, lexicon: DataFrame, kmin: int = 6, kmax: int = 12, rules: bool = True,
            stop_words=None, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Analysed posts, cluster summaries and report lines of one plan's posts (unique ids).

    Scored and analysed posts are stored once each: features and summaries read them several times.
    """
    scored = written(sentiment.scored(posts, lexicon, rules), "scored")
    found, k = cluster.clustered(scored, kmin, kmax, stop_words, **options)
    analysed = written(found, "analysed")
    summaries = summarise.cluster_summaries(analysed, stop_words=stop_words)
    report = summarise.report_lines(summaries, analysed, k, reason="No english/long enough posts")
    return analysed, summaries, report


def research(raw: DataFrame, plan: DataFrame, synonyms: DataFrame, lexicon: DataFrame, as_of: int, **options):
    """Everything for a plan table of one plan: analysed posts, summaries, report lines, evidence row.

    The selected posts are stored once: clusters, summaries and evidence read them several times.
    """
    posts = recovery_point(select.select_posts(raw, plan, synonyms, as_of).drop("plan_id"))
    analysed, summaries, report = analyse(posts, lexicon, **options)
    return analysed, summaries, report, evidence.evidence(analysed, plan, synonyms)
