"""Cluster summaries and the cluster report."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.config import written
from postlens.functions.text import complaints, two_places
from postlens.operators.features import run_lengths, unigrams
from postlens.operators.topn import top_n
from postlens.operators.wordcount import gathered, numbered, tally, word_counts
from postlens.sources.locate import LOCATOR, Late, located

POSTS_READ_FOR_GAPS = 500
GAPS = 10
TOP_TERMS = 10
TOP_POSTS = 5


def sizes(posts: DataFrame, by: str = "cluster") -> DataFrame:
    return posts.groupBy(by).agg(F.count("*").alias("size"), F.avg("pain_score").alias("avg_pain"))


def top_posts(posts: DataFrame, by: str = "cluster", n: int = TOP_POSTS) -> DataFrame:
    """The most painful posts of each group, ranked."""
    columns = [by, "id", "title", "url", "upvotes", "num_comments", "pain_score"]
    narrow = posts.select(*[c for c in columns if c in posts.columns])
    return top_n(narrow, [by], [F.desc("pain_score"), F.asc("id")], n, salt_on="id")


def gap_examples(posts: DataFrame, by: str = "cluster", read: int = POSTS_READ_FOR_GAPS, n: int = GAPS) -> DataFrame:
    """``(group, pos, gap)``: the first distinct complaint phrases among the newest posts of each group.

    Stored posts are ranked without their text; the texts of the ranked rows are fetched by where they are. A post needs no
    id, and one that repeats another's id speaks for itself.
    """
    late = Late(posts, ["text"])
    order = [F.desc("created_utc"), F.asc("id"), *late.order]
    newest = top_n(late.rows.select(by, "id", "created_utc", *late.carried), [by], order, read, "id")
    texts = late.fetch(newest.select(by, "rank", *late.carried))
    phrases = texts.select(by, "rank", F.posexplode(complaints(F.col("text"))).alias("pos", "gap"))
    first = phrases.groupBy(by, "gap").agg(F.min(F.struct("rank", "pos")).alias("at"))
    return top_n(first, [by], [F.asc("at.rank"), F.asc("at.pos")], n).select(by, F.col("rank").alias("pos"), "gap")


#: The weights of all groups are broadcast up to so many (group, term) pairs and entries of groups × terms.
MAX_PAIRS, MAX_ENTRIES = 200_000, 4_000_000


def top_terms(posts: DataFrame, by: str = "cluster", stop_words: Sequence[str] | None = None, vocabulary: int = 2000,
              n: int = TOP_TERMS, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """``(group, rank, term, weight)``: highest mean TF-IDF, weighted inside each group, all groups at once.

    Words are counted as numbers inside the task, and what is shuffled is partial sums by group and term, never a post: each
    row is a document of its own, whatever its id. Where the weights of all groups are few (checked), a post's vector is
    weighted and scaled inside the task as well. Otherwise the words are stored, meet their weights in a join and are summed
    by where the row is stored.

    Weights are rounded before ranking, so ties break by name.
    """
    words = posts.select(by, unigrams(F.col("text"), stop_words).alias("terms"))
    kept = top_n(word_counts(words, "terms", by), [by], [F.desc("total"), F.asc("term")], vocabulary, salt_on="term", rank="_rank")
    group_sizes = words.groupBy(by).agg(F.count("*").alias("size"))
    weigh = F.log((F.col("size") + 1.0) / (F.col("docs") + 1.0)) + 1.0
    idf = kept.join(group_sizes, kept[by].eqNullSafe(group_sizes[by])).select(kept[by], "term", weigh.alias("idf"))
    few = _few_weights(idf, by, max_pairs)
    shares = _shares_in_tasks(words, by, *few) if few else _shares_by_row(words, idf, by)
    means = shares.join(group_sizes, shares[by].eqNullSafe(group_sizes[by])).select(
        shares[by], "term", F.round(F.col("share") / F.col("size"), 9).alias("weight")
    )
    return top_n(means, [by], [F.desc("weight"), F.asc("term")], n).select(by, "rank", "term", "weight")


def _few_weights(idf: DataFrame, by: str, max_pairs: int):
    """The terms, each group's weights by the term's position, and the number of each group.

    None where groups and terms are too many for that, or none.
    """
    table = idf.limit(max_pairs + 1).toArrow()
    if not 0 < table.num_rows <= max_pairs:
        return None
    names, terms = (table.column(i).combine_chunks().dictionary_encode(null_encoding="encode") for i in (0, 1))
    size, groups = len(terms.dictionary), len(names.dictionary)
    if size * groups > MAX_ENTRIES:
        return None
    weights = np.zeros((groups, size))
    weights[names.indices.to_numpy(), terms.indices.to_numpy()] = table.column(2).to_numpy()
    known = idf.sparkSession.createDataFrame(pa.table({"_group": names.dictionary, "_number": pa.array(range(groups), pa.int32())}))
    return terms.dictionary, weights, known


def _shares_in_tasks(words: DataFrame, by: str, terms: pa.Array, weights: np.ndarray, groups: DataFrame) -> DataFrame:
    """Summed shares by group and term: a post's words become positions, its group's weights are looked up by them.

    A task adds up all its posts, so it sends at most an entry for each weight.
    """
    known = words.sparkSession.sparkContext.broadcast((terms, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights = known.value
        sums = np.zeros(weights.size)
        for table in gathered(batches, "terms"):
            codes, names, rows = numbered(table, "terms")
            position = pc.fill_null(pc.index_in(names, value_set=terms), -1).to_numpy().astype(np.int64)[codes]
            met = position >= 0
            at, row, tf, _ = tally(position[met], rows[met], table.num_rows)
            group = table.column("_number").to_numpy().astype(np.int64)[row]
            weight = tf * weights[group, at]
            length = np.sqrt(np.bincount(row, weights=weight * weight, minlength=table.num_rows))
            some = weight > 0
            entry, share = (group * len(terms) + at)[some], weight[some] / length[row[some]]
            sums += np.bincount(entry, weights=share, minlength=len(sums))
        used = np.flatnonzero(sums)
        group, at = np.divmod(used, len(terms))
        yield pa.RecordBatch.from_arrays(
            [pa.array(group.astype(np.int32)), terms.take(pa.array(at)), pa.array(sums[used])], ["_number", "term", "share"]
        )

    met = words.join(F.broadcast(groups), words[by].eqNullSafe(groups["_group"])).select("_number", "terms")
    sums = met.mapInArrow(run, "_number int, term string, share double").groupBy("_number", "term").agg(F.sum("share").alias("share"))
    return sums.join(F.broadcast(groups), "_number").select(F.col("_group").alias(by), "term", "share")


def _shares_by_row(words: DataFrame, idf: DataFrame, by: str) -> DataFrame:
    """The same sums where weights are many."""
    rows = located(written(words, "words"))
    counts = rows.select(by, *LOCATOR, F.explode(run_lengths(F.sort_array("terms"))).alias("t")).select(
        by, *LOCATOR, "t.term", "t.tf"
    )
    same = counts[by].eqNullSafe(idf[by]) & (counts["term"] == idf["term"])
    weights = counts.join(idf, same).select(counts[by], *LOCATOR, counts["term"], (F.col("tf") * F.col("idf")).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*LOCATOR)))
    return weights.withColumn("share", F.col("w") / length).groupBy(by, "term").agg(F.sum("share").alias("share"))


def _ordered(rows: DataFrame, by: str, pos: str, value: Column, name: str) -> DataFrame:
    """A ranked list per group as an array. Its length is bounded by the rank limit before it."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("pos"), value.alias("value"))))
    return rows.groupBy(by).agg(F.transform(listed, lambda x: x["value"]).alias(name))


def cluster_summaries(posts: DataFrame, by: str = "cluster", stop_words: Sequence[str] | None = None) -> DataFrame:
    """One row per group: size, average pain, top terms, top posts, complaint phrases."""
    terms = _ordered(top_terms(posts, by, stop_words), by, "rank", F.col("term"), "top_terms")
    sample = F.struct("title", "url", "upvotes", "num_comments", "pain_score")
    samples = _ordered(top_posts(posts, by), by, "rank", sample, "sample_posts")
    gaps = _ordered(gap_examples(posts, by), by, "pos", F.col("gap"), "gap_examples")
    out = sizes(posts, by)
    for part in (terms, samples, gaps):
        out = out.join(part, by, "left")
    return out


def report_lines(summaries: DataFrame, posts: DataFrame, k: int, title: str = "Pain Map", by: str = "cluster",
                 reason: str | None = None) -> DataFrame:
    """The Markdown report as ``(line_no, line)``. Without posts it holds the reason instead."""
    total = posts.agg(F.count("*").alias("n"))
    clusters = F.when(F.col("n") > 0, F.lit(k)).otherwise(0)
    note = F.when(F.col("n") > 0, F.lit("")).otherwise(F.concat(F.lit("\n> "), F.lit(reason or "No data")))
    head = total.select(
        F.lit(-1).alias("section"),
        F.array(
            F.lit(f"# {title}"),
            F.format_string("- Items: **%d**", F.col("n")),
            F.format_string("- Clusters: **%d**", clusters),
            note,
        ).alias("lines"),
    )
    empty = F.array().cast("array<string>")

    def block(items: str, heading: str, lines: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.array(F.lit(heading)), lines)).otherwise(empty)

    post_line = F.transform(
        "sample_posts",
        lambda p: F.format_string(
            "- [%s](%s)  (↑%d, 💬%d, pain %s)", p["title"], F.coalesce(p["url"], F.lit("")), p["upvotes"],
            p["num_comments"], p["pain_score"].cast("string"),
        ),
    )
    body = summaries.select(
        F.col(by).cast("int").alias("section"),
        F.concat(
            F.array(F.format_string("## Cluster %d — size %d — avg pain %s", F.col(by), F.col("size"), two_places(F.col("avg_pain")))),
            F.when(
                F.size("top_terms") > 0,
                F.array(F.concat(F.lit("**Top terms:** "), F.array_join("top_terms", ", "))),
            ).otherwise(empty),
            block("gap_examples", "**Gap hints:**", F.transform("gap_examples", lambda g: F.concat(F.lit("- "), g))),
            block("sample_posts", "**Painful posts:**", post_line),
            F.array(F.lit("")),
        ).alias("lines"),
    )
    lines = head.unionByName(body).select("section", F.posexplode("lines").alias("pos", "line"))
    return lines.select((F.col("section") * 1000 + F.col("pos") + 1000).alias("line_no"), "line")
