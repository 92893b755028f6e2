"""Language ID, words first.

A word known from training adds its log frequency in each language. A word not known backs off to its character
n-grams, from the longest order down to the first one of which any n-gram is known. A run of letters too long for a word
is scored all along, by the longest known n-gram at each letter. Sums over all words of a text are the log likelihoods of
the languages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.llm.common import checkpointed, held_out, pieces_of

#: About this many documents of each language are learned from.
SAMPLE_PER_LANGUAGE = 2_000
#: All words and all n-grams of each order are kept up to this many; of more, those seen often enough in all languages
#: together that they fit.
MAX_ENTRIES = 500_000
ORDERS = (5, 4, 3, 2, 1)
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 200_000
#: A longer run of letters is a sentence or a text without spaces: no word of the model, but its n-grams are, all of them.
_LONG = 64


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    return _WORD.findall(text.lower())


def grams(word: str, order: int) -> Iterator[str]:
    padded = f"_{word}_"
    return (padded[i : i + order] for i in range(len(padded) - order + 1))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (order 0) and n-grams per language, of the rows of one task (a bounded sample)."""
    found: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found.setdefault(lang, Counter()).update(words_of(text))
    for lang, words in found.items():
        by_order: dict[int, Counter] = {0: Counter({w: n for w, n in words.items() if len(w) <= _LONG})}
        for word, n in words.items():
            for order in ORDERS:
                counter = by_order.setdefault(order, Counter())
                for gram in grams(word, order):
                    counter[gram] += n
        for order, counter in by_order.items():
            items = list(counter.items())
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([lang] * len(items), pa.string()), "ord": pa.array([order] * len(items), pa.int32()),
                    "gram": pa.array([k for k, _ in items], pa.string()), "n": pa.array([n for _, n in items], pa.int64()),
                }
            )


@dataclass
class Model:
    """Languages in order of their names; for words (order 0) and each n-gram order, log frequencies per language."""

    languages: list[str]
    tables: dict[int, dict[str, int]]  # entry → row of the scores
    scores: dict[int, np.ndarray]  # entries × languages

    def word_scores(self, word: str) -> np.ndarray:
        known = self.tables.get(0, {}).get(word)
        if known is not None:
            return self.scores[0][known]
        if len(word) > _LONG:
            return self._run_scores(f"_{word}_")
        for order in ORDERS:
            table = self.tables.get(order, {})
            hits = [i for g in grams(word, order) if (i := table.get(g)) is not None]
            if hits:
                return self.scores[order][hits].sum(axis=0) / len(hits)
        return np.zeros(len(self.languages))

    def _run_scores(self, run: str) -> np.ndarray:
        """The sum over the whole run, by the longest order, as about so many n-grams have each letter."""
        hits: dict[int, Counter] = {order: Counter() for order in ORDERS if order in self.tables}
        for i in range(len(run)):
            for order, found in hits.items():
                if i + order <= len(run) and (k := self.tables[order].get(run[i : i + order])) is not None:
                    found[k] += 1
                    break
        total = np.zeros(len(self.languages))
        for order, found in hits.items():
            if found:
                total += np.array(list(found.values())) @ self.scores[order][list(found)]
        return total / ORDERS[0]


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """A model of the languages of the documents that are not held out.

    About ``SAMPLE_PER_LANGUAGE`` documents per language are counted, chosen by a hash of the id among all of them. Their
    words and n-grams are kept, each with its counts in all languages. Rows with null text or language are ignored, and so
    is a row with the language ``und``.
    """
    known = docs.where(~held_out(id_col)).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id")
    ).where(F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], {}, {})
    place = F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1_000_000))
    share = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, int(1_000_000 * min(1.0, SAMPLE_PER_LANGUAGE / n))).otherwise(share)
    sample = known.where(place < share).select("lang", "text")
    counts = sample.mapInArrow(_counted, "lang string, ord int, gram string, n long")
    counts = counts.groupBy("ord", "gram", "lang").agg(F.sum("n").alias("n"))
    counts = checkpointed(counts.groupBy("ord", "gram").agg(
        F.sum("n").alias("total"), F.collect_list("lang").alias("langs"), F.collect_list("n").alias("ns")
    ))
    totals = counts.select("ord", F.explode(F.arrays_zip("langs", "ns")).alias("x"))
    totals = totals.groupBy("ord", F.col("x.langs").alias("lang")).agg(F.sum("x.ns").alias("total")).collect()
    least = F.lit(1)
    for order, n in _least_counts(counts.groupBy("ord", "total").agg(F.count("*").alias("n")).collect()).items():
        least = F.when(F.col("ord") == order, n).otherwise(least)
    kept = counts.where(F.col("total") >= least).select("ord", "gram", "langs", "ns")
    return _model(sorted(sizes), kept.toArrow(), totals)


def _least_counts(rows) -> dict[int, int]:
    """For each order the least total over all languages of which ``MAX_ENTRIES`` entries at most have as much."""
    found: dict[int, int] = {}
    room: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: -r["total"]):
        room[r["ord"]] = room.get(r["ord"], MAX_ENTRIES) - r["n"]
        if room[r["ord"]] < 0:
            found.setdefault(r["ord"], r["total"] + 1)
    return found


def _model(languages: list[str], kept: pa.Table, totals) -> Model:
    """Add-half smoothing: an entry that a language lacks counts as half an occurrence."""
    total = {(r["lang"], r["ord"]): r["total"] for r in totals}
    tables: dict[int, dict[str, int]] = {}
    at: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for batch in kept.to_batches(max_chunksize=10_000):
        orders, grams, langs, ns = batch.columns
        entries = []
        for order, gram in zip(orders.to_pylist(), grams.to_pylist()):
            table = tables.setdefault(order, {})
            entries.append(table.setdefault(gram, len(table)))
        lengths = pc.list_value_length(langs).to_numpy()
        order_of, rows = np.repeat(orders.to_numpy(), lengths), np.repeat(np.array(entries, np.int64), lengths)
        columns = pc.index_in(langs.flatten(), value_set=pa.array(languages, langs.type.value_type)).to_numpy()
        counts = ns.flatten().to_numpy()
        for order in np.unique(order_of).tolist():
            own = order_of == order
            at.setdefault(order, []).append((rows[own], columns[own], counts[own]))
    scores = {}
    for order, table in tables.items():
        floor = np.array([total.get((lang, order), 0) + 0.5 * len(table) for lang in languages])
        n = np.zeros((len(table), len(languages)))
        rows, columns, counts = (np.concatenate(x) for x in zip(*at.pop(order)))
        n[rows, columns] = counts
        scores[order] = np.log((n + 0.5) / floor)
    return Model(languages, tables, scores)


def predictor(spark, model: Model):
    """An expression builder: text → struct of ``lang`` and ``score``."""
    shared = spark.sparkContext.broadcast(model)
    state: dict = {}

    @F.arrow_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(text: pa.Array) -> pa.Array:
        model = shared.value
        place, new = model.tables.get(0, {}), state.setdefault("new", {})
        scores = model.scores.get(0, np.zeros((0, len(model.languages))))
        langs: list[str] = []
        sure: list[float] = []
        for t in (t for x in pieces_of(text) for t in text.slice(x.start, x.stop - x.start).to_pylist()):
            words = words_of(t) if t else []
            # Some numerals count as word characters, but are no letters.
            if not model.languages or not any(c.isalpha() for w in words for c in w):
                langs.append(UNKNOWN), sure.append(0.0)
                continue
            at = [place.get(w, -1) for w in words]
            total = scores[[i for i in at if i >= 0]].sum(axis=0)
            for w, i in zip(words, at):
                if i < 0:
                    if len(w) > _LONG:
                        total = total + model.word_scores(w)
                        continue
                    if w not in new:
                        if len(new) >= _CACHE:
                            new.clear()
                        new[w] = model.word_scores(w)
                    total = total + new[w]
            share = np.exp(total - total.max())
            best = int(np.argmax(share))
            langs.append(model.languages[best]), sure.append(float(share[best] / share.sum()))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(sure, pa.float64())], ["lang", "score"])

    return predict


def identified(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None
) -> DataFrame:
    """Per row of ``docs``: id, ``held_out``, ``lang_pred`` and ``score`` (the share of the likelihood, 0 to 1).

    A null text, a text without a letter, and every text if no language was learned get ``und`` and 0. A text whose
    letters are all unknown gets the first language in order of names. Ties go to the first name too. Rows with equal
    ids are scored apart; a null id counts as not held out. Other columns are not read.
    """
    model = model or fit(docs, text_col, lang_col, id_col)
    predict = predictor(docs.sparkSession, model)
    out = docs.select(F.col(id_col), predict(F.col(text_col).cast("string")).alias("p"))
    return out.select(
        F.col(id_col), held_out(id_col).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score")
    )


def keep_known(docs: DataFrame, min_score: float = 0.3, **columns: str) -> DataFrame:
    """The rows of ``docs`` whose language is known with at least ``min_score``; all columns stay as they are."""
    model = fit(docs, **columns)
    predict: Column = predictor(docs.sparkSession, model)(F.col(columns.get("text_col", "text")).cast("string"))
    return docs.where((predict["lang"] != UNKNOWN) & (predict["score"] >= min_score))
