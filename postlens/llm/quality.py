"""Quality classifier by Bradley-Terry ranking.

Pairs of a better and a worse document are the training data. The chance that a document wins against another is the
logistic function of the difference of their scores; scores are linear in features of the text, so the weights come
from logistic loss on feature differences. A quantile of the scores is the threshold: the share of worse documents
among the labelled ones. The published score is the logistic function of the distance to it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.llm.common import by_bytes, checkpointed, held_out, pieces_of, texts
from postlens.llm.shingles import word_hashes

#: Bounds of the sample that weights are fitted on: labelled documents of each class, and pairs.
SAMPLE_PER_CLASS, PAIRS = 20_000, 200_000
_CHUNK = 1 << 19
#: Words added to every text's count, so that a single odd word does not decide about a short text.
_FEW = 30
#: Kinds of bytes whose share is a feature.
_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".,;:", "mark": b"!?", "bar": b"|",
    "symbol": b"#$%&*@^~+=<>\\/{}[]_`", "bracket": b"()\"'-", "line": b"\n", "tab": b"\t\r",
}
FEATURES = [*_KINDS, "words", "length", "repeat", "run", "variety", "short", "long"]


def _counts(data: np.ndarray, kind: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text (given by bounds) how many of its bytes are of each kind."""
    out = np.empty((len(bounds) - 1, len(_KINDS)))
    found = kind[data]
    for i in range(len(_KINDS)):
        sums = np.concatenate(([0], np.cumsum(found == i + 1)))
        out[:, i] = sums[bounds[1:]] - sums[bounds[:-1]]
    return out


def _kind_table() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    for i, members in enumerate(_KINDS.values()):
        kind[list(members)] = i + 1
    return kind


_KIND = _kind_table()


def text_features(texts_: list[bytes | None]) -> np.ndarray:
    """One row of ``FEATURES`` per text: shares per word, on a logarithmic scale. A text without words has zeros."""
    rows = []
    for part in by_bytes(texts_, _CHUNK):
        some = [t or b"" for t in texts_[part]]
        hashes, words = word_hashes(some)
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in some])))
        kinds = _counts(np.frombuffer(b"".join(some), np.uint8), _KIND, bounds)
        out = np.zeros((len(some), len(FEATURES)))
        at = 0
        for i, n in enumerate(words.tolist()):
            if n:
                own = hashes[at : at + n]
                breaks = np.flatnonzero(own[1:] != own[:-1]) + 1
                runs = np.diff(np.concatenate(([0], breaks, [n])))
                size = len(some[i]) / n
                out[i] = [
                    *np.log1p(100 * kinds[i] / (n + _FEW)), np.log1p(n), size, np.log1p(100 * (n - len(runs)) / (n + _FEW)),
                    np.log1p(100 * (runs.max() - 1) / (n + _FEW)), np.log1p(len(np.unique(own))) / np.log1p(n), size < 4, size > 12,
                ]
            at += n
        rows.append(out)
    return np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def features(text: pa.Array) -> pa.Array:
    pieces = [text_features(texts(text.slice(x.start, x.stop - x.start))) for x in pieces_of(text)]
    values = np.concatenate(pieces) if pieces else text_features([])
    offsets = np.arange(0, values.size + 1, len(FEATURES), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


@dataclass
class Ranking:
    """``weights`` on features as they are, and the ``threshold`` in units of the score."""

    weights: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    threshold: float = 0.0

    def raw(self, values: Column) -> Column:
        return sum((values[i] * F.lit(float(w)) for i, w in enumerate(self.weights)), F.lit(0.0))

    def score(self, values: Column) -> Column:
        return 1 / (1 + F.exp(F.lit(self.threshold) - self.raw(values)))


def bradley_terry(better: np.ndarray, worse: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3) -> np.ndarray:
    """Weights from random pairs (fixed seed) by Newton's method on the mean logistic loss of scaled differences."""
    if not len(better) or not len(worse):
        return np.zeros(better.shape[1])
    scale = np.concatenate([better, worse]).std(axis=0)
    scale[scale == 0] = 1
    draw = np.random.default_rng(7)
    x = (better[draw.integers(len(better), size=pairs)] - worse[draw.integers(len(worse), size=pairs)]) / scale
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(x @ w, -500, 500)))  # the chance of the pair being the other way round
        gradient = ridge * w - x.T @ p / pairs
        hessian = (x.T * (p * (1 - p))) @ x / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w / scale


def fit(table: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Ranking:
    """A ranking from ``table`` (id and ``features`` of documents) and labels of those that are not held out.

    Weights come from a sample: at most about ``SAMPLE_PER_CLASS`` labelled documents of each class, chosen by a hash of
    the id. The threshold is a quantile over all labelled documents that are not held out. Null labels, labels other
    than 0 and 1, and labels without a document are ignored; of repeated rows each counts. Without both classes the
    weights and the threshold are 0.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col), F.col(label_col).alias("label"))
    known = checkpointed(table.where(~held_out(id_col)).select(id_col, "features").join(known, id_col))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Ranking()
    place = F.pmod(F.xxhash64(id_col, F.lit("sample")), F.lit(1_000_000))
    share = {c: int(1_000_000 * min(1.0, SAMPLE_PER_CLASS / n)) for c, n in sizes.items()}
    sample = known.where(place < F.when(F.col("label") == 1, share[1]).otherwise(share[0])).select("label", "features")
    rows = sample.toArrow()
    values, label = rows["features"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)), rows["label"].to_numpy()
    # In an order of their own: tasks may end in any.
    order = np.lexsort(values.T[::-1])
    worse_rows, better_rows = (values[order[label[order] == c]] for c in (0, 1))
    model = Ranking(bradley_terry(better_rows, worse_rows).tolist())
    worse = sizes[0] / (sizes[0] + sizes[1])
    # Halfway between the scores on either side of the quantile, so that no document lies on the threshold.
    raw = known.select(model.raw(F.col("features")).alias("raw"))
    below = raw.agg(F.percentile_approx("raw", F.lit(worse), 100_000).alias("q")).first()["q"]
    above = raw.where(F.col("raw") > below).agg(F.min("raw").alias("q")).first()["q"]
    model.threshold = below if above is None else (below + above) / 2
    return model


def ranked(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """Per row of ``docs``: id, ``held_out``, ``score`` (0 to 1, higher is better) and ``predicted`` (1 from 0.5 on).

    Only the text is scored; a null, empty or blank text has the score of zero features. Rows with equal ids are scored
    apart; a null id counts as not held out. An empty table gives no rows. Other columns are not read.
    """
    table = docs.select(F.col(id_col), features(F.col(text_col).cast("string")).alias("features"))
    table = checkpointed(table)
    model = fit(table, labels, id_col, label_col)
    return table.select(
        F.col(id_col), held_out(id_col).alias("held_out"), model.score(F.col("features")).alias("score")
    ).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """The rows of ``docs`` with a score of at least 0.5, by a ranking fitted on their own labelled rows."""
    values = features(F.col(text_col).cast("string"))
    model = fit(checkpointed(docs.select(F.col(id_col), values.alias("features"))), labels, id_col, label_col)
    return docs.where(model.score(values) >= 0.5)
