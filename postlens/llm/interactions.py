"""Audit of how five document filters interact, in every order they can be applied.

Whether a text repeats is the only question that needs other rows. A counting Bloom sketch answers it for most texts
without a shuffle: each task counts hashes of its texts, the counts are merged, and a text one of whose counters stays
below two is unique for certain. Only the other texts are grouped, by their whole content and after a partial
aggregation, for the smallest id of each. Five flags then make a mask, and counts of masks are additive: all orders
and steps follow from at most 128 counts per part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import texts, written
from postlens.llm.shingles import mix

FILTERS = "ABCDE"
#: Counters for each text, and the bounds of their number. The bitmap that is broadcast has a bit per counter.
PER_TEXT, LEAST_COUNTERS, MOST_COUNTERS = 16, 1 << 16, 1 << 28
_SEGMENTS = 64
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUATION = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#$%&*|"
_COUNTS = "filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_mask(text: bytes) -> int:
    """Which of A to D the text fails, as bits 1, 2, 4 and 8."""
    words = text.split()  # of bytes: at ASCII white space only
    size = len(text)
    points = len(text.translate(None, _CONTINUATION))
    capitals = size - len(text.translate(None, _CAPITALS))
    return (
        (len(words) < 200)
        + 2 * (100 * len(set(words)) < 50 * len(words))
        + 4 * (100 * capitals > 3 * points)
        + 8 * (len(text.translate(None, _SYMBOLS)) < size)
    )


def _places(hashes: np.ndarray, counters: int) -> np.ndarray:
    """The two counters of each text hash, one row per hash."""
    h = hashes.view(np.uint64)
    return np.stack([h, mix(h)], axis=1) & np.uint64(counters - 1)


def _hashes(batch: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in batch), np.uint64, len(batch)).view(np.int64)


def _flagged(counters: int):
    """Per document its id, part, mask of A to D and text hash; per task its counters, at most 2 of each.

    Counters go out in segments as positions: once for a count of one, twice for more.
    """
    width = counters // _SEGMENTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = []
        for batch in batches:
            some = [t or b"" for t in texts(batch.column("text"))]
            hashes, n = _hashes(some), len(some)
            used.append(_places(hashes, counters).ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("part"), pa.array([text_mask(t) for t in some], pa.int32()),
                 pa.array(hashes), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                ["id", "part", "mask", "h", "segment", "places"],
            )
        if used and sum(map(len, used)):
            place, count = np.unique(np.concatenate(used), return_counts=True)
            place = np.repeat(place, np.minimum(count, 2))
            cuts = np.searchsorted(place, np.arange(1, _SEGMENTS, dtype=np.uint64) * np.uint64(width))
            parts = [(i, x) for i, x in enumerate(np.split(place, cuts)) if len(x)]
            none = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(none, pa.int64()), pa.nulls(none, pa.string()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.int64()),
                 pa.array([i for i, _ in parts], pa.int32()),
                 pa.array([(x - np.uint64(i * width)).astype(np.uint32).tobytes() for i, x in parts], pa.binary())],
                ["id", "part", "mask", "h", "segment", "places"],
            )

    return run


def _merged(counters: int):
    """Of rows sorted by segment: a bit per counter that is set from a count of two on."""
    width = counters // _SEGMENTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts = None, np.zeros(0, np.uint8)

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"segment": pa.array([at], pa.int32()), "bits": pa.array([np.packbits(counts > 1).tobytes()], pa.binary())}
            )

        for batch in batches:
            for segment, places in zip(batch.column("segment").to_pylist(), batch.column("places").to_pylist()):
                if segment != at:
                    if at is not None:
                        yield closed()
                    at, counts = segment, np.zeros(width, np.uint8)
                place, more = np.unique(np.frombuffer(places, np.uint32), return_counts=True)
                counts[place] = np.minimum(2, counts[place] + more)
        if at is not None:
            yield closed()

    return run


def _possible(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether both counters of a text reach two."""
    places = _places(hashes, 8 * len(bits))
    set_ = (bits[places >> np.uint64(3)] >> (np.uint64(7) - (places & np.uint64(7))).astype(np.uint8)) & 1
    return set_.all(axis=1)


def _possible_texts(bits):
    """Hash, text and id of the documents whose text may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = _hashes([t or b"" for t in texts(batch.column("text"))])
            keep = pa.array(_possible(hashes, bits.value))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes).filter(keep), batch.column("text").filter(keep), batch.column("id").filter(keep)],
                ["h", "text", "id"],
            )

    return run


def _possible_rows(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maybe = pa.array(_possible(batch.column("h").to_numpy(), bits.value))
            yield pa.RecordBatch.from_arrays([*batch.columns, maybe], [*batch.schema.names, "maybe"])

    return run


def _counters(n: int, least: int, most: int) -> int:
    return max(least, min(most, 1 << max(0, PER_TEXT * n - 1).bit_length()))


def masks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", most_counters: int = MOST_COUNTERS,
) -> DataFrame:
    """``id, part, mask, n``: rows of ``docs`` with the filters each fails as bits A=1, B=2, C=4, D=8, E=16.

    The sketch grows with the table up to ``most_counters`` (a power of two; the bitmap that is broadcast has an eighth
    as many bytes). Beyond it more unique texts are grouped than needed; the result is the same.

    * A null text is empty; a null part is the empty string.
    * A row fails E if a row with a smaller id, in any part, has the same text. Rows that share the smallest id all pass.
      A row without id comes after all ids: it fails E if a row with an id has its text. Rows without id may be given as
      one row with their number ``n``.
    """
    if most_counters < 8 * _SEGMENTS or most_counters & (most_counters - 1):
        raise ValueError(f"most_counters is a power of two and {8 * _SEGMENTS} at least")
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    counters = _counters(docs.count(), min(LEAST_COUNTERS, most_counters), most_counters)
    flagged = written(
        rows.mapInArrow(_flagged(counters), "id long, part string, mask int, h long, segment int, places binary"), "flags"
    )
    sketch = flagged.where("segment is not null").select("segment", "places")
    merged = sketch.repartition(_SEGMENTS, "segment").sortWithinPartitions("segment")
    width = counters // _SEGMENTS // 8
    bitmap = np.zeros(counters // 8, np.uint8)
    for row in merged.mapInArrow(_merged(counters), "segment int, bits binary").collect():
        bitmap[row["segment"] * width : (row["segment"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    bits = spark.sparkContext.broadcast(bitmap)

    whole = rows.select("text", "id").mapInArrow(_possible_texts(bits), "h long, text string, id long")
    firsts = written(whole.groupBy("h", "text").agg(F.min("id").alias("id")).select("h", "id"), "firsts")
    narrow = flagged.where("segment is null").select("id", "part", "mask", "h")
    narrow = narrow.mapInArrow(_possible_rows(bits), "id long, part string, mask int, h long, maybe boolean")
    one = F.lit(1).cast("long").alias("n")
    alone = narrow.where(~F.col("maybe")).select("id", "part", "mask", one)
    # The smallest id has the text itself: with it, the hash decides only between rows of one id.
    first = firsts.where("id is not null").withColumn("first", F.lit(True))
    known = narrow.where(F.col("maybe") & F.col("id").isNotNull()).join(first, ["h", "id"], "left")
    known = known.select("id", "part", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask") + 16).alias("mask"), one)
    nameless = narrow.where(F.col("maybe") & F.col("id").isNull()).groupBy("h", "part", "mask").agg(F.count("*").alias("n"))
    named = first.select("h", "first").distinct()
    nameless = nameless.join(named, "h", "left").select(
        F.lit(None).cast("long").alias("id"), "part",
        F.when(F.col("first"), F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"), "n",
    )
    return alone.unionByName(known).unionByName(nameless)


def _orders(counts: pd.DataFrame) -> pd.DataFrame:
    """All orders and steps of one part, from the counts of its masks."""
    mask, n = counts["mask"].to_numpy(), counts["n"].to_numpy()
    good, toxic = n * counts["good"].to_numpy(), n * counts["toxic"].to_numpy()
    failed = np.array([bin(m).count("1") for m in mask.tolist()])
    # A filter comes first among those a document fails in one of so many of the orders.
    turns = n * 120 // np.maximum(failed, 1)
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            fails, there = (mask & bit) > 0, (mask & before) == 0
            gone = fails & there
            out.append((
                "".join(order), step, n[there & ~fails].sum(), n[gone].sum(), n[fails & ~there].sum(), n[mask == bit].sum(),
                good[gone].sum(), toxic[gone].sum(), turns[fails].sum(),
            ))
            before |= bit
    names = [c.split()[0] for c in _COUNTS.split(", ")]
    table = pd.DataFrame(out, columns=names)
    table.insert(0, "part", counts["part"].iloc[0])
    return table


def interactions(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
    quality_col: str = "quality", toxic_col: str = "toxic", most_counters: int = MOST_COUNTERS,
) -> DataFrame:
    """``part, filter_order, step`` with long counts ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    One row for each part that occurs, each of the 120 orders of the filters and each step, zeros included:

    * A: fewer than 200 words. B: fewer distinct words than half the words. C: over 3 per cent A-Z. D: any of ``#$%&*|``.
      E: the text of a smaller id. Words are what stands between ASCII white space. See ``masks`` for odd rows.
    * A document is good (toxic) if any label row of its id says 1; null labels and rows without id say nothing.
    * An empty table of documents gives no rows; without labels nothing good or toxic is lost. Other columns are not read.
    """
    told = labels.select(F.col(id_col).cast("long").alias("id"), F.col(quality_col).alias("q"), F.col(toxic_col).alias("t"))
    told = told.where("id is not null and (q = 1 or t = 1)").groupBy("id").agg(
        F.max(F.coalesce(F.col("q") == 1, F.lit(False)).cast("int")).alias("good"),
        F.max(F.coalesce(F.col("t") == 1, F.lit(False)).cast("int")).alias("toxic"),
    )
    found = masks(docs, id_col, text_col, part_col, most_counters)
    no = F.lit(0)
    labelled = found.where("id is not null").join(told, "id", "left").withColumns(
        {"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)}
    )
    labelled = labelled.unionByName(found.where("id is null").withColumns({"good": no, "toxic": no}))
    counts = labelled.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
    return counts.groupBy("part").applyInPandas(_orders, f"part string, {_COUNTS}")
