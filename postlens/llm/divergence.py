"""Audit of how the sources of a language differ in their words.

One ``bytes.translate`` lowers A-Z and turns every separator into a space, ``bytes.split`` cuts the terms, and a Counter
per document gives frequencies. Tasks add the Counters up by language and source before anything is shuffled; from then
on the work is on sparse (language, source, term) counts. Distances of two sources need all kept terms, also those that
one of them lacks: terms are dealt into blocks, sources into blocks, and each tile of them is a small dense matrix.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.common import texts, written

#: Documents of a language that a term must occur in, what is added to each count, and the unit of shares.
LEAST_DOCS, ADDED, UNIT = 30, 5, 1_000_000_000
TOP_TERMS = 50
#: Terms and sources of a tile, about and at most.
TERM_BLOCK, SOURCE_BLOCK = 1_024, 128
#: Different (language, source, term) that a task holds before it hands them on.
_HELD = 400_000


def _translate_table() -> bytes:
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    for letter in range(ord("a"), ord("z") + 1):
        table[letter] = table[letter - 32] = letter
    return bytes(table)


_TABLE = _translate_table()


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of every term by language and source; a row without term names a group."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def released() -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs) in held.items():
            terms = [None, *counts]
            n = len(terms)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()),
                 pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *counts.values()], pa.int64()),
                 pa.array([0, *(docs[t] for t in counts)], pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )
        held.clear()

    size = 0
    for batch in batches:
        groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
        for group, text in zip(groups, texts(batch.column("text"))):
            counts, docs = held.setdefault(group, (Counter(), Counter()))
            size -= len(counts)
            own = Counter(terms_of(text))
            counts.update(own)
            docs.update(own.keys())
            size += len(counts)
            if size + len(held) > _HELD:
                yield from released()
                size = 0
    yield from released()


def _share(n: str, total: str, terms: str) -> str:
    """The share of a count, exactly: ``n`` may be so large that its product with the unit leaves 64 bits.

    Where a language keeps no terms there is nothing to share, and the divisor is 1 instead of 0.
    """
    product = f"cast({UNIT} as decimal(10,0)) * cast({n} + {ADDED} as decimal(19,0))"
    return f"(1 + ({product}) div cast(greatest({total} + {ADDED} * {terms}, 1) as decimal(20,0)))"


def _tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Summed differences of all pairs of two blocks of sources, over the terms of one block that either block has."""
    lang, _, i, j = key
    marks, cells = rows[rows["term"].isna()], rows[rows["term"].notna()]
    codes, found = pd.factorize(cells["term"])
    blocks = []
    for block in (i, j):
        own = marks[marks["block"] == block].sort_values("source_no")
        matrix = np.repeat(own["p"].to_numpy()[:, None], len(found), axis=1)
        mine = (cells["block"] == block).to_numpy()
        at = np.searchsorted(own["source_no"].to_numpy(), cells["source_no"].to_numpy()[mine])
        matrix[at, codes[mine]] = cells["p"].to_numpy()[mine]
        blocks.append((own["source_no"].to_numpy(), matrix))
    (left, a), (right, b) = blocks
    sums = np.array([np.abs(b - row).sum(axis=1) for row in a]).reshape(len(left), len(right))
    out = pd.DataFrame({
        "lang": lang, "one": np.repeat(left, len(right)), "other": np.tile(right, len(left)),
        "apart": sums.ravel(), "seen": np.int64(len(found)),
    })
    out = out[out["one"] != out["other"]]
    return out if i == j else pd.concat([out, out.rename(columns={"one": "other", "other": "one"})[out.columns]])


def divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS,
    top: int = TOP_TERMS, term_block: int = TERM_BLOCK, source_block: int = SOURCE_BLOCK,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source is from the others of its language, and by which terms.

    A term is a run of ASCII letters and non-ASCII characters, A-Z in lower case. A language keeps the terms of at least
    ``least_docs`` of its documents. The share of a kept term is exact integer arithmetic on smoothed counts. Rows with
    ``part`` 'pair' have another source and the summed differences of shares; those with 'term' a term that the source has
    more of than its language, the ``top`` of them. Ranks go by value downwards, then by the item's bytes.

    * Null text, language and source are empty strings; a text without terms still makes its (language, source) a group.
    * A language without kept terms has distances of 0 and no terms; one with a single source has no pairs.
    * Repeated rows each count. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(blank(text_col).alias("text"), blank(lang_col).alias("lang"), blank(source_col).alias("source"))
    counted = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    # Dealt by language and term, both the counts and the test of a term's documents need no further shuffle.
    cells = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )
    of_term = Window.partitionBy("lang", "term")
    cells = cells.withColumns({"docs": F.sum("docs").over(of_term), "everywhere": F.sum("n").over(of_term),
                               "first": F.row_number().over(of_term.orderBy("source")) == 1})
    cells = written(cells.where(F.col("term").isNull() | (F.col("docs") >= least_docs)).drop("docs"), "terms")

    langs = cells.groupBy("lang").agg(
        F.count_if(F.col("first") & F.col("term").isNotNull()).alias("terms"), F.sum("n").alias("lang_total"),
    )
    groups = cells.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(langs, "lang")
    numbered = Window.partitionBy("lang").orderBy("source")
    groups = written(
        groups.withColumn("source_no", F.row_number().over(numbered).cast("long") - 1)
        .withColumn("blocks", F.max("source_no").over(Window.partitionBy("lang")).cast("long"))
        .withColumns({
            "block": F.expr(f"source_no div {source_block}"), "blocks": F.expr(f"blocks div {source_block} + 1"),
            "buckets": F.expr(f"terms div {term_block} + 1"), "none": F.expr(_share("0", "total", "terms")),
        }),
        "groups",
    )
    kept = cells.where("term is not null").join(groups, ["lang", "source"])
    kept = kept.withColumn("p", F.expr(_share("n", "total", "terms")))

    more = kept.withColumn("value", F.col("p") - F.expr(_share("everywhere", "lang_total", "terms"))).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top_terms = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    top_terms = top_terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    bucket = F.pmod(F.xxhash64("term"), F.col("buckets"))
    tiled = kept.select("lang", "source_no", "block", "blocks", "term", "p", bucket.alias("bucket"))
    marks = groups.select(
        "lang", "source_no", "block", "blocks", F.lit(None).cast("string").alias("term"), F.col("none").alias("p"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("bucket"),
    )
    met = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("met")
    tiled = tiled.unionByName(marks).select("*", met).select(
        "lang", "bucket", F.least("block", "met").alias("i"), F.greatest("block", "met").alias("j"), "block", "source_no", "term", "p"
    )
    sums = tiled.groupBy("lang", "bucket", "i", "j").applyInPandas(
        _tile, "lang string, one long, other long, apart long, seen long"
    )
    sums = sums.groupBy("lang", "one", "other").agg(F.sum("apart").alias("apart"), F.sum("seen").alias("seen"))
    one = groups.select("lang", F.col("source_no").alias("one"), "source", "terms", F.col("none").alias("own"))
    other = groups.select("lang", F.col("source_no").alias("other"), F.col("source").alias("item"), F.col("none").alias("its"))
    pairs = sums.join(one, ["lang", "one"]).join(other, ["lang", "other"]).select(
        "lang", "source", F.lit("pair").alias("part"), "item",
        (F.col("apart") + (F.col("terms") - F.col("seen")) * F.abs(F.col("own") - F.col("its"))).alias("value"),
    )
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(top_terms)
