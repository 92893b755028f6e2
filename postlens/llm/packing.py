"""Packing into batches: optimal length buckets from the global histogram, then batches of a token budget in each.

Every document of a bucket is padded to the bucket's bound. Dynamic programming over the histogram of all lengths
chooses the bounds that make the padding least, at any number of distinct lengths.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.common import checkpointed

BUCKETS, TOKEN_BUDGET = 8, 65_536
#: Lengths up to here have a bin of their own; None: all lengths have, and the padding is the least. A number is for users
#: who want a smaller histogram: a length's bin depends on that length alone, never on how many others there are.
MOST_LENGTHS: int | None = None
#: Above, each doubling of the length has this many bins; lengths up to ``_EXACT`` always have their own.
_EXACT, _PER_DOUBLING = 256, 128
#: Documents numbered by one task.
_PER_TASK = 500_000


def word_count(text: Column) -> Column:
    """Words between white space; none in a null text."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), ""))


def _bin(length: Column, most: int | None) -> Column:
    """The bin of a length; above ``most`` bins are about 0.5 % wide."""
    if most is None:
        return length
    most = max(most, _EXACT)
    wide = most + F.floor(F.log2(length / most) * _PER_DOUBLING)
    return F.when(length < most, length).otherwise(wide)


def best_bounds(longest: np.ndarray, counts: np.ndarray, sums: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least padding; bins come in order of length.

    Each bound is the longest length of a bin. The best start of a last bucket never moves down as its end moves up, so
    halving the range of ends halves that of starts: O(buckets × bins × log bins).
    """
    n = len(longest)
    if not n:
        return []
    count = np.concatenate(([0], np.cumsum(counts, dtype=np.float64)))
    total = np.concatenate(([0], np.cumsum(sums, dtype=np.float64)))
    best = np.concatenate(([0.0], np.full(n, np.inf)))
    came = []
    for _ in range(min(buckets, n)):
        following, source = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        following[0] = 0
        ranges = [(1, n, 0, n - 1)]
        while ranges:
            first, last, low, high = ranges.pop()
            j = (first + last) // 2
            some = slice(low, min(high, j - 1) + 1)
            cost = best[some] + longest[j - 1] * (count[j] - count[some]) - (total[j] - total[some])
            k = int(np.argmin(cost))
            source[j], following[j] = low + k, cost[k]
            if first < j:
                ranges.append((first, j - 1, low, low + k))
            if j < last:
                ranges.append((j + 1, last, low + k, high))
        came.append(source)
        best = following
    bounds, j = [], n
    for source in reversed(came):
        if j:
            bounds.append(int(longest[j - 1]))
            j = int(source[j])
    return bounds[::-1]


def bucket_bounds(lengths: DataFrame, length_col: str, buckets: int = BUCKETS) -> list[int]:
    """The bounds for all lengths of a table.

    What comes to the driver is three numbers per distinct length. Those add up to no more than all tokens do, so n tokens
    have at most the square root of 2n different lengths: 1.5 million, 36 MB, for a trillion.
    """
    bins = lengths.groupBy(_bin(F.col(length_col), MOST_LENGTHS).alias("bin")).agg(
        F.max(length_col).alias("longest"), F.count("*").alias("n"), F.sum(length_col).alias("sum")
    )
    rows = bins.orderBy("bin").select("longest", "n", "sum").toArrow()
    return best_bounds(*(rows.column(c).to_numpy() for c in ("longest", "n", "sum")), buckets)


def packed(
    docs: DataFrame, length: Column, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, id_col: str = "doc_id"
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_tokens``, ``bucket`` (from 0), ``bound``, ``batch_id``, ``place``, ``padding``.

    A batch has documents of one bucket, as many as fit into ``budget`` tokens when padded to the bound; a bucket whose
    bound exceeds the budget has batches of one document. All batches of a bucket but its last are full. ``batch_id`` is
    ``bucket * 2^40`` plus the number of the batch; ``place`` counts from 0 in a batch.

    A null or negative length counts as 0. Rows with equal or null ids each have a place. An empty table gives no rows.
    Other columns are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    rows = checkpointed(rows)
    bounds = bucket_bounds(rows, "n", buckets) or [0]
    bucket, bound = F.lit(len(bounds) - 1), F.lit(bounds[-1])
    for i in reversed(range(len(bounds) - 1)):
        bucket = F.when(F.col("n") <= bounds[i], i).otherwise(bucket)
        bound = F.when(F.col("n") <= bounds[i], bounds[i]).otherwise(bound)
    rows = rows.select("id", "n", bucket.alias("bucket"), bound.cast("long").alias("bound"))
    # Numbers in a bucket: by slices of a hash, each numbered by one task, after the counts of the slices before.
    slices = F.broadcast(
        rows.groupBy("bucket").agg(F.expr(f"1 + count(1) div {_PER_TASK}").alias("slices"))
    )  # at most one row per bucket
    # Rows without id are told apart by their place in the checkpoint, so that no slice holds all of them.
    alike = F.when(F.col("id").isNull(), F.monotonically_increasing_id())
    rows = rows.select("*", F.xxhash64("id", "n", alike).alias("hash")).join(slices, "bucket")
    rows = rows.withColumn("slice", F.pmod("hash", "slices")).drop("hash", "slices")
    rows = rows.repartition("bucket", "slice")
    counts = rows.groupBy("bucket", "slice").agg(F.count("*").alias("size"))
    before = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    own = Window.partitionBy("bucket", "slice").orderBy("n", "id")
    rows = rows.withColumn("number", F.row_number().over(own) - 1).join(counts, ["bucket", "slice"])
    number, fit = F.col("number") + F.col("before"), F.greatest(F.lit(1), F.expr(f"{budget} div greatest(bound, 1)"))
    return rows.select(
        F.col("id").alias(id_col), F.col("n").alias("n_tokens"), "bucket", "bound",
        (F.col("bucket") * F.lit(1 << 40) + F.floor(number / fit)).alias("batch_id"), (number % fit).cast("int").alias("place"),
        (F.col("bound") - F.col("n")).alias("padding"),
    )
