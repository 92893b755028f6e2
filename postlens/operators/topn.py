"""Top rows per group and first row per key, safe for groups that hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.config import salt_count

#: Up to this many rows per group, what each task sends for a hot group needs no splitting.
SALT_ABOVE = 50


def top_n(df: DataFrame, groups: list[str], order: list[Column], n: int, salt_on: str | None = None,
          rank: str = "rank") -> DataFrame:
    """Rows ranked 1..n inside each group, with the rank as a column.

    A rank limit directly on a window is applied before the shuffle too, so a task sends at most ``n`` rows
    per group. For a large ``n`` those still add up on the one task that owns a hot group; then the group is
    first ranked in ``salt_on`` slices. Slicing never changes the result: a row in the top n of its group is
    in the top n of its slice.
    """
    if n > SALT_ABOVE and salt_on is not None:
        slices = F.pmod(F.xxhash64(salt_on), F.lit(salt_count(df.sparkSession)))
        by_slice = Window.partitionBy(*groups, "_slice").orderBy(*order)
        df = (
            df.withColumn("_slice", slices)
            .withColumn("_rank", F.row_number().over(by_slice))
            .where(F.col("_rank") <= n)
            .drop("_slice", "_rank")
        )
    by_group = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(by_group)).where(F.col(rank) <= n)


def top_slices(df: DataFrame, order: list[Column], n: int, salt_on: str | None = None) -> DataFrame:
    """The first ``n`` rows of all. What many tasks have of them is first cut to ``n`` rows per slice of ``salt_on``."""
    if n > SALT_ABOVE and salt_on is not None:
        slices = F.pmod(F.xxhash64(salt_on), F.lit(salt_count(df.sparkSession)))
        by_slice = Window.partitionBy("_slice").orderBy(*order)
        df = df.withColumn("_slice", slices).withColumn("_rank", F.row_number().over(by_slice))
        df = df.where(F.col("_rank") <= n).drop("_slice", "_rank")
    return df.orderBy(*order).limit(n)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key; null keys are one key. Copies of a key collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    first = F.min_by(row, F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_row")).select(*keys, "_row.*").select(*df.columns)
