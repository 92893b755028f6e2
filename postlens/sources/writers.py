"""Sinks. All write in parallel; text reports keep their line order by a sorted write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_posts(df: DataFrame, path: str, by_cluster: bool = False, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy("cluster") if by_cluster else writer).parquet(path)


def write_raw_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The raw post store, one folder per month of creation, so a time window prunes folders."""
    month = F.date_format(F.timestamp_seconds("created_utc"), "yyyy-MM")
    df.withColumn("created_month", month).write.mode(mode).partitionBy("created_month").parquet(path)


#: The slice of its community's rows that a row of a bucketed table belongs to.
SLICE = "community_slice"


def write_bucketed_table(df: DataFrame, name: str, path: str, buckets: int = 200, slices: int = 8, mode: str = "overwrite") -> None:
    """The raw post store as a table of the catalog: a folder per month, its rows in buckets by community.

    Searches of many communities join it without shuffling a post. As one community may hold a large share of all rows,
    each is dealt over ``slices`` by a hash of its rows, and the buckets go by community and slice.
    """
    month = F.date_format(F.timestamp_seconds("created_utc"), "yyyy-MM")
    dealt = F.pmod(F.xxhash64("id", "created_utc"), F.lit(slices)).cast("int")
    # Dealt as the buckets are, so that a task writes one file a month for its bucket.
    rows = df.withColumns({"created_month": month, SLICE: dealt}).repartition(buckets, "subreddit", SLICE)
    rows.write.mode(mode).option("path", path).partitionBy("created_month").bucketBy(buckets, "subreddit", SLICE).saveAsTable(name)


def write_plans(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_report(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Report lines ``(line_no, line)`` as text files whose names follow the line order."""
    lines.orderBy("line_no").select(F.col("line").alias("value")).write.mode(mode).text(path)
