"""Incremental ingest of raw posts.

Items arrive newest first, so the watermark is on the time of ingest: one on the creation time would drop
older posts as late. State holds the ids of the watermark's span only; an id that comes again later is
written again, and :func:`postlens.operators.select.first_wins` decides when the sink is read.

:func:`write_once` has no such span: a ledger in the sink holds every id there has been, and each batch leaves out those
of earlier batches. A batch that is repeated after a failure writes the same folders again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postlens import schemas
from postlens.config import written
from postlens.functions import match
from postlens.functions.text import match_text
from postlens.operators.sentiment import scored
from postlens.operators.topn import first_per_key
from postlens.sources.posts import min_score, to_posts

STREAM_SOURCE = "stream"


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schemas.RAW_POST).option("maxFilesPerTrigger", files_per_batch).json(path)


def _first_copies(raw: DataFrame, min_upvotes: int, delay: str) -> DataFrame:
    posts = min_score(to_posts(raw, STREAM_SOURCE), min_upvotes)
    if raw.isStreaming:
        return posts.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["id"])
    return first_per_key(posts, ["id"], [-F.col("created_utc"), F.col("selftext"), F.col("title")])


def _kept(once: DataFrame, lexicon: DataFrame, keywords, exclude, rules: bool) -> DataFrame:
    text = match_text(F.col("title"), F.col("selftext"))
    kept = once.where(match.exclude_filter(text, exclude)).where(match.include_filter(text, keywords))
    return scored(kept, lexicon, rules)


def ingest(raw: DataFrame, lexicon: DataFrame, min_upvotes: int = 0, keywords=(), exclude=(), rules: bool = True,
           delay: str = "2 days") -> DataFrame:
    """Raw items to scored posts. The first copy of an id counts, also if the filters then drop it.

    On a stream the first copy is the one that arrives first; on a batch, the newest.
    """
    return _kept(_first_copies(raw, min_upvotes, delay), lexicon, keywords, exclude, rules)


def write_once(raw: DataFrame, lexicon: DataFrame, path: str, checkpoint: str, min_upvotes: int = 0, keywords=(), exclude=(),
               rules: bool = True) -> StreamingQuery:
    """Scored posts to ``path/posts``, each id once for all time; stops when the input present now is done.

    The first copy of an id counts: of one batch the newest, else that of the earlier batch, also if the filters drop it.
    Ids go to ``path/ledger`` by batch; items without id are one. A batch reads the ledger once and shuffles ids only.
    """

    def batch(items: DataFrame, number: int) -> None:
        spark = items.sparkSession
        once = _first_copies(items, min_upvotes, "")
        if number:
            ledger = spark.read.schema("id string, batch long").parquet(f"{path}/ledger")
            earlier = ledger.where(F.col("batch") < number).select(F.col("id").alias("_id"))
            once = once.join(earlier, once["id"].eqNullSafe(earlier["_id"]), "left_anti")
        once = written(once, "batch")  # the posts and the ledger have to agree
        _kept(once, lexicon, keywords, exclude, rules).write.mode("overwrite").parquet(f"{path}/posts/batch={number}")
        once.select("id").write.mode("overwrite").parquet(f"{path}/ledger/batch={number}")

    return (
        raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def write_stream(posts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to parquet and stop when the input present now is done."""
    return (
        posts.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
