"""Session settings, size checks and recovery points shared by all operators."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side table is turned into literals or broadcast only up to these bounds.
MAX_INLINE_ROWS = 20_000

_SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The default of 1000 keeps "newest 2000 per community" from being trimmed before its shuffle.
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings the operators are written for; cluster sizing is left alone."""
    for key, value in _SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def salt_count(spark: SparkSession) -> int:
    """How many ways a hot group is split: as wide as a shuffle, within reason."""
    return max(2, min(512, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def small_rows(df: DataFrame, limit: int = MAX_INLINE_ROWS):
    """The rows of a side table if there are at most ``limit``, else None."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a local session may do without, and gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="postlens-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def recovery_point(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back; later reads are pruned to their columns."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
