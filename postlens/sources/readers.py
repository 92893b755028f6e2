"""Readers with explicit schemas, and typed empty results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens import schemas

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = schemas.RAW_POST) -> DataFrame:
    """One JSON object per line. Unreadable lines are kept aside in ``_corrupt_record``."""
    with_corrupt = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(with_corrupt).option("columnNameOfCorruptRecord", CORRUPT).json(path)


def read_json_document(spark: SparkSession, path: str, schema: T.StructType = schemas.PLAN) -> DataFrame:
    """One nested JSON document per file, such as plans and seeds."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A table of the catalog, which knows the buckets that its rows are in."""
    return spark.table(name)


def empty_posts(spark: SparkSession, schema: T.StructType = schemas.ANALYSED_POST) -> DataFrame:
    return spark.createDataFrame([], schema)


def with_defaults(df: DataFrame, defaults: dict = schemas.REQUIRED_DEFAULTS) -> DataFrame:
    """Add missing columns with their default and fill nulls of existing ones."""
    columns = {}
    for name, default in defaults.items():
        known = name in df.columns
        # The default takes the column's type: text that is no number must not be read as one here.
        columns[name] = F.coalesce(F.col(name), F.lit(default).cast(df.schema[name].dataType)) if known else F.lit(default)
    return df.withColumns(columns)


def with_text(df: DataFrame) -> DataFrame:
    """Stored posts without an analysis text get one from title and body."""
    from postlens.functions.text import match_text

    return df if "text" in df.columns else df.withColumn("text", match_text(F.col("title"), F.col("selftext")))
