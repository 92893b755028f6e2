"""Where a row is, for ranking narrow rows first and fetching the wide ones afterwards.

An id does not name a row: it may be null or repeat. A row of a Parquet table is named by its file (a hash of its path)
and its number in it, which the reader knows without reading anything else.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.logger import PySparkLogger
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.config import written

FILE, ROW = "_file", "_row"
LOCATOR = [FILE, ROW]
#: So many ranked rows are broadcast when the wide rows are fetched; each is a few numbers.
MAX_FETCHED = 200_000


def located(df: DataFrame) -> DataFrame:
    """``df`` with its rows' locators as two more columns; what is no stored table is stored first."""
    return _located(df) or _named(written(df, "rows"))


def spread(df: DataFrame) -> DataFrame:
    """Like ``located``; what is stored for that is dealt evenly, whatever files its rows came from."""
    return _located(df) or _named(written(dealt(df), "rows"))


def in_place(df: DataFrame) -> DataFrame | None:
    """``df`` with its rows' locators, or None for what is no stored table."""
    return _located(df)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` in even parts, whatever files its rows come from."""
    return df.repartition(_parts(df))


def placed(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` stored with locators that follow its own values, so that ties by them are broken alike on every run."""
    parts = df.repartitionByRange(_parts(df), *order).sortWithinPartitions(*order)
    return written(parts.withColumns({FILE: F.lit(0).cast("long"), ROW: F.monotonically_increasing_id()}), "rows")


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _located(df: DataFrame) -> DataFrame | None:
    if set(LOCATOR) <= set(df.columns):
        return df
    logger = PySparkLogger.getLogger("DataFrameQueryContextLogger")
    quiet, logger.disabled = logger.disabled, True  # a plan without files is no error here
    try:
        return _named(df)
    except AnalysisException:
        return None
    finally:
        logger.disabled = quiet


class Late:
    """Wide columns that are fetched after rows are ranked, where that is possible without storing them first.

    Of a stored table, ``carried`` are the locators, and ``fetch`` reads the wide columns of the rows that are left. In any
    other plan the wide columns are carried along. Both give the same rows.
    """

    def __init__(self, df: DataFrame, wide: list[str]):
        rows = _located(df)
        self.rows, self.wide, self.stored = rows or df, wide, rows is not None
        self.carried = LOCATOR if self.stored else wide
        #: Breaks ties between rows that are equal in all else.
        self.order = [F.asc(c) for c in self.carried]

    def fetch(self, ranked: DataFrame) -> DataFrame:
        return fetched(self.rows, ranked, self.wide) if self.stored else ranked


def _named(df: DataFrame) -> DataFrame:
    return df.select("*", F.xxhash64("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))


def fetched(rows: DataFrame, ranked: DataFrame, columns: list[str], max_fetched: int = MAX_FETCHED) -> DataFrame:
    """``ranked`` with the given columns of the located ``rows`` it names. Only these columns are read.

    The ranked rows are stored first. Up to ``max_fetched`` of them (counted) meet the wide rows where those are read;
    more are joined, and the wide rows are shuffled. That is said to the optimizer, which would take millions of ranked rows
    for a small table: they repeat themselves, so their files are small.
    """
    ranked = written(ranked, "ranked")
    few = ranked.limit(max_fetched + 1).count() <= max_fetched
    ranked = F.broadcast(ranked) if few else ranked.hint("merge")
    return rows.select(*LOCATOR, *columns).join(ranked, LOCATOR).drop(*LOCATOR)
