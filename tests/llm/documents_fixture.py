from __future__ import annotations

import pytest
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string"


@pytest.fixture
def documents(spark):
    """Documents from ``(id, text)`` pairs, with more columns whose names clash with those the operators use."""

    def make(rows):
        df = spark.createDataFrame(rows, DOCUMENTS)
        extra = {name: F.lit("x") for name in ("row", "id", "sid", "n", "w", "token", "_hash", "score", "bucket", "Slot", "found")}
        return df.withColumns(extra)

    return make
