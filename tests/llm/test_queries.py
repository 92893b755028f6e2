"""The registered queries over the smallest tables, and the pipeline."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from postlens.llm import queries

TESTDATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = contract.queries()[name](spark, TESTDATA)
    rows = df.collect()
    assert rows and (name.startswith(("op7", "op10", "op11", "op12", "op13")) or len(rows) == spark.read.parquet(f"{TESTDATA}/documents.parquet").count())
    if name in queries.SQL:
        tables = duckdb.connect()
        for table in ("documents", "benchmark", "pages", "labels", "embeddings"):
            tables.execute(f"create view {table} as select * from '{TESTDATA}/{table}.parquet'")
        expected = tables.sql(queries.SQL[name]).to_arrow_table()
        columns = sorted(df.columns)
        assert sorted(expected.column_names) == columns
        got = sorted(repr([r[c] for c in columns]) for r in rows)
        assert got == sorted(repr(list(x)) for x in zip(*[expected[c].to_pylist() for c in columns]))


def test_pipeline(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "language_id", "ngram_jaccard_join", "benchmark_decontamination", "packing"]
    assert "pipeline" in contract.queries()
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    left = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, TESTDATA)
        assert name == "packing" or out.columns == docs.columns
        rows = out.count()
        assert 0.7 * left <= rows <= left
        docs, left = (docs if name == "packing" else spark.createDataFrame(out.collect(), out.schema)), rows
    assert corpus_pipeline.run(spark, TESTDATA).count() == left
