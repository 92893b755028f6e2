"""From raw documents to batches: quality, language, near duplicates, contamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the
next stage's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm import decontaminate, language, packing, quality, setjoin
from postlens.llm.common import shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents with a quality score below 0.5 go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels")).select(COLUMNS)


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents without a letter, and those of no learned language, go."""
    return language.keep_known(docs).select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of rows linked by 5-word shingles at 0.8, one stays, that with the smallest id. Texts without words stay.

    Rows are judged one by one: ids that repeat or are null lose no text and keep no copy.
    """
    return setjoin.one_of_each_group(docs, width=5, percent=80).select(COLUMNS)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: contaminated documents go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: a batch and a place for every document."""
    return packing.packed(docs, packing.word_count(F.col("text")))


STAGES = [
    ("quality_classifier", good_documents),
    ("language_id", known_languages),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", clean_of_benchmark),
    ("packing", batches),
]

#: The first two stages are trained models and the last is a dynamic programme: no SQL has their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole table of documents; what each keeps goes to the shared folder."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
