"""A corpus pipeline: documents in a known language, each line run once, one of near copies, no benchmark items, as token ids.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame; all but the last return the columns of documents,
and whatever others docs has. A null text counts as empty. Rows that share an id, null ids too, stay or go together, but for what line dedup makes of their texts. Empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import materialize, table
from quire.llm.decontam import keep_clean
from quire.llm.langid import keep_identified
from quire.llm.line_dedup import keep_lines
from quire.llm.minhash import keep_one
from quire.llm.spiece import round_trip


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, null and empty ones among them, or torn between languages go; so do all if no row has a language."""
    return keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs leave the texts, the first by id and line stays; a document of which nothing but blank lines is left goes. Null and empty texts, without any line to repeat, stay."""
    return keep_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least id: those that share at least 0.8 of their five-word shingles. Texts without words are copies of each other."""
    return keep_one(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go. Items without words are in none."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of what is left, checked by decoding: doc_id, n_ids, ids_crc32, same; a row each, repeated ones too."""
    return round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_dedup", near_copies),
    ("decontamination", benchmarks),
    ("sentencepiece", pieces),
]

#: Fingerprints, kernels and pieces can't be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
