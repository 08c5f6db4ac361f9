"""What the operators share: tables, the shared folder, gapless numbering."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import discard, scratch_path
from ..sources.scratch import written as materialize

__all__ = ["ASCII_SPACE", "discard", "gapless", "let", "materialize", "scratch_path", "settled", "table", "text_slices", "whole", "without"]

#: ASCII white space, as in the contracts: space, and tab to carriage return.
ASCII_SPACE = r"[\x20\x09-\x0D]"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def text_slices(batch: pa.RecordBatch, column: int, most_chars: int, most_rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch and their texts (null as empty), of at most so many rows and about so many characters; a longer text is a part by itself."""
    at, texts, size = 0, [], 0
    for k in range(0, batch.num_rows, 16):
        for t in batch.column(column).slice(k, 16).to_pylist():
            t = t or ""
            if texts and (size + len(t) > most_chars or len(texts) == most_rows):
                yield batch.slice(at, len(texts)), texts
                at, texts, size = at + len(texts), [], 0
            texts.append(t)
            size += len(t)
    if texts:
        yield batch.slice(at, len(texts)), texts


def settled(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which the worker, which Spark keeps for later tasks, gives the memory that it has freed back to the system."""

    def whole_run(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return whole_run


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over value, which is computed once a row. A lambda of a higher-order function would compute a plain column anew for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs but for the ids in gone's only column, null among them. The list is written first, so Spark knows its size when it chooses the join."""
    name = f"gone_{uuid.uuid4().hex}"  # no column of docs
    gone = materialize(gone.toDF(name).distinct(), "gone")
    return docs.join(gone, docs[id_col].eqNullSafe(F.col(name)), "left_anti")


def gapless(df: DataFrame, keys: list[str], order: list[str | Column], spread: Column, buckets: int, name: str) -> DataFrame:
    """Add column name: 0, 1, 2, ... within equal keys, without bringing a key's rows into one task.

    Rows of a key are dealt over buckets by spread; each bucket is numbered by itself and starts where the buckets before it end.
    A bucket of a key is the largest unit that one task sorts, and the table of starts has a row for each of them.
    """
    dealt = df.withColumn("_bucket", F.pmod(spread, F.lit(buckets)).cast("int"))
    unit = [*keys, "_bucket"]
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*unit).agg(F.count("*").alias("_n")).select(*[F.col(k).alias(f"_of_{k}") for k in unit], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy(*unit).orderBy(*order)))
    joined = ranked.join(starts, on=[F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in unit])
    return joined.select(*df.columns, (F.col("_start") + F.col("_rank") - 1).cast("long").alias(name))
