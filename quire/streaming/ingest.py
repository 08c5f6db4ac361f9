"""Incremental ingest: an inbox of files as a stream, and states as streams of events."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.corpus import latest
from ..sources import store
from ..sources.files import MOST_BYTES, admitted
from ..sources.sinks import write_page_rows
from . import jobs


def inbox(spark: SparkSession, path: str, files_per_batch: int = 1000, most_bytes: int = MOST_BYTES) -> DataFrame:
    """New PDF files of a folder, as a stream of path, doc_id, content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.[pP][dD][fF]").option("maxFilesPerTrigger", files_per_batch)
    return admitted(reader.load(path), most_bytes)


def first_start(spark: SparkSession, checkpoint: str) -> str:
    """When the stream with this checkpoint first began, as text that sorts; kept beside it, so that its batches have the same names when they are run again."""
    at = f"{checkpoint}/first"
    if not store.exists(spark, at):
        spark.createDataFrame([(f"{time.time_ns() // 1000:018d}",)], "value string").coalesce(1).write.mode("overwrite").text(at)
    return spark.read.text(at).first()[0]


def ingest(
    documents: DataFrame, process: Callable[[DataFrame], DataFrame], pages_path: str, checkpoint: str, canceled: Callable[[], DataFrame] | None = None, log: str | None = None
) -> StreamingQuery:
    """Process what is there, then stop. Each batch's page rows replace those that their documents had (sinks.read_page_rows()), and a document that comes back without pages is emptied. A batch that is run
    again replaces itself: runs are named by the stream's first start, then by the batch. canceled gives doc_ids to leave out. sinks.fold_page_rows() tidies up, now and then.

    log: where the events of documents go (jobs.EVENTS), before a batch is processed and after it: submitted and started, then the number of pages and finished, or failed without any. jobs.job_states() over
    read_log() makes states and progress of them, for whoever waits.
    """
    spark = documents.sparkSession
    began = first_start(spark, checkpoint)

    def batch(df: DataFrame, number: int) -> None:
        if canceled is not None:
            gone = canceled().select(F.col("doc_id").alias("_gone")).distinct()
            df = df.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
        run = f"{began}-{number:010d}"
        if log is not None:
            _events(df.select("doc_id").distinct(), jobs.SUBMITTED, jobs.STARTED).write.mode("overwrite").parquet(f"{log}/run=r-{run}-0")
        write_page_rows(process(df), pages_path, df, run)
        if log is not None:
            store_run = spark.read.parquet(f"{pages_path}/runs/run=r-{run}").groupBy(F.col("doc_id").alias("_d")).agg(F.count("*").cast("int").alias("n"))
            counted = spark.read.parquet(f"{pages_path}/lists/run=r-{run}").join(store_run, F.col("_id") == F.col("_d"), "left").select(F.col("_id").alias("doc_id"), "n")
            done = _events(counted.filter("n is not null"), jobs.PAGE, jobs.FINISHED)
            done.unionByName(_events(counted.filter("n is null"), jobs.FAILED)).write.mode("overwrite").parquet(f"{log}/run=r-{run}-1")

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()


def _events(documents: DataFrame, *events: str) -> DataFrame:
    """jobs.EVENTS of documents (doc_id; n, their pages, where that is known), in that order."""
    n = F.col("n") if "n" in documents.columns else F.lit(None).cast("int")
    each = documents.withColumn("n", n).select("doc_id", "n", F.posexplode(F.array(*map(F.lit, events))).alias("seq", "event"))
    message = F.when(F.col("event") == jobs.FAILED, "No pages")
    return each.select("doc_id", "event", F.current_timestamp().alias("at"), F.col("seq").cast("long").alias("seq"), F.col("n").alias("page"), F.col("n").alias("total"), message.alias("message"))


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """The events that ingest() has logged, as a stream."""
    return spark.readStream.schema(jobs.EVENTS + ", run string").parquet(log).drop("run")


def last_states(events: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """A stream of the last row of each key, for the update or complete mode."""
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), at).alias("last")).select(key, "last.*")


def write_last_states(states: DataFrame, key: str, path: str, checkpoint: str) -> StreamingQuery:
    """Write what each batch changes of a stream of last states (update mode) as rows of path; last_of() has the last of each key. Stops when all is read."""

    def batch(df: DataFrame, number: int) -> None:
        df.withColumn("batch", F.lit(number).cast("long")).write.mode("append").parquet(path)

    return states.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_of(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The rows that write_last_states() wrote last for each key. A batch that was run again wrote the same rows."""
    return latest(spark.read.parquet(path), [key], "batch").drop("batch")
