"""Sinks: page JSON, merged documents, texts, the corpus, statistics, progress, page rows.

Tables are rows in a bounded number of folders, whatever the number of documents; what a run writes of a document replaces what was there (store.py). Files by name, one a page or
document, are an export: a function that the caller gives puts them where they belong.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import cells, corpus_records, corpus_stats, fold_cells, latest, verdict_deltas, verify
from ..operators.documents import document_rollup, document_text
from ..operators.report import document_reports, page_report, with_page_columns
from . import store
from .files import PROGRESS_SCHEMA, read_page_json, read_verifications


def _documents(given: DataFrame | None, rows: DataFrame) -> DataFrame:
    return rows.select("doc_id") if given is None else given.select("doc_id")


def write_page_json(pages: DataFrame, root: str, documents: DataFrame | None = None, buckets: int = store.BUCKETS) -> None:
    """Pages as JSON lines in a table (store.py): they replace all pages of the documents, which are those of pages if they aren't given. read_page_json() reads them back."""
    store.replace(pages, _documents(documents, pages), root, form="json", buckets=buckets)


def _tagged(documents: DataFrame, pages: DataFrame) -> DataFrame:
    tags = document_rollup(pages).select(F.col("doc_id").alias("_d"), "output_engine_tag")
    return documents.join(tags, F.col("doc_id") == F.col("_d"), "left").drop("_d")


def merged_documents(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, output_engine_tag, json: the report of each document with its pages in order."""
    return document_reports(documents, pages)


def document_texts(pages: DataFrame) -> DataFrame:
    """doc_id, output_engine_tag, text: the texts of each document's pages in order."""
    return _tagged(document_text(pages), pages)


def write_merged_json(documents: DataFrame, pages: DataFrame, root: str) -> None:
    """merged_documents() as JSON lines in a table, with the tag as a column: they replace what it had of the documents, as a second run may be another engine's."""
    store.replace(merged_documents(documents, pages), documents, root, form="json")


def write_texts(pages: DataFrame, root: str, documents: DataFrame | None = None) -> None:
    """document_texts() likewise; documents, if given, are those of the run, with or without pages."""
    store.replace(document_texts(pages), _documents(documents, pages), root, form="json")


def page_files(pages: DataFrame) -> DataFrame:
    """name, content: <doc_id>/page_<n>_<engine>.json for each page, its report with the document's id."""
    engine = F.regexp_replace(F.coalesce("engine", F.lit("unknown")), r"[^A-Za-z0-9._-]+", "-")
    name = F.concat("doc_id", F.lit("/page_"), F.col("page_number").cast("string"), F.lit("_"), engine, F.lit(".json"))
    own = with_page_columns(pages)
    named = own.select(name.alias("name"), "doc_id", page_report().alias("page")).select("name", "doc_id", "page.*")
    return named.select("name", F.to_json(F.struct(*named.columns[1:])).alias("content"))


def document_files(rows: DataFrame, column: str, suffix: str) -> DataFrame:
    """name, content: <doc_id>_<tag><suffix> for each row of merged_documents() or document_texts()."""
    return rows.select(F.concat_ws("_", "doc_id", "output_engine_tag", F.lit("")).alias("name"), F.col(column).alias("content")).select(
        F.concat(F.regexp_replace("name", "_$", ""), F.lit(suffix)).alias("name"), "content"
    )


def export_files(files: DataFrame, put: Callable[[str, str], None]) -> DataFrame:
    """name, error: what becomes of each file (name, content) that put() is asked to write; the error is null if all is well. Files are written when the result is."""
    import pandas as pd

    def one(name: str, content: str) -> str | None:
        try:
            put(name, content)
        except Exception as e:  # noqa: BLE001  stores are foreign code
            return str(e)[:180] or type(e).__name__
        return None

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"name": b["name"], "error": [one(*x) for x in zip(b["name"], b["content"])]}, dtype=object)

    return files.select("name", "content").mapInPandas(run, "name string, error string")


def delete_files(spark: SparkSession, *patterns: str) -> int:
    """Delete files and folders by path patterns, through Spark's file systems; how many there were. For the exports of a document, not for tables."""
    gone = 0
    for pattern in patterns:
        at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        system = at.getFileSystem(spark._jsc.hadoopConfiguration())
        for found in system.globStatus(at) or []:
            gone += bool(system.delete(found.getPath(), True))
    return gone


def write_corpus(pages: DataFrame, path: str, form: str = "parquet") -> None:
    """Corpus records as Parquet, or as JSON lines."""
    corpus_records(pages).write.mode("overwrite").format("json" if form == "jsonl" else form).save(path)


def write_stats(records: DataFrame, path: str) -> None:
    corpus_stats(records).write.mode("overwrite").json(path)


def rebuild_corpus(spark: SparkSession, pages_path: str, corpus_path: str, stats_path: str, verifications_path: str | None = None, cells_path: str | None = None) -> None:
    """Corpus and statistics anew from all page JSON and the last verification of each page."""
    pages = read_page_json(spark, pages_path)
    pages = verify(pages, read_verifications(spark, verifications_path)) if verifications_path else pages
    write_corpus(pages, corpus_path)
    records = spark.read.parquet(corpus_path).drop("full_text")
    write_stats(records, stats_path)
    if cells_path is not None:
        write_cells(records, cells_path)


def write_cells(records: DataFrame, path: str) -> None:
    """Statistics of the corpus as cells (corpus.cells()); deltas of before are gone."""
    spark = records.sparkSession
    cells(records).write.mode("overwrite").parquet(f"{path}/cells")
    store.drop(spark, f"{path}/deltas")


def append_verdicts(records: DataFrame, verdicts: DataFrame, verifications_path: str, cells_path: str, run: str) -> None:
    """A run of verdicts: what they change of the statistics, then the verdicts themselves, each under the run's name; a run that is made again replaces itself. No page is read, and of records (of the corpus) no text."""
    spark = records.sparkSession
    own = f"{verifications_path}/run=r-{run}"
    store.drop(spark, own)
    before = read_verifications(spark, verifications_path) if store.exists(spark, verifications_path) else verdicts.limit(0)
    verdict_deltas(records, before, verdicts).write.mode("overwrite").parquet(f"{cells_path}/deltas/run=r-{run}")
    verdicts.write.mode("overwrite").json(own)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """The statistics as they are: cells and deltas, folded."""
    parts = spark.read.parquet(f"{path}/cells")
    if store.exists(spark, f"{path}/deltas"):
        parts = parts.unionByName(spark.read.schema(parts.schema).parquet(f"{path}/deltas").select(*parts.columns))
    return fold_cells(parts)


def compact_cells(spark: SparkSession, path: str, to: str) -> None:
    """Cells and deltas of path as cells in a new place."""
    parts = spark.read.parquet(f"{path}/cells")
    if store.exists(spark, f"{path}/deltas"):
        parts = parts.unionByName(spark.read.schema(parts.schema).parquet(f"{path}/deltas").select(*parts.columns))
    now = parts.groupBy("domain", "confidence_tier", "engine").agg(*[F.sum(c).cast("long").alias(c) for c in ("records", "confidence", "words", "chars")])
    now.filter("records <> 0").write.parquet(f"{to}/cells")


def append_progress(snapshots: DataFrame, path: str) -> None:
    snapshots.write.mode("append").json(path)


def last_progress(spark: SparkSession, path: str) -> DataFrame:
    return latest(spark.read.schema(PROGRESS_SCHEMA).option("mode", "DROPMALFORMED").json(path), ["doc_id"], "updated_at")


def write_page_rows(pages: DataFrame, path: str, documents: DataFrame | None = None, run: str | None = None) -> None:
    """Page rows of documents, which replace those that they had; a document without rows has none from then on. documents: the run's, if they aren't just those with rows.

    With a run they are appended under its name, in the order of which runs count, and fold_page_rows() puts them in their places; without one that is done at once.
    """
    ids = _documents(documents, pages)
    if run is None:
        fold_page_rows(pages.sparkSession, path)
        store.replace(pages, ids, path)
    else:
        store.append(pages, ids, path, run)


def read_page_rows(spark: SparkSession, path: str) -> DataFrame:
    """The page rows of the last run of each document."""
    return store.current(spark, path)


def fold_page_rows(spark: SparkSession, path: str) -> None:
    """Put appended runs in their places: what they supersede isn't read any more."""
    store.fold(spark, path)


def with_saved_images(pages: DataFrame, put: Callable[[str, int, bytes], str] | None) -> DataFrame:
    """pages with source_image_path: what put() says of each image, empty if it fails, or without put()."""
    if put is None:
        return pages.withColumn("source_image_path", F.lit(""))

    def safe(d: str, n: int, x: bytes) -> str:
        try:
            return put(d, int(n), bytes(x))
        except Exception:  # noqa: BLE001  a page without its picture is still a page
            return ""

    def run(batches):
        for b in batches:
            yield b.assign(source_image_path=[safe(*r) for r in zip(b["doc_id"], b["page_number"], b["image"])])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return pages.mapInPandas(run, f"{fields}, source_image_path string")


def save_images(pages: DataFrame, put: Callable[[str, int, bytes], str]) -> DataFrame:
    """doc_id, page_number, source_image_path."""
    own = pages.select("doc_id", F.col("page_number").cast("int").alias("page_number"), "image")
    return with_saved_images(own, put).select("doc_id", "page_number", "source_image_path")


