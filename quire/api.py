"""What the service's routes and command line do, as functions over tables."""

from __future__ import annotations

import argparse
import importlib
import re
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import corpus, documents, jobs
from .operators.report import document_reports
from .plans.cascade import Engines, process_pages
from .sources import files, sinks
from .sources import store as replaced
from .sources.scratch import written

DOMAINS = ("unknown", "newspaper", "govt", "academic", "general")


class NotFound(LookupError):
    """There is no such page, job or document."""


class Conflict(ValueError):
    """The state doesn't allow it."""


@dataclass
class Tables:
    """The engine's tables: documents, jobs (current state), pages (by doc_id), progress, verifications; chunks and chat_sessions where there are any. A user is a filter of documents."""

    documents: DataFrame
    jobs: DataFrame
    pages: DataFrame
    progress: DataFrame
    verifications: DataFrame
    chunks: DataFrame | None = None
    chat_sessions: DataFrame | None = None
    users: DataFrame | None = None
    calls: DataFrame | None = None


@dataclass
class Store:
    """Where page JSON, verifications, corpus and statistics are, and exported files (page files, images, merged documents, texts, uploads). cells: statistics that follow verdicts without a rebuild; page_rows,
    merged and texts: the tables of sinks, where there are any."""

    pages: str
    verifications: str
    corpus: str
    stats: str
    exports: str | None = None
    cells: str | None = None
    page_rows: str | None = None
    merged: str | None = None
    texts: str | None = None


def store_of(settings: files.Settings) -> Store:
    """The store under the settings' data folder."""
    at, own = settings.data_dir.rstrip("/"), settings.folders()
    return Store(own["pages"], f"{at}/verifications", f"{at}/corpus", f"{at}/corpus_stats", at, f"{at}/corpus_cells", f"{at}/page_rows", own["merged"], own["texts"])


def submit(spark: SparkSession, path: str, decoder, engines: Engines, domain: str = "unknown", user_id: str = "", log: str | None = None, dpi: int | None = None) -> dict[str, DataFrame]:
    """All documents under a path, processed: documents and jobs in their last state, events (id of the job, status, error_msg, at) that led there, and pages. log: a folder that the events are
    appended to as they happen, for whoever asks in between (jobs.current_state())."""
    found = files.read_documents(spark, path)
    named = found.select(F.lit(user_id).alias("user_id"), F.concat("doc_id", F.lit(".pdf")).alias("filename"), "doc_id")
    made = jobs.submissions(named, domain)

    def say(events: DataFrame) -> DataFrame:
        events = written(events.select("id", "status", "error_msg", "at"), "job-events")
        if log is not None:
            events.write.mode("append").parquet(log)
        return events

    none = F.lit(None).cast("string").alias("error_msg")
    submitted = say(jobs.jobs(made).select("id", "status", none, F.current_timestamp().alias("at")))
    started = say(jobs.transition(submitted, "processing", ("pending",), F.current_timestamp()))
    decoded = written(files.decode_pages(found, decoder, dpi), "decoded")
    end = written(jobs.outcomes(decoded), "outcomes").withColumnsRenamed({"doc_id": "_doc", "status": "_status", "total_pages": "_pages", "error_msg": "_error"})
    ended = made.join(end, F.col("doc_id") == F.col("_doc"), "left").select(F.col("job_id").alias("_job"), F.coalesce("_status", F.lit("failed")).alias("_to"), F.when(F.col("_doc").isNull(), "no pages").otherwise(F.col("_error")).alias("_why"))
    allowed = jobs.transition(started, "done", ("processing",), F.current_timestamp()).join(ended, F.col("id") == F.col("_job"))
    finished = say(allowed.select("id", F.col("_to").alias("status"), F.col("_why").alias("error_msg"), "at"))
    events = submitted.unionByName(started).unionByName(finished)
    state = jobs.current_state(events).select(F.col("id").alias("_j"), "status", "error_msg", F.col("at").alias("completed_at"))
    begun = started.select(F.col("id").alias("_s"), F.col("at").alias("started_at"))
    last = jobs.jobs(made).select("id", "document_id").join(state, F.col("id") == F.col("_j")).join(begun, F.col("id") == F.col("_s")).select("id", "document_id", "status", "error_msg", "started_at", "completed_at")
    known = last.select(F.col("document_id").alias("_i"), F.col("status").alias("_now"))
    own = made.join(known, F.col("id") == F.col("_i")).join(end, F.col("doc_id") == F.col("_doc"), "left")
    own = own.select("id", "user_id", "filename", "doc_id", F.col("_now").alias("status"), "domain", F.coalesce("_pages", F.lit(0)).alias("total_pages"), "created_at")
    return {"documents": own, "jobs": last, "events": events, "pages": process_pages(decoded.filter("error is null").drop("error"), engines, domain)}


def job(t: Tables, job_id: str, user_id: str) -> DataFrame:
    out = jobs.job_status(t.jobs, t.documents, job_id, user_id)
    if out.isEmpty():
        raise NotFound(job_id)
    return out


def list_documents(t: Tables, user_id: str) -> DataFrame:
    return jobs.list_documents(t.documents, t.progress, user_id)


def cancel(t: Tables, doc_id: str, user_id: str) -> DataFrame:
    """The events that end the document's active jobs."""
    own = t.documents.filter((F.col("doc_id") == doc_id) & (F.col("user_id") == user_id)).select(F.col("id").alias("_d"))
    if own.isEmpty():
        raise NotFound(doc_id)
    out = jobs.cancel(t.jobs.join(own, F.col("document_id") == F.col("_d"), "left_semi"), F.current_timestamp())
    if out.isEmpty():
        raise Conflict("no active job")
    return out


def delete(t: Tables, doc_id: str, user_id: str, store: Store | None = None) -> dict[str, DataFrame]:
    """Each table without the document's rows; with a store, it leaves page JSON, page rows, reports and texts, corpus and statistics, and its exported files go as well."""
    gone = t.documents.filter((F.col("doc_id") == doc_id) & (F.col("user_id") == user_id)).select("id", "doc_id")
    if gone.isEmpty():
        raise NotFound(doc_id)
    tables = {"documents": (t.documents, "id"), "jobs": (t.jobs, "document_id"), "chunks": (t.chunks, "document_id"), "chat_sessions": (t.chat_sessions, "document_id")}
    by_name = {"pages": (t.pages, "doc_id", "doc_id"), "progress": (t.progress, "doc_id", "doc_id"), "verifications": (t.verifications, "doc_id", "doc_id")}
    out = jobs.delete_documents({k: v for k, v in (tables | by_name).items() if v[0] is not None}, gone)
    if store is not None:
        spark, ids = t.documents.sparkSession, gone.select("doc_id")
        for path, form in ((store.pages, "json"), (store.merged, "json"), (store.texts, "json"), (store.page_rows, "parquet")):
            if path:
                replaced.remove(ids, path, form=form)
        if store.corpus and replaced.exists(spark, store.corpus):  # what is left of the pages makes corpus and statistics anew
            sinks.rebuild_corpus(spark, store.pages, store.corpus, store.stats, store.verifications if replaced.exists(spark, store.verifications) else None, store.cells)
        if store.exports:
            plain = re.sub(r"([\[\]{}*?\\])", r"\\\1", doc_id)  # no wildcard
            sinks.delete_files(spark, *[f"{store.exports}/{kind}/{plain}{end}" for kind in ("pages", "images", "merged", "texts", "uploads") for end in ("", "_*.json", ".json", "_*.txt", ".txt", ".pdf")])
    return out


def report(t: Tables, doc_id: str, user_id: str | None = None) -> DataFrame:
    """doc_id, output_engine_tag and json (operators/report.py) of one document. NotFound without it or its pages, Conflict while it is being processed."""
    own = t.documents.filter(F.col("doc_id") == doc_id)
    own = own if user_id is None else own.filter(F.col("user_id") == user_id)
    state = own.select("status").first()
    if state is None:
        raise NotFound(doc_id)
    pages = t.pages.filter(F.col("doc_id") == doc_id)
    if pages.isEmpty():
        if state[0] in jobs.ACTIVE:
            raise Conflict("the report isn't ready yet")
        raise NotFound(f"{doc_id} has no pages")
    return document_reports(own, pages)


def stats(t: Tables, store: Store | None = None) -> DataFrame:
    """Of a store's cells, if it has them. Else texts are measured before the join with verifications, which then carries a few numbers a page."""
    if store is not None and store.cells is not None:
        return sinks.read_stats(t.pages.sparkSession, store.cells)
    return corpus.corpus_stats(corpus.corpus_records(corpus.verify(corpus.measured(t.pages).drop("full_text"), t.verifications)))


def export(t: Tables, path: str) -> None:
    sinks.write_corpus(corpus.verify(t.pages, t.verifications), path)


def verify(t: Tables, doc_id: str, page_number: int, verified: bool = True, store: Store | None = None, rebuild: bool = True) -> DataFrame:
    """The verification of a page that there is, as a row. With a store it is appended there, and corpus and statistics are rebuilt; or, without rebuild, left for a later one: the statistics of cells follow at once."""
    spark = t.pages.sparkSession
    if files.find_page(t.pages, doc_id, page_number).isEmpty():
        raise NotFound(f"{doc_id}, page {page_number}")
    row = spark.createDataFrame([(doc_id, page_number, verified, datetime.now(timezone.utc))], files.VERIFICATION_SCHEMA)
    if store is not None and store.cells is not None and not rebuild:
        sinks.append_verdicts(spark.read.parquet(store.corpus), row, store.verifications, store.cells, uuid.uuid4().hex)
    elif store is not None:
        row.write.mode("append").json(store.verifications)
    if store is not None and rebuild:
        sinks.rebuild_corpus(spark, store.pages, store.corpus, store.stats, store.verifications, store.cells)
    return row


def register(t: Tables, email: str, role: str = "user") -> DataFrame:
    """The row of a new user; Conflict if the e-mail is taken."""
    spark = t.users.sparkSession
    asked = spark.createDataFrame([(email, str(uuid.uuid4()), role, True)], "email string, id string, role string, is_active boolean").withColumn("created_at", F.current_timestamp())
    out = jobs.new_users(t.users, asked)
    if out.isEmpty():
        raise Conflict("email already registered")
    return out


def call_stats(t: Tables) -> DataFrame:
    """Calls, tokens and errors by engine."""
    return documents.call_stats(t.calls)


def health(spark: SparkSession) -> dict[str, str]:
    return {"status": "ok", "spark": spark.version}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("quire", description="Process PDF files to a corpus. The decoder and engines are given as module:function.")
    out.add_argument("path")
    out.add_argument("output", nargs="?", help="the corpus; without it, corpus under the settings' data folder")
    out.add_argument("--domain", default="general")
    out.add_argument("--decoder", required=True)
    out.add_argument("--engines", help="a function without arguments that gives the Engines; without it scanned pages stay unread")
    out.add_argument("--env", help="a file of settings (NAME=value); the environment overrides it")
    out.add_argument("--dpi", action="store_true", help="the decoder takes the settings' resolution as dpi")
    out.add_argument("--verbose", action="store_true")
    return out


def _named(name: str):
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("quire").getOrCreate()
    text = "\n".join(r[0] for r in spark.read.text(a.env).collect()) if a.env else ""
    settings = files.Settings.load(env_text=text)
    spark.sparkContext.setLogLevel("INFO" if a.verbose else settings.log_level if a.env else "WARN")
    engines = _named(a.engines)() if a.engines else Engines()
    engines.settings = engines.settings or settings
    found = submit(spark, a.path, _named(a.decoder), engines, a.domain, dpi=settings.dpi if a.dpi else None)
    pages = written(found["pages"], "pages")
    sinks.write_corpus(pages, a.output or store_of(settings).corpus)
    for status, error, n in found["jobs"].groupBy("status", "error_msg").count().orderBy("status", "error_msg").limit(20).collect():
        print(f"{status}: {n} documents" + (f" ({error})" if error else ""))
    for engine, n, mean in pages.groupBy("engine").agg(F.count("*"), F.avg("confidence_score")).orderBy("engine").limit(20).collect():
        print(f"  {engine}: {n} pages, confidence {mean:.3f}")


if __name__ == "__main__":
    main()
