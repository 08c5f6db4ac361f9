"""Documents, jobs and their states. States are event logs; the current one is the last event, so a change is an append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_stem, normalise_email
from .corpus import latest

ACTIVE = ("pending", "processing")


def job_status(jobs: DataFrame, documents: DataFrame, job_id: Column | str | None = None, user_id: Column | str | None = None) -> DataFrame:
    """Jobs with their documents; optionally one job of one user."""
    j = jobs.select(F.col("id").alias("job_id"), "document_id", "status", "error_msg", "started_at", "completed_at")
    d = documents.select(F.col("id").alias("_doc"), "user_id", F.struct("id", "doc_id", "filename", "status", "total_pages").alias("document"))
    out = j.join(d, F.col("document_id") == F.col("_doc"))
    out = out if job_id is None else out.filter(F.col("job_id") == job_id)
    out = out if user_id is None else out.filter(F.col("user_id") == user_id)
    return out.select("job_id", "user_id", "status", "error_msg", "started_at", "completed_at", "document")


def progress_percent(status: Column, current: Column, total: Column) -> Column:
    """100 if done, else the share of pages between 0 and 100, halves to the even number; 0 without a total."""
    return F.when(status == "done", 100).when(total > 0, F.least(F.lit(100), F.greatest(F.lit(0), F.bround(current / total * 100).cast("int")))).otherwise(0)


def list_documents(documents: DataFrame, progress: DataFrame, user_id: Column | str | None = None) -> DataFrame:
    """Documents with the last progress of each, newest first. Sorting is the listing's order; without a user it sorts all documents."""
    own = documents if user_id is None else documents.filter(F.col("user_id") == user_id)
    p = latest(progress, ["doc_id"], "updated_at").select(F.col("doc_id").alias("_d"), "current_page", F.col("total_pages").alias("_total"), F.col("status").alias("_status"))
    joined = own.join(p, F.col("doc_id") == F.col("_d"), "left")
    percent = F.coalesce(progress_percent(F.col("status"), F.coalesce("current_page", F.lit(0)), F.coalesce("_total", F.lit(0))), F.lit(0))
    state = F.when(F.col("status") == "done", "done").otherwise(F.col("_status"))
    columns = ["id", "doc_id", "filename", "status", "domain", "total_pages"]
    return joined.select(*columns, percent.alias("progress_percent"), state.alias("progress_status"), "created_at").orderBy(F.desc("created_at"), "id")


def current_state(events: DataFrame, key: str = "id", at: str = "at") -> DataFrame:
    return latest(events, [key], at)


def transition(current: DataFrame, to: str, allowed: tuple[str, ...], at: Column, message: Column | None = None, key: str = "id") -> DataFrame:
    """Events that move what is in an allowed state to another: key, status, error_msg, at."""
    return current.filter(F.col("status").isin(*allowed)).select(key, F.lit(to).alias("status"), (message if message is not None else F.lit(None).cast("string")).alias("error_msg"), at.alias("at"))


def cancel(current: DataFrame, at: Column, key: str = "id") -> DataFrame:
    """Events that end active jobs; none if none is active."""
    return transition(current, "failed", ACTIVE, at, F.lit("Canceled by user"), key)


def delete_documents(tables: dict[str, tuple[DataFrame, str] | tuple[DataFrame, str, str]], gone: DataFrame, key: str = "id") -> dict[str, DataFrame]:
    """Each table (frame, name of the column with the document, and of the column of gone that it matches: key if it isn't given) without the rows of the documents in gone."""

    def left(df: DataFrame, on: str, of: str = key) -> DataFrame:
        return df.join(gone.select(F.col(of).alias("_gone")).distinct(), df[on] == F.col("_gone"), "left_anti")

    return {name: left(*given) for name, given in tables.items()}


def submissions(files: DataFrame, domain: str = "unknown", at: Column | None = None) -> DataFrame:
    """A document and a job for each file (user_id, filename) that is admitted by name: id, user_id, filename, doc_id, status, domain, total_pages, created_at and
    job_id. A file that has a doc_id already keeps it. Ids are random, so the rows are written to the shared folder and read from there: documents() and jobs() of them agree."""
    from ..sources.scratch import written

    given = ["doc_id"] if "doc_id" in files.columns else []
    fresh = files.filter(F.lower("filename").endswith(".pdf")).select("user_id", "filename", *given, F.expr("uuid()").alias("id"), F.expr("uuid()").alias("job_id"), F.expr("uuid()").alias("_u"))
    unique = F.concat(F.replace("_u", F.lit("-"), F.lit("")), F.lit("_"), "filename")
    out = fresh.select(
        "id", "user_id", "filename", *(given or [file_stem(unique).alias("doc_id")]), F.lit("pending").alias("status"), F.lit(domain).alias("domain"), F.lit(0).alias("total_pages"),
        (F.current_timestamp() if at is None else at).alias("created_at"), "job_id",
    )
    return written(out, "submissions")


def documents(submitted: DataFrame) -> DataFrame:
    return submitted.drop("job_id")


def jobs(submitted: DataFrame) -> DataFrame:
    none = F.lit(None)
    return submitted.select(
        F.col("job_id").alias("id"), F.col("id").alias("document_id"), none.cast("string").alias("celery_task_id"), F.lit("pending").alias("status"), none.cast("string").alias("error_msg"),
        none.cast("timestamp").alias("started_at"), none.cast("timestamp").alias("completed_at"),
    )


def outcomes(pages: DataFrame) -> DataFrame:
    """doc_id, status (done or failed), total_pages, error_msg of documents whose decoded pages (error null if all is well) these are."""
    failed = F.max(F.when(F.col("error").isNotNull(), F.col("error")))
    return pages.groupBy("doc_id").agg(
        F.when(failed.isNotNull(), "failed").otherwise("done").alias("status"), F.count_if(F.col("error").isNull()).cast("int").alias("total_pages"), failed.alias("error_msg")
    )


def file_counts(files: DataFrame) -> DataFrame:
    """selected and total: how many of the files are selected, and how many there are."""
    return files.agg(F.count_if(F.coalesce("selected", F.lit(False))).alias("selected"), F.count("*").alias("total"))


def replace_pages(pages: DataFrame, fresh: DataFrame, key: str = "doc_id", documents: DataFrame | None = None) -> DataFrame:
    """pages with all rows of a run's documents replaced by fresh: idempotent. documents: the run's, with or without rows; without it those of fresh."""
    ids = (fresh if documents is None else documents).select(F.col(key).alias("_fresh")).distinct()
    return pages.join(ids, pages[key] == F.col("_fresh"), "left_anti").unionByName(fresh)


def new_users(users: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of asked whose e-mail, in lower case and stripped, no user has; the first row of each by id."""
    asked = asked.withColumn("email", normalise_email("email"))
    taken = users.select(normalise_email("email").alias("_taken")).distinct()
    fresh = asked.join(taken, F.col("email") == F.col("_taken"), "left_anti")
    return fresh.groupBy("email").agg(F.min_by(F.struct(*fresh.columns), "id").alias("r")).select("r.*")


def distinct_files(files: DataFrame) -> DataFrame:
    """Files by name, size and time of change, each once; only PDF files are admitted."""
    pdf = (F.col("mime") == "application/pdf") | F.lower("name").endswith(".pdf")
    return files.filter(pdf).dropDuplicates(["name", "size", "modified"])


def user_overview(documents: DataFrame, jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """user_id, documents, jobs, active, pages. jobs and pages (document_id) are counted by document before they meet documents, so a join carries a row a document."""
    j = jobs.groupBy(F.col("document_id").alias("_j")).agg(F.count("*").alias("jobs"), F.count_if(F.col("status").isin(*ACTIVE)).alias("active"))
    p = pages.groupBy(F.col("document_id").alias("_p")).agg(F.count("*").alias("pages"))
    joined = documents.select("id", "user_id").join(j, F.col("id") == F.col("_j"), "left").join(p, F.col("id") == F.col("_p"), "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return joined.groupBy("user_id").agg(F.count("*").alias("documents"), total("jobs"), total("active"), total("pages"))
