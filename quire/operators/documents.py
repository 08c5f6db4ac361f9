"""Rollups of pages to documents, and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Engines of this machine, and names of models that see images.
VISION_KEYWORDS = ("llava", "bakllava", "moondream", "minicpm", "qwen", "llama3.2-vision")
LOCAL_ENGINES = ("surya", "easyocr", "PyMuPDF")


def mean_in_order(value: str, order: str | None = None) -> Column:
    """Mean of a group's values as a sum in an order (of the values themselves without one): a mean that is rounded at a tie mustn't hang on how tasks cut a group. Null without values.

    A group's numbers are gathered, some 20 bytes a page."""
    has = F.col(value).isNotNull()
    own = F.collect_list(F.when(has, F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate([order] if order else [])], F.col(value).cast("double").alias("v"))))
    return F.aggregate(F.array_sort(own), F.lit(0.0), lambda s, x: s + x["v"]) / F.nullif(F.count(value), F.lit(0).cast("long"))


def document_rollup(pages: DataFrame) -> DataFrame:
    """doc_id, pages, mean_confidence, pages_local, pages_api, output_engine_tag (mixed for several). The mean is a sum in the order of page_number, if pages has it."""
    e = F.coalesce("engine", F.lit(""))
    tags = F.collect_set(T.server_engine_tag("engine"))
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("pages"),
        F.coalesce(mean_in_order("confidence_score", "page_number" if "page_number" in pages.columns else None), F.lit(0.0)).alias("mean_confidence"),
        F.count_if(e.isin(*LOCAL_ENGINES)).alias("pages_local"),
        F.count_if(e.startswith("ollama") | (e == "gemini")).alias("pages_api"),
        F.when(F.size(tags) > 1, "mixed").otherwise(F.get(tags, F.lit(0))).alias("output_engine_tag"),
    )


def languages(blocks: DataFrame) -> DataFrame:
    """doc_id, languages: bn and en by any block that has them, sorted; unknown without either. blocks: doc_id, language."""
    has = lambda *x: F.coalesce(F.bool_or(F.col("language").isin(*x)), F.lit(False))
    found = blocks.groupBy("doc_id").agg(has("bn", "mixed").alias("bn"), has("en", "mixed").alias("en"))
    out = F.array_compact(F.array(F.when(F.col("bn"), "bn"), F.when(F.col("en"), "en")))
    return found.select("doc_id", F.when(F.size(out) == 0, F.array(F.lit("unknown"))).otherwise(out).alias("languages"))


def flags(pages: DataFrame) -> DataFrame:
    """doc_id, has_handwriting, has_tables, has_images. pages: blocks, tables, images."""
    return pages.groupBy("doc_id").agg(
        F.coalesce(F.bool_or(F.exists("blocks", lambda b: b["is_handwritten"])), F.lit(False)).alias("has_handwriting"),
        F.coalesce(F.bool_or(F.size("tables") > 0), F.lit(False)).alias("has_tables"),
        F.coalesce(F.bool_or(F.size("images") > 0), F.lit(False)).alias("has_images"),
    )


def decision_summary(decisions: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, total_decisions, info, warning, error, keywords (sorted, each once). A missing severity is info."""
    s = F.coalesce("severity", F.lit("info"))
    return decisions.groupBy(key).agg(
        F.count("*").alias("total_decisions"), *[F.count_if(s == x).alias(x) for x in ("info", "warning", "error")], F.sort_array(F.collect_set("keyword")).alias("keywords")
    )


def page_decisions(page: str = "page_number", method: str = "method", engine: str = "engine", steps: str = "steps"):
    """Decisions of a page: the engine that won, then one for each logged step."""
    made = lambda keyword, detail: F.struct(F.col(page).cast("int").alias("page"), F.lit(keyword).alias("keyword"), detail.alias("detail"), F.lit("info").alias("severity"))
    final = made("FINAL_ENGINE", F.concat(F.lit("method="), F.col(method), F.lit(" engine="), F.col(engine)))
    return F.concat(F.array(final), F.transform(steps, lambda s: made("STEP", s)))


def coverage(documents: DataFrame, pages: DataFrame, index_pages: int = 120) -> DataFrame:
    """doc_id, expected_pages, present, missing (sorted), status, page_index. Expected: total_pages if it is positive, else the number of pages.

    page_index lists the pages of documents of up to index_pages pages.
    """
    seen = pages.groupBy(F.col("doc_id").alias("_d")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.when(F.col("page_number") > 0, F.col("page_number").cast("int")))).alias("present"))
    joined = documents.select("doc_id", "total_pages").join(seen, F.col("doc_id") == F.col("_d"), "left")
    expected = F.when(F.col("total_pages") > 0, F.col("total_pages")).otherwise(F.coalesce("n", F.lit(0))).cast("int")
    all_ = F.when(F.col("expected_pages") > 0, F.sequence(F.lit(1), "expected_pages")).otherwise(F.array().cast("array<int>"))
    out = joined.withColumns({"expected_pages": expected, "present": F.coalesce("present", F.array().cast("array<int>"))})
    out = out.withColumn("missing", F.array_except(all_, F.col("present")))
    status = F.when(F.size("missing") > 0, F.concat(F.lit("Missing "), F.size("missing").cast("string"))).otherwise("Complete")
    return out.select("doc_id", "expected_pages", "present", "missing", status.alias("status"), F.when(F.col("expected_pages") <= index_pages, all_).alias("page_index"))


def missing_pages(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_number: expected pages that there are no rows of, by an anti join."""
    expected = documents.filter("total_pages > 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("total_pages").cast("int"))).alias("page_number"))
    have = pages.select(F.col("doc_id").alias("_d"), F.col("page_number").cast("int").alias("_p")).distinct()
    return expected.join(have, (F.col("doc_id") == F.col("_d")) & (F.col("page_number") == F.col("_p")), "left_anti")


def document_text(pages: DataFrame, between: str = "\n\n") -> DataFrame:
    """doc_id, text: the pages' texts in order of their numbers."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("page_number").cast("int").alias("page_number"), F.coalesce("full_text", F.lit("")).alias("full_text"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p["full_text"]), between).alias("text"))


def call_stats(calls: DataFrame) -> DataFrame:
    """engine, calls, tokens, errors of a log of calls; counted from the log, so a retried task counts once."""
    return calls.groupBy("engine").agg(F.count("*").alias("calls"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count_if(F.coalesce("failed", F.lit(False))).alias("errors"))


def missing_ranges(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, expected_pages, present, missing (counts of pages from 1 to expected_pages), ranges (first and last of each run of missing pages, in order): coverage() for documents of any number of pages.

    Runs are the gaps between neighbours, of which a document has as many as it has pages at most; no list of all expected pages is made. Expected: total_pages if it is positive, else the number of rows.
    """
    counted = pages.groupBy(F.col("doc_id").alias("_d")).agg(F.count("*").alias("_n"))
    expected = F.when(F.col("total_pages") > 0, F.col("total_pages")).otherwise(F.coalesce("_n", F.lit(0))).cast("long")
    due = documents.select("doc_id", "total_pages").join(counted, F.col("doc_id") == F.col("_d"), "left").select("doc_id", expected.alias("expected_pages"))
    have = pages.select(F.col("doc_id").alias("_d"), F.col("page_number").cast("long").alias("p")).filter("p > 0").distinct()
    met = due.join(have, F.col("doc_id") == F.col("_d")).filter("p <= expected_pages").select("doc_id", "expected_pages", "p")
    closed = met.unionByName(due.select("doc_id", "expected_pages", (F.col("expected_pages") + 1).alias("p")))  # what follows the last page
    before = F.coalesce(F.lag("p").over(Window.partitionBy("doc_id").orderBy("p")), F.lit(0))
    gap = F.when(F.col("p") - F.col("before") > 1, F.struct((F.col("before") + 1).alias("first"), (F.col("p") - 1).alias("last")))
    out = closed.withColumn("before", before).groupBy("doc_id", "expected_pages").agg((F.count("*") - 1).alias("present"), F.array_sort(F.collect_list(gap)).alias("ranges"))
    return out.select("doc_id", "expected_pages", "present", (F.col("expected_pages") - F.col("present")).alias("missing"), "ranges")


def by_prefix(names: DataFrame, prefixes: DataFrame, name: str = "name", prefix: str = "prefix") -> DataFrame:
    """names joined with all prefixes that theirs begin with, as an equi join: each name gives its beginnings of the lengths that prefixes have, of which there are few. An empty prefix is every name's."""
    lengths = sorted(r[0] for r in prefixes.select(F.length(prefix)).filter(F.col(prefix).isNotNull()).distinct().collect())
    starts = F.array(*[F.when(F.length(name) >= n, F.substring(name, 1, n)) for n in lengths]).cast("array<string>")
    each = names.withColumn("_start", F.explode(F.array_compact(starts)))
    return each.join(prefixes, F.col("_start") == F.col(prefix)).drop("_start")


def pick_model(models: DataFrame, priority: DataFrame, keywords: tuple[str, ...] = VISION_KEYWORDS) -> DataFrame:
    """name: the vision model of the best priority, else the first one. models: pos, name; priority: rank, expected. A model has the priority of a family that its name begins with; one that is expected by its
    whole name is of that family too."""
    vision = models.filter(F.lower("name").rlike("|".join(k.replace(".", r"\.") for k in keywords)))
    families = priority.select("rank", F.split_part("expected", F.lit(":"), F.lit(1)).alias("family")).groupBy("family").agg(F.min("rank").alias("rank"))
    met = by_prefix(vision.select("pos", "name"), families, prefix="family").select("pos", "name", "rank")
    every = met.unionByName(vision.select("pos", "name", F.lit(None).cast(met.schema["rank"].dataType).alias("rank")))
    return every.agg(F.min_by("name", F.struct(F.col("rank").isNull(), "rank", "pos")).alias("name"))
