"""The report of a document, and of a page, as JSON of a fixed shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import documents as D
from .score import tier

#: Types of what pages may lack; a missing column counts as null.
_PAGE = {
    "method": "string", "engine": "string", "confidence_score": "double", "correction_applied": "boolean", "numeric_validation_passed": "boolean",
    "blocks": "array<struct<block_id:int,type:string,language:string,text:string,confidence:double,bbox:struct<x1:double,y1:double,x2:double,y2:double>,is_handwritten:boolean>>",
    "tables": "array<struct<table_id:int,structure_confidence:double,rows:array<array<string>>>>",
    "images": "array<struct<image_id:int,type:string,detected_text:string,description:string,confidence:double>>",
    "full_text": "string", "source_image_path": "string", "verified": "boolean", "domain": "string", "confidence_tier": "string", "decisions": "array<struct<page:int,keyword:string,detail:string,severity:string>>",
    "ms": "double",
}
_SUMMARY = "struct<total:bigint,by_severity:struct<info:bigint,warning:bigint,error:bigint>,unique_keywords:array<string>>"


def with_page_columns(pages: DataFrame) -> DataFrame:
    """pages with all columns that a report may need, null where they lack them."""
    return pages.withColumns({k: F.lit(None).cast(v) for k, v in _PAGE.items() if k not in pages.columns})


def _some(array: str) -> Column:
    return F.coalesce(array, F.array().cast(_PAGE[array]))


def page_report() -> Column:
    """A page's columns (with_page_columns()) as a struct: numbers to 4 places, a block's box as four numbers if it has one, is_handwritten only where it is so."""
    four = lambda x: T.rounded(F.coalesce(x, F.lit(0.0)))
    box = lambda b: F.when(b.isNotNull(), F.array(*[b[k] for k in ("x1", "y1", "x2", "y2")]))
    block = lambda b: F.struct(
        b["block_id"].alias("block_id"), b["type"].alias("type"), b["language"].alias("language"), F.coalesce(b["text"], F.lit("")).alias("text"), four(b["confidence"]).alias("confidence"),
        box(b["bbox"]).alias("bbox"), F.when(b["is_handwritten"], F.lit(True)).alias("is_handwritten"),
    )
    grid = lambda t: F.struct(t["table_id"].alias("table_id"), four(t["structure_confidence"]).alias("structure_confidence"), t["rows"].alias("rows"))
    extraction = F.struct(
        "method", "engine", four(F.col("confidence_score")).alias("confidence_score"), F.coalesce("correction_applied", F.lit(False)).alias("correction_applied"),
        F.coalesce("numeric_validation_passed", F.lit(True)).alias("numeric_validation_passed"),
    )
    verified = F.coalesce("verified", F.lit(False))
    return F.struct(
        F.col("page_number").cast("int").alias("page_number"), extraction.alias("extraction"), F.transform(_some("blocks"), block).alias("content_blocks"), F.transform(_some("tables"), grid).alias("tables"),
        F.transform(_some("images"), lambda i: i.withField("confidence", four(i["confidence"]))).alias("images"), F.coalesce("full_text", F.lit("")).alias("full_text"),
        F.coalesce("source_image_path", F.lit("")).alias("source_image_path"), verified.alias("verified"), F.coalesce("domain", F.lit("unknown")).alias("domain"),
        tier(F.coalesce("confidence_score", F.lit(0.0)), verified, F.col("confidence_tier")).alias("confidence_tier"), _some("decisions").alias("decisions"),
    )


def page_reports(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, json of each page."""
    own = with_page_columns(pages)
    return own.select("doc_id", "page_number", F.to_json(page_report()).alias("json"))


def document_facts(pages: DataFrame) -> DataFrame:
    """What a report says of a document beside its pages, of all its pages: doc_id, language_detected, has_handwriting, has_tables, has_images, pages, pages_processed_locally, pages_sent_to_api,
    overall_confidence, processing_time_ms, output_engine_tag, decision_summary. One aggregate of numbers, short lists, the keywords of decisions and the pages' confidences, whose mean is a sum in page order; no text and no list of decisions is gathered."""
    own = with_page_columns(pages)
    spoken = lambda *x: F.coalesce(F.bool_or(F.exists("blocks", lambda b: b["language"].isin(*x))), F.lit(False))
    any_ = lambda x: F.coalesce(F.bool_or(x), F.lit(False))
    e = F.coalesce("engine", F.lit(""))
    tags = F.collect_set(T.server_engine_tag("engine"))
    said = lambda s: F.size(F.filter(_some("decisions"), lambda d: F.coalesce(d["severity"], F.lit("info")) == s))
    facts = own.groupBy("doc_id").agg(
        spoken("bn", "mixed").alias("bn"), spoken("en", "mixed").alias("en"), any_(F.exists("blocks", lambda b: b["is_handwritten"])).alias("has_handwriting"),
        any_(F.size("tables") > 0).alias("has_tables"), any_(F.size("images") > 0).alias("has_images"), F.count("*").alias("pages"),
        F.count_if(e.isin(*D.LOCAL_ENGINES)).alias("pages_processed_locally"), F.count_if(e.startswith("ollama") | (e == "gemini")).alias("pages_sent_to_api"),
        F.coalesce(D.mean_in_order("confidence_score", "page_number"), F.lit(0.0)).alias("overall_confidence"), F.coalesce(F.sum("ms"), F.lit(0.0)).alias("processing_time_ms"),
        F.when(F.size(tags) > 1, "mixed").otherwise(F.get(tags, F.lit(0))).alias("output_engine_tag"),
        F.sum(F.size(_some("decisions"))).alias("total"), *[F.sum(said(s)).alias(s) for s in ("info", "warning", "error")],
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_distinct(F.transform(_some("decisions"), lambda d: d["keyword"])))))).alias("keywords"),
    )
    spoken_ = F.array_compact(F.array(F.when(F.col("bn"), "bn"), F.when(F.col("en"), "en")))
    summary = F.struct("total", F.struct("info", "warning", "error").alias("by_severity"), F.col("keywords").alias("unique_keywords"))
    return facts.select(
        "doc_id", F.when(F.size(spoken_) == 0, F.array(F.lit("unknown"))).otherwise(spoken_).alias("language_detected"), "has_handwriting", "has_tables", "has_images", "pages", "pages_processed_locally",
        "pages_sent_to_api", T.rounded(F.col("overall_confidence")).alias("overall_confidence"), T.rounded(F.col("processing_time_ms"), 2).alias("processing_time_ms"), "output_engine_tag", summary.alias("decision_summary"),
    )


def document_reports(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, output_engine_tag, json of each document: the document, with its decisions in the order of pages, and its pages in order. documents: doc_id; source or filename, and total_pages, where there are any.

    A document without pages has empty lists and zeros. A report holds all of its document, so a row is as large as that.
    """
    own = with_page_columns(pages)
    gathered = own.groupBy(F.col("doc_id").alias("_d")).agg(F.array_sort(F.collect_list(F.struct(F.col("page_number").cast("int").alias("n"), page_report().alias("page")))).alias("_own"))
    facts = document_facts(pages).withColumnRenamed("doc_id", "_f").withColumnRenamed("pages", "_n")
    joined = documents.join(gathered, F.col("doc_id") == F.col("_d"), "left").join(facts, F.col("doc_id") == F.col("_f"), "left")
    named = F.coalesce(*[F.col(c) for c in ("source", "filename") if c in documents.columns], F.col("doc_id"))
    total = F.coalesce(*[F.nullif(F.col(c).cast("long"), F.lit(0).cast("long")) for c in ("total_pages",) if c in documents.columns], F.col("_n"), F.lit(0).cast("long"))
    or_ = lambda c, default: F.coalesce(F.col(c), default).alias(c)
    zero, none = F.lit(0).cast("long"), F.array().cast("array<string>")
    summary = F.struct(or_("pages_processed_locally", zero), or_("pages_sent_to_api", zero), or_("overall_confidence", F.lit(0.0)), or_("processing_time_ms", F.lit(0.0)))
    empty = F.struct(zero.alias("total"), F.struct(*[zero.alias(s) for s in ("info", "warning", "error")]).alias("by_severity"), none.alias("unique_keywords")).cast(_SUMMARY)
    shown = F.transform(F.coalesce("_own", F.array().cast(joined.schema["_own"].dataType)), lambda x: x["page"])
    document = F.struct(
        named.alias("source"), total.alias("total_pages"), or_("language_detected", F.array(F.lit("unknown"))), *[or_(c, F.lit(False)) for c in ("has_handwriting", "has_tables", "has_images")],
        summary.alias("processing_summary"), F.coalesce(F.col("decision_summary").cast(_SUMMARY), empty).alias("decision_summary"), F.flatten(F.transform(shown, lambda x: x["decisions"])).alias("all_decisions"),
        "output_engine_tag",
    )
    return joined.select("doc_id", "output_engine_tag", F.to_json(F.struct(document.alias("document"), shown.alias("pages"))).alias("json"))
