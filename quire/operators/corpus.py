"""The corpus table and its statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .score import tier


def latest(log: DataFrame, keys: list[str], by: str | Column) -> DataFrame:
    """The last row of each key: partial maxima per task, so a key with many rows isn't gathered."""
    rest = [c for c in log.columns if c not in keys]
    by = F.col(by) if isinstance(by, str) else by
    out = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_last"))
    return out.select(*keys, *[F.col("_last")[c].alias(c) for c in rest])


def measured(pages: DataFrame) -> DataFrame:
    """pages with word_count, char_count and language_ratio_bn of their full_text: what records and statistics need of it, so joins needn't carry it."""
    t = F.coalesce("full_text", F.lit(""))
    return pages.withColumns({"word_count": T.count_words(t), "char_count": F.length(t), "language_ratio_bn": T.rounded(T.bangla_share(t))})


def corpus_records(pages: DataFrame, given_tier: str | None = None) -> DataFrame:
    """One flat row per page: doc_id, page_number, full_text, source_image_path, engine, confidence_score, verified, domain, confidence_tier, language_ratio_bn,
    has_table, has_image, word_count, char_count. tables and images are arrays, or already flags has_table and has_image. Pages that are measured()
    already may come without full_text, and their records too."""
    pages = pages if "word_count" in pages.columns else measured(pages)
    flag = lambda array, name: F.col(name) if name in pages.columns else F.coalesce(F.size(array) > 0, F.lit(False)) if array in pages.columns else F.lit(False)
    opt = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in pages.columns else F.lit(default)
    given = F.col(given_tier) if given_tier else None
    text = [F.coalesce("full_text", F.lit("")).alias("full_text")] if "full_text" in pages.columns else []
    return pages.select(
        "doc_id", F.col("page_number").cast("int").alias("page_number"), *text, opt("source_image_path", "").alias("source_image_path"), "engine",
        T.rounded(F.col("confidence_score")).alias("confidence_score"), opt("verified", False).alias("verified"), opt("domain", "unknown").alias("domain"),
        tier(F.col("confidence_score"), opt("verified", False), given).alias("confidence_tier"), "language_ratio_bn",
        flag("tables", "has_table").alias("has_table"), flag("images", "has_image").alias("has_image"), "word_count", "char_count",
    )


def corpus_counts(records: DataFrame) -> DataFrame:
    """kind (domain, tier, engine, total), name, records, confidence, words, chars: one pass with grouping sets."""
    grouped = records.select("domain", "confidence_tier", "engine", "confidence_score", "word_count", "char_count").groupingSets(
        [[F.col("domain")], [F.col("confidence_tier")], [F.col("engine")], []], "domain", "confidence_tier", "engine"
    )
    out = grouped.agg(
        F.grouping_id().alias("g"), F.count("*").alias("records"), F.sum("confidence_score").alias("confidence"), F.sum("word_count").alias("words"), F.sum("char_count").alias("chars")
    )
    kind = F.when(F.col("g") == 3, "domain").when(F.col("g") == 5, "tier").when(F.col("g") == 6, "engine").otherwise("total")
    return out.select(kind.alias("kind"), F.coalesce("domain", "confidence_tier", "engine").alias("name"), "records", "confidence", "words", "chars")


def corpus_stats(records: DataFrame) -> DataFrame:
    """One row: total_records, by_domain, by_tier, by_engine (maps of counts), avg_confidence, total_words, total_chars. Zeros and empty maps for an empty table."""
    counts = corpus_counts(records)
    entry = lambda kind: F.map_from_entries(F.sort_array(F.collect_list(F.when((F.col("kind") == kind) & F.col("name").isNotNull(), F.struct("name", "records"))))).alias(f"by_{kind}")
    total = lambda c: F.coalesce(F.sum(F.when(F.col("kind") == "total", F.col(c))), F.lit(0))
    out = counts.agg(
        total("records").cast("long").alias("total_records"), entry("domain"), entry("tier"), entry("engine"),
        total("confidence").cast("double").alias("_c"), total("words").cast("long").alias("total_words"), total("chars").cast("long").alias("total_chars"),
    )
    return out.select("total_records", "by_domain", "by_tier", "by_engine", T.rounded(T.ratio(F.col("_c"), F.col("total_records"))).alias("avg_confidence"), "total_words", "total_chars")


def verify(pages: DataFrame, verifications: DataFrame, at: str | Column = "at") -> DataFrame:
    """pages with verified set to the last verification of a page; pages without one keep theirs, and no page is repeated.

    verifications: doc_id, page_number, verified and at, which orders them; of several at one time a positive one counts.
    """
    when = F.col(at) if isinstance(at, str) else at
    own = latest(verifications.select("doc_id", "page_number", "verified", when.alias("at")), ["doc_id", "page_number"], F.struct("at", "verified"))
    own = own.select(F.col("doc_id").alias("_d"), F.col("page_number").alias("_p"), F.col("verified").alias("_v"))
    was = F.col("verified") if "verified" in pages.columns else F.lit(False)
    joined = pages.join(own, (F.col("doc_id") == F.col("_d")) & (F.col("page_number") == F.col("_p")), "left")
    return joined.select(*[c for c in pages.columns if c != "verified"], F.coalesce("_v", was).alias("verified"))


def cells(records: DataFrame) -> DataFrame:
    """domain, confidence_tier, engine, records, confidence, words, chars: what statistics are made of, a row for each combination that occurs. confidence is a sum of ten-thousandths, so sums of cells are exact in any order."""
    score = F.round(F.col("confidence_score") * 10_000).cast("long")
    return records.groupBy("domain", "confidence_tier", "engine").agg(
        F.count("*").alias("records"), F.sum(score).alias("confidence"), F.sum("word_count").cast("long").alias("words"), F.sum("char_count").cast("long").alias("chars")
    )


def verdict_deltas(records: DataFrame, before: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Signed cells(): what verdicts change. records: of the corpus, with verified as it was built; before: verifications that count already; verdicts: those that come now.

    A page that is verified leaves the cell that it was in and enters another. Only the columns of records that cells are made of are read, and only pages with a verdict are looked at; of several
    verdicts on a page the last counts, and pages that aren't in records change nothing.
    """
    keys = ["doc_id", "page_number"]
    last = lambda v, name: latest(v.select(*keys, "verified", "at"), keys, F.struct("at", "verified")).select(F.col("doc_id").alias("_d"), F.col("page_number").alias("_p"), F.col("verified").alias(name), F.col("at").alias(f"{name}_at"))
    same = lambda: (F.col("doc_id") == F.col("_d")) & (F.col("page_number") == F.col("_p"))
    own = records.select(*keys, "domain", "engine", "confidence_score", "verified", "word_count", "char_count")
    met = own.join(last(verdicts, "_new"), same()).drop("_d", "_p").join(last(before, "_old"), same(), "left").drop("_d", "_p")
    was = F.coalesce("_old", "verified")
    # a verdict that is older than one that counts already comes too late
    late = F.col("_old_at").isNotNull() & (F.struct(F.col("_old_at"), F.col("_old")) > F.struct(F.col("_new_at"), F.col("_new")))
    told = met.withColumns({"was": was, "now": F.when(late, was).otherwise(F.col("_new"))}).filter(~F.col("was").eqNullSafe(F.col("now")))
    sides = F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("was").alias("v")), F.struct(F.lit(1).alias("sign"), F.col("now").alias("v"))))
    each = told.withColumn("_s", sides).withColumns({"confidence_tier": tier(F.col("confidence_score"), F.col("_s.v")), "_n": F.col("_s.sign").cast("long")})
    total = lambda x, name: F.sum(F.col("_n") * x).cast("long").alias(name)
    out = each.groupBy("domain", "confidence_tier", "engine").agg(
        F.sum("_n").alias("records"), total(F.round(F.col("confidence_score") * 10_000).cast("long"), "confidence"), total(F.col("word_count"), "words"), total(F.col("char_count"), "chars")
    )
    return out.filter("records <> 0 or confidence <> 0 or words <> 0 or chars <> 0")


def fold_cells(parts: DataFrame) -> DataFrame:
    """corpus_stats() of cells() and deltas: their sums. Combinations of which nothing is left are left out."""
    now = parts.groupBy("domain", "confidence_tier", "engine").agg(*[F.sum(c).cast("long").alias(c) for c in ("records", "confidence", "words", "chars")]).filter("records <> 0")
    # a row for each combination: the sums of all groupings are made of few rows
    grouped = now.groupingSets([[F.col("domain")], [F.col("confidence_tier")], [F.col("engine")], []], "domain", "confidence_tier", "engine")
    kind = F.when(F.grouping_id() == 3, "domain").when(F.grouping_id() == 5, "tier").when(F.grouping_id() == 6, "engine").otherwise("total")
    counts = grouped.agg(kind.alias("kind"), *[F.sum(c).alias(c) for c in ("records", "confidence", "words", "chars")])
    counts = counts.withColumn("name", F.coalesce("domain", "confidence_tier", "engine"))
    entry = lambda kind: F.map_from_entries(F.sort_array(F.collect_list(F.when((F.col("kind") == kind) & F.col("name").isNotNull(), F.struct("name", "records"))))).alias(f"by_{kind}")
    total = lambda c: F.coalesce(F.sum(F.when(F.col("kind") == "total", F.col(c))), F.lit(0)).cast("long")
    out = counts.agg(total("records").alias("total_records"), entry("domain"), entry("tier"), entry("engine"), total("confidence").alias("_c"), total("words").alias("total_words"), total("chars").alias("total_chars"))
    mean = T.rounded(T.ratio(F.col("_c") / 10_000, F.col("total_records")))
    return out.select("total_records", "by_domain", "by_tier", "by_engine", mean.alias("avg_confidence"), "total_words", "total_chars")
