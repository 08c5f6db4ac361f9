"""Validation of digital text: one struct with all metrics and the reasons for rejection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


def corrupted_font(text: str | Column) -> Column:
    """Quick test for text of a damaged or legacy font, before the full validation."""
    return (T.legacy_glyphs(text) >= 3) | (T.cid_references(text) >= 3) | (T.control_ratio(text) > 0.05) | (T.bracket_density(text) > 0.05) | (
        (T.symbol_noise(text) > 0.12) & (T.bangla_ratio(text) < 0.05)
    )


def validate(text: str | Column, strict_combining: bool = True) -> Column:
    """bijoy_detected, the metrics (ratios to 4 places), possible_english_only, is_valid, rejection_reasons.

    A text in a legacy encoding is rejected for that alone and has no metrics.
    """
    t = T.col(text)
    # letters and the Bangla share are counted once
    metrics = lambda n, share: F.struct(
        F.length(t).alias("n"), T.legacy_encoded(t, share).alias("encoded"), share.alias("bangla"), T.ascii_ratio(t, n).alias("ascii"), T.bracket_density(t).alias("brackets"),
        T.symbol_noise(t).alias("symbols"), T.control_ratio(t).alias("control"), T.legacy_glyphs(t).alias("legacy"), T.cid_references(t).alias("cids"),
        T.suspicious_glyphs(t).alias("suspicious"), T.entropy(t).alias("entropy"), T.invalid_combining(t, strict_combining).alias("combining"),
    )
    return T.let(T.let(T.letters(t), lambda n: T.let(T.bangla_ratio(t, n), lambda share: metrics(n, share))), _report)


def _report(m: Column) -> Column:
    reasons = F.array_compact(
        F.array(
            F.when(m["control"] > 0.05, "control_characters"),
            F.when(m["legacy"] >= 3, "winansa_artifacts"),
            F.when(m["cids"] >= 3, "cid_references"),
            F.when(m["brackets"] > 0.05, "bracket_density"),
            F.when((m["symbols"] > 0.12) & (m["bangla"] < 0.05), "symbol_noise"),
            F.when(m["suspicious"] >= 5, "suspicious_glyphs"),
            F.when((m["n"] > 100) & (m["entropy"] < 2.0), "low_entropy"),
            F.when(m["combining"], "invalid_combining"),
        )
    )
    english = (m["bangla"] < 0.05) & (m["ascii"] > 0.8) & (m["n"] > 100) & (m["brackets"] <= 0.05) & (m["symbols"] <= 0.12)
    shown = lambda x: F.when(~m["encoded"], x)
    return F.struct(
        m["encoded"].alias("bijoy_detected"),
        shown(T.rounded(m["bangla"])).alias("bangla_char_ratio"),
        shown(m["suspicious"]).alias("suspicious_glyph_count"),
        shown(T.rounded(m["ascii"])).alias("ascii_dominance"),
        shown(T.rounded(m["entropy"])).alias("entropy"),
        shown(m["combining"]).alias("invalid_combining"),
        shown(T.rounded(m["control"])).alias("control_char_ratio"),
        shown(m["legacy"]).alias("winansa_artifact_count"),
        shown(m["cids"]).alias("cid_reference_count"),
        shown(T.rounded(m["brackets"])).alias("bracket_density"),
        shown(T.rounded(m["symbols"])).alias("symbol_noise_ratio"),
        shown(english).alias("possible_english_only"),
        (~m["encoded"] & (F.size(reasons) == 0)).alias("is_valid"),
        F.when(m["encoded"], F.array(F.lit("bijoy_encoding"))).otherwise(reasons).alias("rejection_reasons"),
    )
