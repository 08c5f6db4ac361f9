"""Confidence of a page from its blocks, and the gates that it decides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.correct import word_validity

#: Weights of a page's signals, thresholds of gates and tiers.
WEIGHTS_BN = {"ocr": 0.40, "unicode": 0.25, "dictionary": 0.05, "invalid": 0.15, "numeric": 0.08, "structural": 0.07}
WEIGHTS_EN = {"ocr": 0.35, "unicode": 0.10, "dictionary": 0.20, "invalid": 0.15, "numeric": 0.10, "structural": 0.10}
FALLBACK_BN, FALLBACK_EN = 0.62, 0.55
GOLD, SILVER = 0.85, 0.65
LLM_FLOOR, FLOOR_SHARE, FLOOR_WORDS = 0.86, 0.30, 30


def full_text(blocks: str | Column, between: str = "\n") -> Column:
    b = F.col(blocks) if isinstance(blocks, str) else blocks
    return F.array_join(F.transform(b, lambda x: F.coalesce(x["text"], F.lit(""))), between)


def is_bangla(blocks: str | Column) -> Column:
    b = F.col(blocks) if isinstance(blocks, str) else blocks
    return F.coalesce(F.exists(b, lambda x: x["language"].isin("bn", "mixed")), F.lit(False))


def mean_confidence(blocks: str | Column) -> Column:
    b = F.col(blocks) if isinstance(blocks, str) else blocks
    return T.ratio(F.aggregate(b, F.lit(0.0), lambda s, x: s + x["confidence"]), F.size(b))


def structural_consistency(blocks: str | Column) -> Column:
    """1 less the share of blocks of at most one character."""
    b = F.col(blocks) if isinstance(blocks, str) else blocks
    bad = F.size(F.filter(b, lambda x: F.length(T.strip(x["text"])) <= 1))
    return F.when(F.size(b) > 0, F.greatest(F.lit(0.0), 1 - bad / F.size(b))).otherwise(0.0)


def page_score(blocks: str | Column, bangla: Column | None = None, lexicon: Sequence[str] = (), validity: Column | None = None) -> Column:
    """Weighted sum of six signals, between 0 and 1, 4 places; 0 without blocks. validity: the word validity, if it comes from a join."""
    b = F.col(blocks) if isinstance(blocks, str) else blocks
    heavy = is_bangla(b) if bangla is None else bangla

    def scored(t: Column) -> Column:
        share = T.bangla_ratio(t)
        clean = F.greatest(F.lit(0.0), 1 - T.suspicious_glyphs(t) / F.greatest(0.02 * F.length(t), F.lit(5.0)))
        known = validity if validity is not None else word_validity(t, lexicon)
        signals = {
            "ocr": mean_confidence(b), "unicode": F.when(heavy, share).otherwise(1 - share), "dictionary": F.when(heavy, known).otherwise(0.8), "invalid": clean,
            "numeric": T.numeric_consistency(t), "structural": structural_consistency(b),
        }
        total = sum((F.when(heavy, WEIGHTS_BN[k]).otherwise(WEIGHTS_EN[k]) * v for k, v in signals.items()), F.lit(0.0))
        return T.rounded(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))

    return F.when(F.coalesce(F.size(b), F.lit(0)) > 0, T.let(full_text(b, " "), scored)).otherwise(0.0)


def needs_fallback(confidence: str | Column, bangla: str | Column) -> Column:
    c, h = (F.col(x) if isinstance(x, str) else x for x in (confidence, bangla))
    return c < F.when(h, FALLBACK_BN).otherwise(FALLBACK_EN)


def with_floor(confidence: Column, method: Column, bangla: Column, text: Column) -> Column:
    """A page of a model, with enough Bangla words, has a least confidence."""
    due = (method == "ocr_api") & bangla & (confidence < LLM_FLOOR) & (T.bangla_ratio(text) > FLOOR_SHARE) & (F.size(T.tokens(text)) >= FLOOR_WORDS)
    return F.when(due, LLM_FLOOR).otherwise(confidence)


def tier(confidence: Column, verified: Column, given: Column | None = None) -> Column:
    """The given tier, else gold (verified only), silver or bronze."""
    own = F.when((confidence >= GOLD) & F.coalesce(verified, F.lit(False)), "gold").when(confidence >= SILVER, "silver").otherwise("bronze")
    return own if given is None else F.coalesce(F.nullif(F.lower(T.strip(given)), F.lit("")), own)


def script_mismatch(blocks: str | Column, bangla_least: float = T.BANGLA_LEAST, devanagari_reject: float = T.DEVANAGARI_REJECT) -> Column:
    b = F.col(blocks) if isinstance(blocks, str) else blocks
    lines = F.filter(F.transform(b, lambda x: T.strip(x["text"])), lambda t: t != "")
    return T.let(F.array_join(lines, "\n"), lambda t: T.wrong_script(t, bangla_least, devanagari_reject))
