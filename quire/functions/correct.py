"""Cleaning and staged correction of texts as Column expressions. Lexicon and replacements are data that the caller gives."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import text as T
from .text import BANGLA, EDGE, WS, col, let

#: Digits of both scripts, and letters that are read for digits.
ASCII_DIGITS, BANGLA_DIGITS = "0123456789", "০১২৩৪৫৬৭৮৯"
LOOK_ALIKES, THEIR_DIGITS = "OolISsBGZ", "001155862"
NOISE_WORDS = ("HERE", "SEAL", "COPY", "STAMP")
#: What counts as a number, and as a reference number.
_NUMERIC = rf"{EDGE}[\p{{Nd}}{LOOK_ALIKES}]+[.,\p{{Nd}}]*{EDGE}"
_REFERENCE_NUMBER = rf"স্মারক[{WS}]*নং[{WS}]*[:।]?[{WS}]*[\p{{Nd}}.{WS}/]+"
#: Rows of a batch that are Python's at once.
FEW_ROWS = 512
#: Small samples of own making; real lists come from tables.
WORD_FIXES: tuple[tuple[str, str], ...] = (("বাংলদেশ", "বাংলাদেশ"), ("সরকর", "সরকার"))
VOWEL_FIXES: Mapping[str, str] = {"বলদশ": "বাংলাদেশ", "সরকর": "সরকার", "ঢক": "ঢাকা"}


def edit_matches(text: Column, pattern: str, edit: Callable[[Column], Column]) -> Column:
    """text with edit applied to each match; what lies between stays as it is."""
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    return F.array_join(F.transform(both, lambda x: F.concat(F.coalesce(x["gap"], F.lit("")), F.coalesce(edit(x["hit"]), F.lit("")))), "")


def clean_text(text: str | Column) -> Column:
    """Without font references and control characters, runs of blanks as one, at most one empty line, no white space around."""
    out = F.regexp_replace(col(text), r"\(cid:\p{Nd}+\)|[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    # a reference that only the removal of control characters leaves whole stays, as it would if they were removed second
    return T.strip(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def _composed(texts: pa.Array) -> pa.Array:
    """Composed few at a time: a worker holds a batch and its result as Arrow has them, and few Python strings."""
    one = lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t)
    parts = [pa.array([one(t) for t in texts.slice(i, FEW_ROWS).to_pylist()], pa.string()) for i in range(0, len(texts), FEW_ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(StringType())
def nfc(texts: pa.Array) -> pa.Array:
    """Unicode composition, which Spark has no expression for."""
    return _composed(texts)


@F.arrow_udf(ArrayType(StringType()))
def nfc_all(arrays: pa.Array) -> pa.Array:
    """nfc() of each element: a Python function can't be called within a lambda."""
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(arrays), 0))
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())])
    return pa.ListArray.from_arrays(offsets, _composed(arrays.flatten()), mask=arrays.is_null())


def normalise(text: str | Column, composed: Column | None = None) -> Column:
    return F.regexp_replace(nfc(col(text)) if composed is None else composed, T.INVISIBLE, "")


def fix_combining(text: str | Column) -> Column:
    """Without marks that no letter or number carries."""
    # a letter beyond the basic plane in the pattern makes Java look back by code points
    return F.regexp_replace(col(text), r"\p{M}(?<![\p{L}\p{N}\p{M}𝐀]\p{M})\p{M}*", "")


def fix_vowel_signs(text: str | Column) -> Column:
    return F.regexp_replace(col(text), r"([া-ৌ])\1+", "$1")


def fix_virama(text: str | Column) -> Column:
    once = F.replace(col(text), F.lit("্্"), F.lit("্"))
    return F.regexp_replace(once, rf"্(?<=\A্|[{WS}]্)", "")


def fix_digits(text: str | Column) -> Column:
    """In a text of enough Bangla, words with digits of both scripts get Bangla ones."""
    return let(col(text), _fixed_digits)


def _fixed_digits(text: Column) -> Column:
    pieces = F.regexp_extract_all(col(text), F.lit(rf"[{WS}]+|[^{WS}]+"), F.lit(0))
    mixed = lambda w: w.rlike("[0-9]") & w.rlike(f"[{BANGLA_DIGITS}]")
    fixed = F.array_join(F.transform(pieces, lambda w: F.when(mixed(w), F.translate(w, ASCII_DIGITS, BANGLA_DIGITS)).otherwise(w)), "")
    none = ~(col(text).rlike("[0-9]") & col(text).rlike(f"[{BANGLA_DIGITS}]"))  # no word can be mixed
    return F.when(none | (T.bangla_ratio(text) < 0.3), col(text)).otherwise(fixed)


def restore_vowels(text: str | Column, fixes: Mapping[str, str] = VOWEL_FIXES) -> Column:
    """Words whose vowel signs were lost, by a dictionary; all white space becomes single spaces."""
    pairs = [F.lit(x) for pair in fixes.items() if pair[1] for x in pair]
    known = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return replaced_words(T.tokens(text), known)


def bare_word(word: Column) -> Column:
    """A word without the marks that close it."""
    return F.rtrim(word, F.lit("।,?!;:()"))


def replaced_words(words: Column, known: Column) -> Column:
    """Words, those that a map knows without their closing marks replaced, with single spaces between. The map has no empty values."""
    fix = lambda w: let(bare_word(w), lambda b: F.coalesce(F.concat(F.element_at(known, b), F.substring(w, F.length(b) + 1, F.length(w))), w))
    return F.array_join(F.transform(words, fix), " ")


def fix_artifacts(text: str | Column, fixes: Sequence[tuple[str, str]] = WORD_FIXES) -> Column:
    """Marks that a recogniser takes for others, years, reference numbers, and words by a list in its order."""
    out = F.regexp_replace(col(text), rf"\|(?=[{WS}]|$)", "।")
    out = F.regexp_replace(out, rf"[\[\]](?<=[।{WS}{BANGLA}][\[\]])(?=[{WS}]|$)", "।")
    out = F.regexp_replace(out, "[`^~]", "")
    out = F.regexp_replace(out, r"১০(?<!\p{Nd}১০)([২-৯]\p{Nd})(?!\p{Nd})", "২০$1")
    out = let(out, lambda t: edit_matches(t, _REFERENCE_NUMBER, lambda m: F.translate(m, ASCII_DIGITS, BANGLA_DIGITS)))
    for wrong, right in fixes:
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return out


def drop_devanagari_lines(text: str | Column, bangla_least: float = 0.35, devanagari_reject: float = 0.10) -> Column:
    """Without lines that are Devanagari in the main; other lines are joined by line feeds."""
    keep = lambda x: (T.strip(x) == "") | ~T.wrong_script(x, bangla_least, devanagari_reject)
    return F.array_join(F.filter(T.split_lines(text), keep), "\n")


def _numeric_fix(token: Column) -> Column:
    return F.when(T.numeric_context(token), F.translate(token, LOOK_ALIKES, THEIR_DIGITS)).otherwise(token)


def fix_numbers(text: str | Column) -> Column:
    """Struct of the text with letters for digits in numbers replaced, and the changes: original, corrected, type."""
    found = F.regexp_extract_all(col(text), F.lit(_NUMERIC), F.lit(0))
    log = F.transform(
        F.filter(found, lambda x: _numeric_fix(x) != x), lambda x: F.struct(x.alias("original"), _numeric_fix(x).alias("corrected"), F.lit("digit_confusion").alias("type"))
    )
    return F.struct(edit_matches(col(text), _NUMERIC, _numeric_fix).alias("text"), log.alias("discrepancies"))


def fix_table_numbers(rows: str | Column) -> Column:
    """fix_numbers() for each cell of rows of cells, the changes of all cells in order."""
    cells = F.transform(F.col(rows) if isinstance(rows, str) else rows, lambda r: F.transform(r, fix_numbers))
    return let(
        cells,
        lambda c: F.struct(
            F.transform(c, lambda r: F.transform(r, lambda x: x["text"])).alias("rows"), F.flatten(F.transform(c, lambda r: F.flatten(F.transform(r, lambda x: x["discrepancies"])))).alias("discrepancies")
        ),
    )


def clean_lines(lines: str | Column) -> Column:
    """An array of recognised lines as one text: no tags, no blank lines, no lines of one noise word."""
    bare = F.transform(F.col(lines) if isinstance(lines, str) else lines, lambda x: T.strip(F.regexp_replace(x, "<[^>]+>", "")))
    return F.array_join(F.filter(bare, lambda x: (x != "") & ~F.upper(x).isin(*NOISE_WORDS)), "\n")


def clean_table(rows: str | Column) -> Column:
    """Cells without white space around, null as empty."""
    return F.transform(F.col(rows) if isinstance(rows, str) else rows, lambda r: F.transform(r, lambda c: T.strip(c)))


TABLES = "array<struct<table_id:int,structure_confidence:double,rows:array<array<string>>>>"


def digital_tables(tables: str | Column) -> Column:
    """Tables of a decoder as structs (TABLES): cells cleaned, empty tables left out, each with its number among all of the page and its confidence."""
    from ..operators.blocks import table_confidence

    raw = F.coalesce(F.col(tables) if isinstance(tables, str) else tables, F.array().cast("array<array<array<string>>>"))
    made = F.transform(raw, lambda t, i: let(clean_table(t), lambda r: F.struct((i + 1).alias("table_id"), table_confidence(r).alias("structure_confidence"), r.alias("rows"))))
    return F.filter(made, lambda t: F.size(t["rows"]) > 0)


def word_validity(text: str | Column, lexicon: Sequence[str]) -> Column:
    """Share of words with a Bangla character that a small lexicon has; 1 without such words. For a large one see operators.lexicon."""
    if not lexicon:
        return F.when(col(text).rlike(f"[{BANGLA}]"), 0.0).otherwise(1.0)
    words, known = F.filter(T.tokens(text), lambda w: w.rlike(f"[{BANGLA}]")), F.array(*map(F.lit, lexicon))
    return let(words, lambda ws: F.when(F.size(ws) == 0, 1.0).otherwise(F.size(F.filter(ws, lambda w: F.array_contains(known, w))) / F.size(ws)))


EASYOCR = ("easyocr", "easyocr_fallback", "EasyOCR_fallback")


def correct(
    text: str | Column, source: str | Column, lexicon: Sequence[str] = (), word_fixes: Sequence[tuple[str, str]] = WORD_FIXES, vowel_fixes: Mapping[str, str] = VOWEL_FIXES,
    validity: Column | None = None, composed: Column | None = None, repaired: Column | None = None, log: bool = True,
) -> Column:
    """All stages by source: text, corrections, with log the other log fields, and whether the model's stage is due (needs_repair), and for which text (staged).

    validity: the word validity, if it is known from a join with a large lexicon. composed: the text's nfc(), for use within a lambda. repaired: what the
    model's stage made of staged, or null; the stages after it go on from there.
    """
    src = F.lit(source) if isinstance(source, str) else source
    both = F.struct(col(text).alias("before"), normalise(text, composed).alias("normal"))  # no Python function within a lambda
    return let(both, lambda x: let(fix_combining(x["normal"]), lambda a: _corrected(x["before"], a, src, lexicon, word_fixes, vowel_fixes, validity, repaired, log)))


def _corrected(
    before: Column, unicode: Column, src: Column, lexicon: Sequence[str], word_fixes: Sequence[tuple[str, str]], vowel_fixes: Mapping[str, str], validity: Column | None, repaired: Column | None, log: bool
) -> Column:
    """The stages after Unicode's; before and unicode are bound."""

    def staged(a: Column) -> Column:
        return let(fix_digits(fix_virama(fix_vowel_signs(a))), lambda first: repaired_(a, first))

    def repaired_(a: Column, first: Column) -> Column:
        return let(first if repaired is None else F.coalesce(repaired, first), lambda c: finished(a, first, c))

    def finished(a: Column, first: Column, c: Column) -> Column:
        valid = validity if validity is not None else word_validity(a, lexicon)
        late = F.when(src == "ollama", restore_vowels(c, vowel_fixes)).when(src.isin(*EASYOCR), fix_artifacts(c, word_fixes)).otherwise(c)
        restored = lambda d: (src == "ollama") & (d != F.array_join(T.tokens(c), " "))  # words have no spaces, so the joins differ if a word does
        logged = lambda d: [
            F.length(before).alias("original_length"),
            src.alias("source"),
            T.rounded(valid).alias("word_validity_ratio"),
            F.when(c != first, T.rounded(word_validity(c, lexicon))).alias("word_validity_after_gemini"),
            F.when(src.isin(*EASYOCR) & (d != c), sum((F.contains(before, F.lit(w)).cast("int") for w, _ in word_fixes), F.lit(0))).alias("stage_f_fixes"),
            F.length(d).alias("corrected_length"),
            T.edit_ratio(before, d).alias("edit_distance"),
        ]
        return let(
            late,
            lambda d: F.struct(
                d.alias("text"),
                F.array_compact(
                    F.array(
                        F.when(a != before, "unicode_normalization"),
                        F.when(first != a, "pattern_correction"),
                        F.when(c != first, "gemini_bangla_validation"),
                        F.when(restored(d), "ollama_matra_restoration"),
                        F.when(src.isin(*EASYOCR) & (d != c), "stage_f_easyocr_artifacts"),
                    )
                ).alias("corrections"),
                *(logged(d) if log else []),
                ((src == "easyocr") & (T.bangla_ratio(first) > 0.2) & (valid < 0.15) & (F.length(first) > 30)).alias("needs_repair"),
                first.alias("staged"),
            ),
        )

    return staged(unicode)


def repaired(text: str, model: Callable[[str], str]) -> str:
    """What a model makes of a whole text: its answer counts if it has over half of the text's length. A model that fails changes nothing."""
    if len(text) < 20:
        return text
    try:
        said = (model(text) or "").strip()
    except Exception:  # noqa: BLE001  models are foreign code
        return text
    return said if len(said) > len(text) * 0.5 else text


def repair(corrected: DataFrame, model: Callable[[str], str], text: str = "text", due: str = "needs_repair") -> DataFrame:
    """The model's stage: texts that are due go whole through a function of a text. All rows pass, so what they come of is computed once."""
    schema = corrected.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, FEW_ROWS):
                b = whole.slice(start, FEW_ROWS)
                at = b.schema.get_field_index(text)
                asked = pc.and_kleene(b.column(b.schema.get_field_index(due)), pc.greater_equal(pc.utf8_length(b.column(at)), 20))
                said = [repaired(t.as_py(), model) for t in b.column(at).filter(asked)]  # beside the answers, one text at a time is Python's
                yield b.set_column(at, b.schema.field(at), pc.replace_with_mask(b.column(at), pc.fill_null(asked, False), pa.array(said, b.schema.field(at).type))) if said else b

    return corrected.mapInArrow(run, schema)
