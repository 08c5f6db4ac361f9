"""Metrics and corrections against plain Python definitions, on chosen and on random texts."""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.functions import correct as C
from quire.functions import text as T
from quire.functions.validate import corrupted_font, validate

ALPHABET = "aZ09OIsé ßçœ.,!?;(){}[]<>|@#~`^\t\n\r\x0b\x01\x1f\x85\xa0\u2028\u200b\ufeff\u00ad" + "কখগবামিুেো্ংঁ০১৫৯।" + "अकि" + "ৗ়" + "†÷"


def texts(n: int = 300) -> list[str]:
    r = random.Random(0)
    out = ["", " ", "a", "ab" * 15, "x" * 29, "x" * 30, "(cid:12)" * 3, "\u09be", "ক\u09be\u0982", "্্ক ্খ", "\r\n", "a\r\nb\u2028c\n\n", "\U0001d400 \U0001f600"]
    return out + ["".join(r.choice(ALPHABET) for _ in range(r.randint(1, 60))) for _ in range(n)] + ["".join(r.choice("কখগ abc1১") for _ in range(r.randint(1, 200))) for _ in range(60)]


@pytest.fixture(scope="module")
def run(spark):
    own = texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(own)], "i int, text string").cache()

    def check(column, want, close=False):
        got = {r.i: r.x for r in df.select("i", column.alias("x")).collect()}
        for i, t in enumerate(own):
            w = want(t)
            assert (got[i] == pytest.approx(w, abs=1e-9)) if close else got[i] == w, (t, got[i], w)

    return check


def share(t, test):
    own = [c for c in t if c.isalpha()]
    return sum(map(test, own)) / len(own) if own else 0.0


def bn(t):
    return share(t, lambda c: "\u0980" <= c <= "\u09ff")


def over(t, test):
    return sum(map(test, t)) / len(t) if t else 0.0


def entropy(t):
    return -sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values()) if t else 0.0


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (T.bangla_ratio, bn),
        (T.devanagari_ratio, lambda t: share(t, lambda c: "\u0900" <= c <= "\u097f")),
        (T.ascii_ratio, lambda t: share(t, str.isascii)),
        (T.control_ratio, lambda t: over(t, lambda c: 0 < ord(c) < 32 and c not in "\t\n\r")),
        (T.bracket_density, lambda t: over(t, lambda c: c in "{}[]<>")),
        (T.symbol_noise, lambda t: over(t, lambda c: not c.isalnum() and not c.isspace() and c not in T.PUNCTUATION)),
        (T.entropy, entropy),
        (T.bangla_share, lambda t: sum("\u0980" <= c <= "\u09ff" for c in t) / max(1, len(t))),
        (T.numeric_consistency, lambda t: max(0.0, 1 - 0.05 * len(re.findall(r"[OoIlSsBGZ]\d|\d[OoIlSsBGZ]", t)))),
    ],
)
def test_ratios(run, column, want):
    run(column("text"), want, close=True)


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (T.suspicious_glyphs, lambda t: sum(c in T.SUSPICIOUS for c in t)),
        (T.legacy_glyphs, lambda t: sum(c in T.LEGACY_FONT for c in t)),
        (T.cid_references, lambda t: len(re.findall(r"\(cid:\d+\)", t))),
        (T.strip, str.strip),
        (T.tokens, str.split),
        (T.split_lines, str.splitlines),
        (T.page_type, lambda t: "digital" if len(t.strip()) >= 30 else "scanned"),
        (T.language_tag, lambda t: "bn" if bn(t) > 0.5 else "mixed" if bn(t) > 0.1 else "en"),
        (T.invalid_combining, lambda t: any(unicodedata.category(c)[0] == "M" and (not i or unicodedata.category(t[i - 1])[0] not in "LN") for i, c in enumerate(t))),
    ],
)
def test_counts_and_tokens(run, column, want):
    run(column("text"), want)


def combined(t):
    out, base = [], False
    for c in t:
        kind = unicodedata.category(c)[0]
        if kind != "M":
            base = kind in "LN"
        if kind != "M" or base:
            out.append(c)
    return "".join(out)


def clean(t):
    t = re.sub(r"\(cid:\d+\)", "", t)
    t = "".join(c for c in t if c >= " " or c in "\t\n\r")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t)).strip()


def virama(t):
    t = re.sub("(?<=\\s)\u09cd", "", t.replace("\u09cd\u09cd", "\u09cd"))
    return t[1:] if t.startswith("\u09cd") else t


def digits(t):
    if bn(t) < 0.3:
        return t
    both = lambda w: re.search("[0-9]", w) and re.search("[০-৯]", w)
    return re.sub(r"\S+", lambda m: m[0].translate(str.maketrans(C.ASCII_DIGITS, C.BANGLA_DIGITS)) if both(m[0]) else m[0], t)


def numbers(t):
    """The text, and how many tokens changed."""
    changed = []

    def fix(m):
        w = m[0]
        if re.fullmatch(r"[\d.,]+", w) or "." in w and any(c.isalpha() for c in w):
            return w
        fixed = w.translate(str.maketrans(C.LOOK_ALIKES, C.THEIR_DIGITS))
        changed.extend([w] * (fixed != w))
        return fixed

    return re.sub(r"\b[\dOolISsBGZ]+[.,\d]*\b", fix, t), changed


def devanagari(t):
    bad = lambda x: sum(c.isalpha() for c in x) >= 12 and share(x, lambda c: "\u0900" <= c <= "\u097f") >= 0.1 and bn(x) < 0.35
    return "\n".join(x for x in t.splitlines() if not x.strip() or not bad(x))


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (C.clean_text, clean),
        (C.normalise, lambda t: re.sub("[\u200b-\u200f\ufeff\u00ad]", "", unicodedata.normalize("NFC", t))),
        (C.fix_combining, combined),
        (C.fix_vowel_signs, lambda t: re.sub("([\u09be-\u09cc])\\1+", r"\1", t)),
        (C.fix_virama, virama),
        (C.fix_digits, digits),
        (C.drop_devanagari_lines, devanagari),
    ],
)
def test_transforms(run, column, want):
    run(column("text"), want)


def test_numbers(spark):
    r = random.Random(1)
    own = ["".join(r.choice("0OolISsBGZ12.,- a@\nকা৫") for _ in range(r.randint(1, 25))) for _ in range(400)] + ["I owe lOO, 1O.5 so", "2O24", "১২O"]
    rows = spark.createDataFrame([(t,) for t in own], "text string").select("text", C.fix_numbers("text").alias("f")).collect()
    for x in rows:
        assert (x.f.text, [d.original for d in x.f.discrepancies]) == numbers(x.text)


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first().x


def test_artifacts_and_vowels(spark):
    t = "অফিস| নং] ১০২৩ `^ স্মারক নং: 12/3 সরকর"
    assert one(spark, t, C.fix_artifacts("text")) == "অফিস। নং। ২০২৩  স্মারক নং: ১২/৩ সরকার"
    assert one(spark, "ঢক,  এ\nসরকর", C.restore_vowels("text")) == "ঢাকা, এ সরকার"
    assert one(spark, "plain  text", C.restore_vowels("text", {})) == "plain text"


def test_edit_ratio(spark):
    rows = [("abc", "abd", 0.3333), ("", "", 0.0), ("ab", "abcd", 0.5), ("x", "", 1.0), ("same", "same", 0.0)]
    got = spark.createDataFrame(rows, "a string, b string, w double").select(T.edit_ratio("a", "b").alias("x"), "w").collect()
    assert all(r.x == r.w for r in got)


def test_staged_correction(spark):
    t = "বাাংলা ্ক ৫5 text| `"
    by = {s: one(spark, t, C.correct("text", s)) for s in ("surya", "ollama", "easyocr", "other")}
    assert by["surya"].corrections == ["unicode_normalization", "pattern_correction"] or by["surya"].corrections == ["pattern_correction"]
    assert "stage_f_easyocr_artifacts" in by["easyocr"].corrections and "|" not in by["easyocr"].text
    assert by["surya"].text == by["other"].text and by["surya"].corrected_length == len(by["surya"].text)
    assert one(spark, "hello world", C.correct("text", "surya")).text == "hello world"
    assert one(spark, "hello world", C.correct("text", "surya")).edit_distance == 0.0
    assert one(spark, "সরকর", C.correct("text", "ollama")).corrections == ["ollama_matra_restoration"]


def test_word_validity(spark):
    assert one(spark, "no bangla here", C.word_validity("text", ["ক"])) == 1.0
    assert one(spark, "ক খ ক।", C.word_validity("text", ["ক"])) == pytest.approx(1 / 3)


def test_repair_only_sees_what_is_due(spark):
    df = spark.createDataFrame([(1, "খ" * 40, True), (2, "short", True), (3, "y" * 40, False), (4, "z" * 40, True)], "i int, text string, needs_repair boolean")
    got = {r.i: r.text for r in C.repair(df, lambda t: "fixed " * 10 if t[0] == "খ" else "no").collect()}
    assert got == {1: ("fixed " * 10).strip(), 2: "short", 3: "y" * 40, 4: "z" * 40}


def test_validation(spark):
    good = "An ordinary page of digital text, with enough words to be sure of it; nothing in it is odd. " * 2
    v = one(spark, good, validate("text"))
    assert v.is_valid and v.rejection_reasons == [] and v.possible_english_only and not v.bijoy_detected
    cases = {"\x01\x02" * 10 + "abc": "control_characters", "†‡÷": "winansa_artifacts", "(cid:1)(cid:2)(cid:3)": "cid_references", "{}[]": "bracket_density", "¤¤¤¤¤ abc": "suspicious_glyphs", "ab" * 60: "low_entropy", "কাং": "invalid_combining"}
    for text, reason in cases.items():
        v = one(spark, text, validate("text"))
        assert not v.is_valid and reason in v.rejection_reasons, text
    assert one(spark, "কাং", validate("text", strict_combining=False)).is_valid
    legacy = "বাংlaচ কখab গঘcd " * 20 + "x@ক 81[64]47"
    v = one(spark, legacy, validate("text"))
    assert v.bijoy_detected and not v.is_valid and v.entropy is None and v.rejection_reasons == ["bijoy_encoding"]
    assert one(spark, "†‡÷", corrupted_font("text")) and not one(spark, good, corrupted_font("text"))


def test_wrong_script(spark):
    assert one(spark, "अबचदएफगहइजकलमन", T.wrong_script("text")) and not one(spark, "अबच", T.wrong_script("text"))
    assert not one(spark, "কখগঘঙচছজঝঞটঠড", T.wrong_script("text"))


def test_small_helpers(spark):
    df = spark.createDataFrame([(100, 100, 400.0, 500), (0, 5, 61_500.0, 2048), (150, 60, None, 3_000_000), (900, 300, 1500.0, 1)], "w int, h int, ms double, n long")
    got = df.select(T.image_type("w", "h").alias("k"), T.format_duration("ms").alias("d"), T.format_size("n").alias("s")).collect()
    assert [r.k for r in got] == ["seal", "unknown", "signature", "table_or_chart"]
    assert [r.d for r in got] == ["400 ms", "1m 1.5s", "n/a", "1.50 s"]
    assert [r.s for r in got] == ["500 B", "2 KB", "2.86 MB", "1 B"]
    assert one(spark, '<a href="x">\'&', T.escape_html("text")) == "&lt;a href=&quot;x&quot;&gt;&#39;&amp;"
    assert [one(spark, e, T.engine_tag("text")) for e in ("PyMuPDF", "surya", "EasyOCR", "ollama:x", None)] == ["digital", "digital", "easyocr", "ollama", "digital"]
    assert one(spark, "surya", T.server_engine_tag("text")) == "surya"
    assert one(spark, "/a/b/my.file.pdf", T.file_stem("text")) == "my.file"
    assert one(spark, "x", T.doc_id("text")).startswith("x_9dd4e461")
    assert one(spark, "  A@B.c ", T.normalise_email("text")) == "a@b.c"
    assert one(spark, "12.5", T.numeric_context(F.col("text"))) and not one(spark, "a@1", T.numeric_context(F.col("text")))
