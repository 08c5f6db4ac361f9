"""Character metrics and script predicates as Column expressions: no Python worker, one code-point pass each.

Texts follow Python's rules: white space, digits and letters are Unicode's, lengths are code points. Null counts as empty.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python's white space, letters, digits and marks for Java's patterns, and character sets that results depend on.
WS = r"\x09-\x0d\x1c-\x20\x85\p{Z}"
BANGLA = "ঀ-৿"
DEVANAGARI = "ऀ-ॿ"
SUSPICIOUS = "¢¤ØÿçÐ×ÞßðþæŒœ"
LEGACY_FONT = "†‡÷©ÿÐ×ÞßðþæœŒ"
PUNCTUATION = ".,!?;:'\"()-/_\\@#%&*+= "
INVISIBLE = r"[​-‏﻿­]"
WORD = r"[\p{L}\p{N}_]"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"

#: Thresholds of the predicates, all parameters.
DIGITAL_CHARS, DEVANAGARI_REJECT, BANGLA_LEAST, SCRIPT_LETTERS = 30, 0.16, 0.10, 12


def col(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over value, computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def rounded(value: Column, places: int = 4, even: bool = True) -> Column:
    """To so many places as Python's round(): the exact value of the double decides, and a tie goes to the even digit, or up."""
    scale = 10.0**places
    halves = lambda x: x * 134217729.0 - (x * 134217729.0 - x)  # the upper half of a double's bits
    top = 134217729.0 * scale - (134217729.0 * scale - scale)

    def near(v: Column) -> Column:
        product = v * scale
        upper, lower = halves(v), v - halves(v)
        error = ((upper * top - product) + upper * (scale - top) + lower * top) + lower * (scale - top)  # of the product, exactly
        whole = F.floor(product)
        beyond = ((product - whole) - 0.5) + error
        return (whole + F.when(beyond > 0, 1).when(beyond < 0, 0).otherwise(F.pmod(whole, F.lit(2)) if even else 1)) / scale

    return let(value.cast("double"), near)


def strip(text: str | Column) -> Column:
    return F.regexp_replace(col(text), rf"\A[{WS}]+|[{WS}]+\z", "")


def tokens(text: str | Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(col(text), f"[{WS}]+"), lambda w: w != "")


#: Letters that are more than one code point in upper case, and what stands for each alone: a title case of one code point, the capital sharp s, or themselves.
_ONE_UPPER = {c: "ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]) if len(c.upper()) > 1}


def upper(text: str | Column) -> Column:
    """Upper case code point by code point, as SQL engines have it: a text keeps its length."""
    many = "".join(_ONE_UPPER)
    one = lambda c: F.when(c.rlike(f"[{many}]"), F.translate(c, many, "".join(_ONE_UPPER.values()))).otherwise(F.upper(c))
    return F.when(col(text).rlike(f"[{many}]"), F.array_join(F.transform(F.split(col(text), ""), one), "")).otherwise(F.upper(col(text)))


def split_lines(text: str | Column) -> Column:
    """Lines as Python's splitlines() has them."""
    plain = F.regexp_replace(col(text), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", "\n")
    return let(F.regexp_replace(plain, r"\n\z", ""), lambda t: F.when((t == "") & (col(text) == ""), F.array().cast("array<string>")).otherwise(F.split(t, "\n", -1)))


def count_of(text: str | Column, cls: str) -> Column:
    """Code points that a character class has."""
    return F.length(F.regexp_replace(col(text), f"[^{cls}]+", ""))


def letters(text: str | Column) -> Column:
    return count_of(text, r"\p{L}")


def _letter_share(text: str | Column, first: str, last: str, among: Column | None = None) -> Column:
    """Letters between two characters are what a text loses when they are translated to nothing: a look at each character, however scripts are mixed. among: the number of letters, if it is known."""
    own = "".join(c for c in map(chr, range(ord(first), ord(last) + 1)) if unicodedata.category(c)[0] == "L")
    return let(col(text), lambda t: ratio(F.length(t) - F.length(F.translate(t, own, "")), letters(t) if among is None else among))


def bangla_ratio(text: str | Column, among: Column | None = None) -> Column:
    """Bangla letters among letters; vowel signs aren't letters."""
    return _letter_share(text, BANGLA[0], BANGLA[-1], among)


def devanagari_ratio(text: str | Column, among: Column | None = None) -> Column:
    return _letter_share(text, DEVANAGARI[0], DEVANAGARI[-1], among)


def ascii_ratio(text: str | Column, among: Column | None = None) -> Column:
    return _letter_share(text, "A", "z", among)


def bangla_share(text: str | Column) -> Column:
    """Bangla code points, signs included, among all code points; the corpus record's ratio."""
    return count_of(text, BANGLA) / F.greatest(F.length(col(text)), F.lit(1))


def suspicious_glyphs(text: str | Column) -> Column:
    return F.regexp_count(col(text), F.lit(f"[{SUSPICIOUS}]"))


def legacy_glyphs(text: str | Column) -> Column:
    return F.regexp_count(col(text), F.lit(f"[{LEGACY_FONT}]"))


def control_ratio(text: str | Column) -> Column:
    low = F.regexp_replace(col(text), r"[ -\x{10FFFF}]+", "")
    return ratio(count_of(low, r"\x01-\x08\x0b\x0c\x0e-\x1f"), F.length(col(text)))


def bracket_density(text: str | Column) -> Column:
    return ratio(count_of(text, r"{}\[\]<>"), F.length(col(text)))


def symbol_noise(text: str | Column) -> Column:
    known = "".join(f"\\{c}" for c in PUNCTUATION)
    return ratio(F.length(F.regexp_replace(col(text), rf"[\p{{L}}\p{{N}}{WS}{known}]+", "")), F.length(col(text)))


def cid_references(text: str | Column) -> Column:
    return F.regexp_count(col(text), F.lit(r"\(cid:\p{Nd}+\)"))


def entropy(text: str | Column) -> Column:
    """Shannon entropy of the code points, in bits.

    A character's count is what the text loses without it. The first character of what is left is taken out of it until nothing is left: frequent ones come early, so those after them look at little. What a text
    of over a hundred different ones (Chinese, say) has left then is sorted and cut into runs.
    """
    t = col(text)

    def folded(n: Column) -> Column:
        share = lambda count: count / n * F.log2(count / n)

        def without(acc: Column, _: Column) -> Column:
            rest, first = acc["rest"], F.substring(acc["rest"], 1, 1)
            lost = lambda left: (F.octet_length(rest) - F.octet_length(left)) / F.octet_length(first)
            return F.when(rest == "", acc).otherwise(let(F.replace(rest, first, F.lit("")), lambda left: F.struct(left.alias("rest"), (acc["bits"] - let(lost(left), share)).alias("bits"))))

        def finished(acc: Column) -> Column:
            runs = F.regexp_extract_all(F.array_join(F.array_sort(F.split(acc["rest"], "")), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))
            return F.when(acc["rest"] == "", acc["bits"]).otherwise(F.aggregate(runs, acc["bits"], lambda s, run: s - let(F.length(run), share)))

        return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.struct(t.alias("rest"), F.lit(0.0).alias("bits")), without, finished)).otherwise(0.0)

    return let(F.length(t), folded)


def numeric_consistency(text: str | Column) -> Column:
    """1 less 0.05 for each letter that looks like a digit beside a digit, at least 0."""
    return F.greatest(F.lit(0.0), 1 - 0.05 * F.regexp_count(col(text), F.lit(r"[OoIlSsBGZ]\p{Nd}|\p{Nd}[OoIlSsBGZ]")))


def invalid_combining(text: str | Column, strict: bool = True) -> Column:
    """A mark that doesn't follow a letter or number; strict: nor if it follows a mark that does."""
    # marks first: they are few, and what is before one is looked at only there; a letter beyond the basic plane in the pattern makes Java look back by code points
    return col(text).rlike(r"\p{M}(?<![\p{L}\p{N}𝐀]\p{M})" if strict else r"\p{M}(?<![\p{L}\p{N}\p{M}𝐀]\p{M})")


def edit_ratio(before: str | Column, after: str | Column) -> Column:
    """Places that differ and the difference of lengths over the larger length, 4 places."""
    a, b = (F.when(col(x) == "", F.array().cast("array<string>")).otherwise(F.split(col(x), "")) for x in (before, after))
    differ = F.size(F.array_remove(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), True))
    return F.when(col(before) == col(after), 0.0).otherwise(rounded(differ / F.greatest(F.length(col(before)), F.length(col(after)))))


def language(share: Column) -> Column:
    return F.when(share > 0.5, "bn").when(share > 0.1, "mixed").otherwise("en")


def language_tag(text: str | Column) -> Column:
    return let(bangla_ratio(text), language)


def page_type(text: str | Column, least: int = DIGITAL_CHARS) -> Column:
    return F.when(F.length(strip(text)) >= least, "digital").otherwise("scanned")


def wrong_script(text: str | Column, bangla_least: float = BANGLA_LEAST, devanagari_reject: float = DEVANAGARI_REJECT) -> Column:
    return let(letters(text), lambda n: (n >= SCRIPT_LETTERS) & (devanagari_ratio(text, n) >= devanagari_reject) & (bangla_ratio(text, n) < bangla_least))


def legacy_encoded(text: str | Column, share: Column | None = None) -> Column:
    """Signs of a Bangla text in a font of before Unicode, scored; 3 or more are enough."""
    # fixed values: the patterns, points and thresholds that results depend on
    t = col(text)
    score = (
        F.when(F.regexp_count(t, F.lit(rf"[{BANGLA}]+[a-zA-Z]+[{BANGLA}]*")) >= 3, 2).otherwise(0)
        + F.when(t.rlike(rf"[{BANGLA}]+@|@[{BANGLA}]"), 2).otherwise(0)
        + F.when(t.rlike(r"\p{Nd}+\[\p{Nd}+\]\p{Nd}+"), 2).otherwise(0)
        + F.when((F.length(t) > 500) & ((bangla_ratio(t) if share is None else share) < 0.15), 1).otherwise(0)
        + F.when(legacy_glyphs(t) >= 2, 1).otherwise(0)
    )
    return (F.length(t) >= 200) & (score >= 3)


def numeric_context(token: Column) -> Column:
    """Whether a token is more digits, look-alikes and number marks than anything else, and no address or abbreviation."""
    share = F.length(F.regexp_replace(token, r"[^\p{Nd}OolISsBGZ., ]+", "")) / F.greatest(F.length(token), F.lit(1))
    return ~F.contains(token, F.lit("@")) & ~(F.contains(token, F.lit(".")) & token.rlike(r"\p{L}")) & (share > 0.5)


def resized(width: str | Column, height: str | Column, least: int = 896, most: int = 1280) -> Column:
    """width and height of an image for a model: its longer edge is brought between least and most, its aspect kept as near as whole pixels allow."""
    w, h = (F.col(x) if isinstance(x, str) else x for x in (width, height))
    edge, aspect = F.greatest(w, h), w / F.greatest(h, F.lit(1))

    def nearer(value: Column, key: Callable[[Column], Column]) -> Column:
        low, high = F.floor(value), F.ceil(value)
        return F.greatest(F.when(key(low) <= key(high), low).otherwise(high), F.lit(1)).cast("int")

    wide = F.struct(F.lit(most).alias("width"), nearer(most / aspect, lambda n: F.when(n == 0, 0.0).otherwise(F.abs(aspect - most / n))).alias("height"))
    tall = F.struct(nearer(most * aspect, lambda n: F.abs(aspect - n / most)).alias("width"), F.lit(most).alias("height"))
    up = lambda x: F.floor(x * (least / F.greatest(edge, F.lit(1)))).cast("int")
    small = F.struct(up(w).alias("width"), up(h).alias("height"))
    return F.when(edge > most, F.when(aspect > 1.0, wide).otherwise(tall)).when(edge < least, small).otherwise(F.struct(w.cast("int").alias("width"), h.cast("int").alias("height")))


def count_words(text: str | Column) -> Column:
    return F.regexp_count(col(text), F.lit(f"[^{WS}]+"))


def image_type(width: str | Column, height: str | Column) -> Column:
    w, h = (F.col(x) if isinstance(x, str) else x for x in (width, height))
    aspect = w / h
    return (
        F.when((w == 0) | (h == 0), "unknown")
        .when((aspect > 0.85) & (aspect < 1.15) & (F.greatest(w, h) < 250), "seal")
        .when((w < 200) & (h < 80), "signature")
        .when(aspect > 2.5, "table_or_chart")
        .otherwise("photo")
    )


def engine_tag(engine: str | Column) -> Column:
    """The tag of an engine's name, by what it contains; digital if nothing is known."""
    e = F.lower(F.coalesce(F.col(engine) if isinstance(engine, str) else engine, F.lit("unknown")))
    has = lambda x: F.contains(e, F.lit(x))
    return F.when(has("pymupdf") | has("digital"), "digital").when(has("easy"), "easyocr").when(has("paddle"), "paddleocr").when(has("gemini"), "gemini").when(has("ollama"), "ollama").otherwise("digital")


def server_engine_tag(engine: str | Column) -> Column:
    """As engine_tag(), with the tag surya that written files have."""
    e = F.lower(F.coalesce(F.col(engine) if isinstance(engine, str) else engine, F.lit("")))
    return F.when(F.contains(e, F.lit("surya")), "surya").otherwise(engine_tag(engine))


def format_duration(ms: str | Column, exact: bool = True) -> Column:
    """exact: seconds beside minutes as toFixed() of their double has them; else by the double's product with ten, half of which goes up, as SQL's floor(x * 10 + 0.5) / 10."""
    v = F.coalesce((F.col(ms) if isinstance(ms, str) else ms).cast("double"), F.lit(0.0))
    s = v / 1000
    whole = lambda x: F.floor(x + 0.5).cast("string")
    rest = rounded(s % 60, 1, False) if exact else F.floor(s % 60 * 10 + 0.5) / 10
    minutes = F.concat(F.floor(s / 60).cast("string"), F.lit("m "), F.format_string("%.1f", rest), F.lit("s"))
    return F.when(F.isnan(v) | (v <= 0) | (v == float("inf")), "n/a").when(v < 1000, F.concat(whole(v), F.lit(" ms"))).when(s < 60, F.concat(F.format_string("%.2f", rounded(s, 2, False)), F.lit(" s"))).otherwise(minutes)


def format_size(size: str | Column) -> Column:
    b = F.col(size) if isinstance(size, str) else size
    return (
        F.when(b < 1024, F.concat(b.cast("string"), F.lit(" B")))
        .when(b < 1024 * 1024, F.concat(F.floor(b / 1024 + 0.5).cast("string"), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.2f", rounded(b / (1024.0 * 1024), 2, False)), F.lit(" MB")))
    )


def escape_html(text: str | Column) -> Column:
    out = col(text)
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def doc_id(stem: str | Column) -> Column:
    """A file's stem with the start of its MD5."""
    s = F.col(stem) if isinstance(stem, str) else stem
    return F.concat(s, F.lit("_"), F.substring(F.md5(s.cast("binary")), 1, 8))


def file_stem(path: str | Column) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(F.regexp_extract(p, r"([^/]*)/*$", 1), r"(?<=.)\.[^.]*$", "")


def normalise_email(email: str | Column) -> Column:
    return F.lower(strip(email))
