"""Blocks from texts, model output and detections; tables from positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.correct import correct, drop_devanagari_lines, nfc_all
from ..functions.text import col, let

BLOCK = "struct<block_id:int,type:string,language:string,text:string,confidence:double,bbox:struct<x1:double,y1:double,x2:double,y2:double>,is_handwritten:boolean>"
BLOCKS = f"array<{BLOCK}>"
#: Detections nearer than this to the top of a row's first are in the row.
ROW_HEIGHT, MOST_WIDTHS = 15, 3


def block(number: Column, text: Column, confidence: Column, kind: Column | None = None, language: Column | None = None, bbox: Column | None = None, handwritten: Column | None = None) -> Column:
    return F.struct(
        number.cast("int").alias("block_id"),
        (F.lit("paragraph") if kind is None else kind).alias("type"),
        (T.language_tag(text) if language is None else language).alias("language"),
        text.alias("text"),
        confidence.cast("double").alias("confidence"),
        (F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double>") if bbox is None else bbox).alias("bbox"),
        (F.lit(False) if handwritten is None else handwritten).alias("is_handwritten"),
    )


def paragraphs(text: str | Column) -> Column:
    """Blocks of a digital text: its parts between empty lines, or lines if there is no empty one."""
    parts = let(col(text), lambda t: F.when(F.contains(t, F.lit("\n\n")), F.split(t, "\n\n", -1)).otherwise(F.split(t, "\n", -1)))
    kept = F.filter(F.transform(parts, T.strip), lambda p: p != "")
    return F.transform(kept, lambda p, i: block(i + 1, p, F.lit(0.9)))


def grouped_lines(text: str | Column, offset: int = 1) -> Column:
    """Blocks of runs of lines that aren't blank."""
    lines = F.array_join(F.transform(F.split(col(text), "\n", -1), T.strip), "\n")
    runs = F.filter(F.transform(F.split(lines, r"\n\n+", -1), lambda r: F.regexp_replace(r, r"\A\n+|\n+\z", "")), lambda r: r != "")
    return F.transform(runs, lambda r, i: block(i + offset, r, F.lit(0.9)))


def parsed_json(raw: str | Column, offset: int = 1) -> Column:
    """Blocks of a model's JSON, fenced or not: the first list among the known keys, or a bare list. Null if there are none."""
    clean = T.strip(raw)
    fenced = T.strip(F.regexp_replace(F.regexp_replace(clean, r"\A```[^\n]*\n?", ""), r"`+\z", ""))
    value = F.try_parse_json(F.when(clean.startswith("```"), fenced).otherwise(clean))

    def items(v: Column) -> Column:
        lists = [F.try_variant_get(v, f"$.{k}", "array<variant>") for k in ("content_blocks", "blocks", "content", "results")]
        return F.coalesce(*lists, F.try_variant_get(v, "$", "array<variant>"))

    get = lambda item, key, kind: F.try_variant_get(item, f"$.{key}", kind)
    words = lambda item: T.strip(get(item, "text", "string"))
    spoken = lambda item: F.nullif(get(item, "language", "string"), F.lit(""))
    made = lambda found: F.transform(
        found,
        lambda item, i: F.when(
            F.schema_of_variant(item).startswith("OBJECT") & (words(item) != ""),
            block(
                i + offset, words(item), F.coalesce(get(item, "confidence", "double"), F.lit(0.9)), F.coalesce(get(item, "type", "string"), F.lit("paragraph")),
                F.coalesce(spoken(item), T.language_tag(words(item))), None, F.coalesce(get(item, "is_handwritten", "boolean"), F.lit(False)),
            ),
        ),
    )
    blocks = let(value, lambda v: let(items(v), lambda found: F.array_compact(made(found))))
    return F.when(F.size(blocks) > 0, blocks)


def model_blocks(raw: str | Column, offset: int = 1) -> Column:
    """Blocks of a model's answer: its JSON, else its text by runs of lines."""
    return F.coalesce(parsed_json(raw, offset), grouped_lines(raw, offset))


def detection_blocks(detections: str | Column, offset: int = 1) -> Column:
    """Blocks of detections (text, conf, points of x and y), boxed by their points to 2 places."""
    d = F.col(detections) if isinstance(detections, str) else detections
    two = lambda x: T.rounded(x, 2)

    def box(points: Column) -> Column:
        x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
        made = F.struct(two(F.array_min(x)).alias("x1"), two(F.array_min(y)).alias("y1"), two(F.array_max(x)).alias("x2"), two(F.array_max(y)).alias("y2"))
        return F.when(F.size(points) > 0, made)

    return F.transform(d, lambda x, i: block(i + offset, x["text"], x["conf"], bbox=box(x["points"])))


def block_detections(blocks: str | Column) -> Column:
    """Detections of blocks: the corners of their boxes, none without a box."""
    b = F.col(blocks) if isinstance(blocks, str) else blocks
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    corners = lambda q: F.array(point(q["x1"], q["y1"]), point(q["x2"], q["y1"]), point(q["x2"], q["y2"]), point(q["x1"], q["y2"]))
    none = F.array().cast("array<struct<x:double,y:double>>")
    return F.transform(b, lambda x: F.struct(x["text"].alias("text"), x["confidence"].alias("conf"), F.coalesce(F.when(x["bbox"].isNotNull(), corners(x["bbox"])), none).alias("points")))


def row_fronts(tops: Column) -> Column:
    """Of ascending tops, the places (from 0) where rows begin: the first, and then always the first top that is ROW_HEIGHT or more below the front before it.

    Every top points at the front that would follow it, found by bisection. Pointers that are doubled in each round mark twice as many fronts, so n tops take log n rounds and no list is rebuilt for each of them.
    """
    int_ = lambda x: F.lit(x).cast("int")

    def marked(ys: Column) -> Column:
        n = F.size(ys)
        rounds = F.sequence(int_(1), F.length(F.bin(n)))
        half = lambda s: F.shiftright(s["lo"] + s["hi"], 1)

        def bisect(y: Column, i: Column) -> Column:
            near = lambda s: F.get(ys, half(s)) - y < ROW_HEIGHT
            cut = lambda s: F.struct(F.when(near(s), half(s) + 1).otherwise(s["lo"]).alias("lo"), F.when(near(s), s["hi"]).otherwise(half(s)).alias("hi"))
            return F.aggregate(rounds, F.struct((i + 1).alias("lo"), n.alias("hi")), lambda s, _: F.when(s["lo"] < s["hi"], cut(s)).otherwise(s))["lo"]

        start = F.struct(F.array(int_(0)).alias("fronts"), F.concat(F.transform(ys, bisect), F.array(n)).alias("next"))
        hop = lambda xs, s: F.transform(xs, lambda x: F.get(s["next"], x))
        more = lambda s, _: F.struct(F.concat(s["fronts"], F.filter(hop(s["fronts"], s), lambda x: x < n)).alias("fronts"), hop(s["next"], s).alias("next"))
        return F.when(n > 0, F.aggregate(rounds, start, more)["fronts"]).otherwise(F.array().cast("array<int>"))

    return let(tops, marked)


def scanned_table(detections: str | Column) -> Column:
    """rows of cells of one table, or null: detections by top edge fall into rows, by the distance to the row's first; cells are ordered by left edge.

    No table without two rows, or with more than three different numbers of cells.
    """
    d = F.col(detections) if isinstance(detections, str) else detections
    at = lambda x, k: F.coalesce(F.get(x["points"], F.lit(0))[k], F.lit(0.0))
    placed = F.array_sort(F.transform(d, lambda x, i: F.struct(at(x, "y").alias("y"), i.alias("i"), at(x, "x").alias("x"), x["text"].alias("text"))))

    def rows(p: Column) -> Column:
        both = lambda fronts: F.struct(fronts.alias("fronts"), F.array_append(F.slice(fronts, 2, F.greatest(F.size(fronts), F.lit(1))), F.size(p)).alias("ends"))
        cut = lambda f, e: F.slice(p, f + 1, e - f)
        return let(row_fronts(F.transform(p, lambda x: x["y"])), lambda fronts: let(both(fronts), lambda b: F.zip_with(b["fronts"], b["ends"], cut)))

    cells = lambda r: F.transform(F.array_sort(F.transform(r, lambda c: F.struct(c["x"], c["i"], c["text"].alias("text")))), lambda c: c["text"])
    usable = lambda r: (F.size(r) >= 2) & (F.size(F.array_distinct(F.transform(r, F.size))) <= MOST_WIDTHS)
    made = let(placed, lambda p: F.when(F.size(p) > 0, rows(p)).otherwise(F.slice(F.array(p), 1, 0)))
    return let(made, lambda r: F.when(usable(r), F.transform(r, cells)))


def table_confidence(rows: str | Column) -> Column:
    """0.6 of the share of rows with the most frequent number of cells and 0.4 of the share of filled cells, 4 places."""
    r = F.col(rows) if isinstance(rows, str) else rows
    widths = F.transform(r, F.size)
    modal = let(widths, lambda w: F.array_max(F.transform(F.array_distinct(w), lambda x: F.size(F.filter(w, lambda y: y == x))))) / F.size(r)
    cells = F.flatten(r)
    filled = T.ratio(F.size(F.filter(cells, lambda c: T.strip(c) != "")), F.size(cells))
    return F.when(F.size(r) > 0, T.rounded(modal * 0.6 + filled * 0.4)).otherwise(0.0)


def _due(x: Column) -> Column:
    return x["language"].isin("bn", "mixed") & (F.coalesce(x["text"], F.lit("")) != "")


def repairable(blocks: str | Column, source: str, **options) -> Column:
    """By block, the text that the model's stage gets, or null if the stage isn't due. blocks must be a column of a row."""
    b = F.col(blocks) if isinstance(blocks, str) else blocks
    ask = lambda x, n: let(correct(x["text"], source, composed=F.coalesce(n, F.lit("")), log=False, **options), lambda k: F.when(k["needs_repair"], k["staged"]))
    return F.zip_with(b, nfc_all(F.transform(b, lambda x: x["text"])), lambda x, n: F.when(_due(x), ask(x, n)))


def correct_blocks(blocks: str | Column, source: str, repaired: str | None = None, **options) -> Column:
    """blocks with the texts of Bangla and mixed ones corrected and freed of Devanagari lines, and changed: whether any was. blocks must be a column of a row.

    repaired: a column with what the model's stage made of the blocks that repairable() names, null where nothing.
    """
    b = F.col(blocks) if isinstance(blocks, str) else blocks

    def fix(x: Column, n: Column) -> Column:
        c = correct(x["text"], source, composed=F.coalesce(n["n"], F.lit("")), repaired=n["r"], log=False, **options)
        return let(c, lambda k: let(drop_devanagari_lines(k["text"]), lambda t: F.struct(t.alias("text"), ((F.size(k["corrections"]) > 0) | (F.size(T.split_lines(k["text"])) != F.size(T.split_lines(t)))).alias("changed"))))

    plain = lambda x: F.struct(x["text"].alias("text"), F.lit(False).alias("changed"))
    better = F.coalesce(F.col(repaired) if repaired else F.lit(None), F.transform(b, lambda _: F.lit(None).cast("string")))
    both = F.zip_with(nfc_all(F.transform(b, lambda x: x["text"])), better, lambda n, r: F.struct(n.alias("n"), r.alias("r")))
    fixed = F.zip_with(b, both, lambda x, n: F.when(_due(x), fix(x, n)).otherwise(plain(x)))
    return let(
        fixed,
        lambda f: F.struct(F.zip_with(b, f, lambda x, y: x.withField("text", y["text"])).alias("blocks"), F.exists(f, lambda y: y["changed"]).alias("changed")),
    )


def described_image(number: Column, width: Column, height: Column, description: Column) -> Column:
    """Number, type, description and confidence of an embedded image; without a model's description, one of its type and size."""
    kind = T.image_type(width, height)
    said = F.nullif(F.substring(F.coalesce(description, F.lit("")), 1, 300), F.lit(""))
    plain = F.concat(kind, F.lit(" ("), width.cast("string"), F.lit("x"), height.cast("string"), F.lit("px)"))
    return F.struct(
        number.cast("int").alias("image_id"), kind.alias("type"), F.lit("").alias("detected_text"), F.coalesce(said, plain).alias("description"),
        F.when(said.isNotNull(), 0.8).otherwise(0.5).alias("confidence"),
    )
