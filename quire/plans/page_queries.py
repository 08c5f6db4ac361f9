"""More queries over the driver's tables, with DuckDB's SQL: pages, their recognition, files and reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import correct as C
from ..functions import text as T
from ..operators import blocks as B
from ..operators import corpus, documents, jobs
from ..operators import score as S
from ..sources import files, sinks, store
from ..sources.scratch import scratch_path
from .cascade import Engines, primary_text, process_pages
from .queries import (
    _BN, _PARTS, _SQL_BN, _STATUS, _UNICODE, BENGALI, LATIN, NAGARI, _artifacts, _correct, _documents, _jobs, _validation_sql, bangla, matches, number, q, query, rounded, share, strip, table, tag, tokens,
)


def _md5(x: str | Column) -> Column:
    return F.md5((F.col(x) if isinstance(x, str) else x).cast("binary"))


#: A few words as a lexicon, transliterated.
_LEXICON = [w.translate(dict(zip(map(ord, LATIN), BENGALI))) for w in ("the", "and", "of", "de", "la", "und", "ba", "ko", "vo", "mi")]


def _score_sql(b: str, t: str, confidence: str, bangla_lexicon: list[str] | None = None) -> str:
    """The page's score from its blocks' texts b, their join t and the confidence of each."""
    heavy = f"len(list_filter({b}, lambda x: {share('x', _BN)} > 0.1)) > 0"
    known = f"list_filter({tokens(t)}, lambda w: regexp_matches(w, '[{_BN}]'))"
    valid = f"if(len({known}) = 0, 1.0, len(list_filter({known}, lambda w: list_contains({bangla_lexicon or [''] }::varchar[], w))) / greatest(len({known}), 1))"
    clean = f"greatest(0.0, 1 - {number(t, T.SUSPICIOUS)} / greatest(0.02 * length({t}), 5.0))"
    numeric = f"greatest(0.0, 1 - 0.05 * {matches(t, '[OoIlSsBGZ][0-9]|[0-9][OoIlSsBGZ]')})"
    shape = f"(1 - len(list_filter({b}, lambda x: length({strip('x')}) <= 1)) / greatest(len({b}), 1))"
    mean = f"list_sum(list_transform({b}, lambda x: {confidence}::double)) / greatest(len({b}), 1)"
    parts = lambda w, u, d: " + ".join(f"{x}::double * {v}" for x, v in zip(w, (mean, u, d, clean, numeric, shape)))
    bn, en = (list(w.values()) for w in (S.WEIGHTS_BN, S.WEIGHTS_EN))
    return f"case when len({b}) = 0 then 0.0 else {rounded(f'if({heavy}, {parts(bn, share(t, _BN), valid)}, {parts(en, f"(1 - {share(t, _BN)})", "0.8::double")})')} end"


@query(
    f"""with d as (select doc_id, {_SQL_BN} as text from documents), p as (select doc_id, {_PARTS} as b from d), t as (select *, array_to_string(b, ' ') as t, array_to_string(b, chr(10)) as f from p),
    s as (select *, {_score_sql('b', "coalesce(t, '')", '0.9', _LEXICON)} as score, len(list_filter(b, lambda x: {share('x', _BN)} > 0.1)) > 0 as bn from t)
    select doc_id, score, bn, score < if(bn, 0.62, 0.55) as needs_fallback,
    if(bn and score < 0.86 and {share('f', _BN)} > 0.30 and len({tokens('f')}) >= 30, 0.86, score) as floored, case when score >= 0.65 then 'silver' else 'bronze' end as tier from s"""
)
def bangla_page_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bangla weights, gate and floor, over texts transliterated character by character."""
    b = table(spark, sf_dir, "documents").select("doc_id", B.paragraphs(bangla()).alias("blocks"))
    s = b.select("doc_id", S.page_score("blocks", lexicon=_LEXICON).alias("score"), S.is_bangla("blocks").alias("bn"), S.full_text("blocks").alias("f"))
    return s.select(
        "doc_id", "score", "bn", S.needs_fallback("score", "bn").alias("needs_fallback"), S.with_floor(F.col("score"), F.lit("ocr_api"), F.col("bn"), F.col("f")).alias("floored"),
        S.tier(F.col("score"), F.lit(False), F.lit(" ")).alias("tier"),
    )


@query(
    """with recursive l as (select l_orderkey as id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as rn, l_linenumber * 9 as y, l_quantity as x, l_partkey::varchar as t from lineitem),
    r as (select id, rn, y as anchor, 1 as row from l where rn = 1
        union all select l.id, l.rn, if(l.y - r.anchor < 15, r.anchor, l.y), if(l.y - r.anchor < 15, r.row, r.row + 1) from r join l on l.id = r.id and l.rn = r.rn + 1),
    c as (select id, row, string_agg(t, ',' order by x, l.rn) as cells, count(*) as w from r join l using (id, rn) group by id, row),
    s as (select id, string_agg(cells, ';' order by row) as rows, count(*) as n, count(distinct w) as widths from c group by id)
    select id, if(n >= 2 and widths <= 3, rows, null) as rows from s"""
)
def anchored_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections whose tops are 9 apart: a row takes what is less than 15 below its first."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("int").alias("n"), F.col("l_partkey").alias("p"), F.col("l_quantity").cast("double").alias("x"))
    d = F.array_sort(F.collect_list(F.struct("n", "p", "x")))
    made = F.transform(d, lambda c: F.struct(c["p"].cast("string").alias("text"), F.lit(0.9).alias("conf"), F.array(F.struct(c["x"].alias("x"), (c["n"] * 9).cast("double").alias("y"))).alias("points")))
    t = l.groupBy("id").agg(made.alias("d")).select("id", B.scanned_table("d").alias("r"))
    return t.select("id", F.when(F.col("r").isNotNull(), F.array_join(F.transform("r", lambda c: F.array_join(c, ",")), ";")).alias("rows"))


@query(
    """with c as (select p_partkey, replace(p_partkey::varchar, '1', 'l') as a, p_size || 'S' as b from part)
    select p_partkey, translate(a, 'l', '1') || '|word' || ';' || translate(b, 'S', '5') || '|Item l2.5' as rows, if(a = p_partkey::varchar, 0, 1) + 1 as changes from c"""
)
def table_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(F.array(F.translate(F.col("p_partkey").cast("string"), "1", "l"), F.lit("word")), F.array(F.concat(F.col("p_size").cast("string"), F.lit("S")), F.lit("Item l2.5")))
    t = table(spark, sf_dir, "part").select("p_partkey", cells.alias("r")).select("p_partkey", C.fix_table_numbers("r").alias("f"))
    return t.select("p_partkey", F.array_join(F.transform("f.rows", lambda r: F.array_join(r, "|")), ";").alias("rows"), F.size("f.discrepancies").alias("changes"))


@query(
    """with c as (select page_id, [url, replace(url, '/', ' 10.5 '), regexp_replace(coalesce(html, ''), '[^0-9OolISsBGZ., ]', '', 'g'), 'l0', '1.O', 'mail@1', '12', 'a1', '1a', 'O.1'] as w from pages), u as (select page_id, generate_subscripts(w, 1) as i, unnest(w) as w from c)
    select page_id, i::int as i, not contains(w, '@') and not (contains(w, '.') and regexp_matches(w, '\\p{L}')) and length(regexp_replace(w, '[^\\p{Nd}OolISsBGZ., ]+', '', 'g')) / greatest(length(w), 1) > 0.5 as numeric from u"""
)
def numeric_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.array("url", F.replace("url", F.lit("/"), F.lit(" 10.5 ")), F.regexp_replace(F.coalesce("html", F.lit("")), "[^0-9OolISsBGZ., ]", ""), *map(F.lit, ("l0", "1.O", "mail@1", "12", "a1", "1a", "O.1")))
    t = table(spark, sf_dir, "pages").select("page_id", F.posexplode(w).alias("i", "w"))
    return t.select("page_id", (F.col("i") + 1).alias("i"), T.numeric_context(F.col("w")).alias("numeric"))


_NG = f"translate(text, {q(LATIN)}, {q(NAGARI)})"


def _wrong(x: str, devanagari: float, least: float) -> str:
    return f"({number(x, r'\p{L}')} >= 12 and {share(x, 'ऀ-ॿ')} >= {devanagari} and {share(x, _BN)} < {least})"


def _kept_lines(lines: str) -> str:
    return f"list_filter({lines}, lambda y: {strip('y')} = '' or not {_wrong('y', 0.10, 0.35)})"


@query(
    f"""with m as (select conv_id, turn, {_SQL_BN} || chr(10) || {_NG} || chr(10) || chr(10) || 'x y' as text from conversations), p as (select conv_id, turn, {_PARTS} as b from m),
    s as (select conv_id, turn, generate_subscripts(b, 1) as block, unnest(b) as t from p), a as (select *, {_UNICODE} as a, {_correct('t')} as c, {tag(share('t', _BN))} as l from s),
    k as (select *, string_split(c, chr(10)) as before, {_kept_lines("string_split(c, chr(10))")} as after from a)
    select conv_id, turn, block::int as block, l as language, md5(if(l = 'en', t, coalesce(array_to_string(after, chr(10)), ''))) as md5, bool_or(l <> 'en' and (a <> t or c <> a or len(before) <> len(after))) over (partition by conv_id, turn) as changed from k"""
)
def block_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blocks of Bangla and Devanagari lines, as the first engine would have read them."""
    mixed = F.concat(bangla(), F.lit("\n"), F.translate("text", LATIN, NAGARI), F.lit("\n\nx y"))
    b = table(spark, sf_dir, "conversations").select("conv_id", "turn", B.paragraphs(mixed).alias("blocks")).select("conv_id", "turn", B.correct_blocks("blocks", "surya").alias("f"))
    each = b.select("conv_id", "turn", "f.changed", F.explode("f.blocks").alias("b"))
    return each.select("conv_id", "turn", F.col("b.block_id").alias("block"), "b.language", _md5("b.text").alias("md5"), "changed")


@query(
    f"""with t as (select doc_id, text, array_to_string(list_transform(string_split(text, chr(10)), lambda x: if(length(x) % 2 = 0, translate(x, {q(LATIN)}, {q(NAGARI)}), x)), chr(10)) as t from documents),
    l as (select *, list_filter(list_transform(string_split(t, chr(10)), lambda x: {strip("regexp_replace(x, '<[^>]+>', '', 'g')")}), lambda x: x <> '' and upper(x) not in ('HERE', 'SEAL', 'COPY', 'STAMP')) as l from t),
    k as (select *, coalesce(array_to_string({_kept_lines('l')}, chr(10)), '') as k from l),
    p as (select *, list_filter(list_transform({_PARTS.replace('text', 't')}, lambda p: {strip('p')}), lambda p: p <> '') as b from k), j as (select *, coalesce(array_to_string(b, chr(10)), '') as j from p)
    select doc_id, md5(if(length({strip('k')}) >= 20 and not {_wrong('k', 0.18, 0.12)}, k, '')) as md5, {_wrong('j', 0.16, 0.10)} as mismatch from j"""
)
def primary_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first engine's clean-up and script test, and the script test of a page's blocks, over lines some of which are Devanagari."""
    t = F.array_join(F.transform(F.split("text", "\n", -1), lambda x: F.when(F.length(x) % 2 == 0, F.translate(x, LATIN, NAGARI)).otherwise(x)), "\n")
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", "t", B.paragraphs("t").alias("b"))
    return d.select("doc_id", _md5(primary_text("t")).alias("md5"), S.script_mismatch("b").alias("mismatch"))


@query(
    f"""with t as (select doc_id, {_SQL_BN} as t from documents), c as (select doc_id, {_correct('t')} as c, {_UNICODE} as a from t),
    f as (select doc_id, {_artifacts('c')} as d, {share('c', _BN)} > 0.2 and regexp_matches(a, '[{_BN}]') and length(c) > 30 as due from c), s as (select *, {strip("d || '।'")} as s from f)
    select doc_id, due, md5(if(due and length(d) >= 20 and length(s) > length(d) * 0.5, s, d)) as md5 from s"""
)
def model_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's stage with a model that ends what it is asked about with a mark."""
    c = table(spark, sf_dir, "documents").select("doc_id", bangla().alias("t")).select("doc_id", C.correct("t", "easyocr", log=False).alias("c")).select("doc_id", F.col("c.text").alias("text"), F.col("c.needs_repair").alias("needs_repair"))
    return C.repair(c, lambda t: t + "।").select("doc_id", F.col("needs_repair").alias("due"), _md5("text").alias("md5"))


@query(
    """select conv_id as doc_id, bool_or(role = 'user' and turn % 2 = 1) as has_handwriting, bool_or(turn % 3 = 2) as has_tables, bool_or(turn >= 4) as has_images from conversations group by conv_id"""
)
def document_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    b = B.block(F.lit(1), F.col("text"), F.lit(0.9), handwritten=(F.col("role") == "user") & (F.col("turn") % 2 == 1))
    some = lambda due: F.when(due, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    p = c.select(F.col("conv_id").alias("doc_id"), F.array(b).alias("blocks"), some(F.col("turn") % 3 == 2).alias("tables"), some(F.col("turn") >= 4).alias("images"))
    return documents.flags(p)


@query(
    """select conv_id as doc_id, turn::int as page, 'FINAL_ENGINE' as keyword, 'method=m engine=' || role as detail, 'info' as severity from conversations
    union all select conv_id, turn::int, 'STEP', unnest(['type:' || role, 'x']), 'info' from conversations"""
)
def page_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_number"), F.lit("m").alias("method"), F.col("role").alias("engine"), F.array(F.concat(F.lit("type:"), "role"), F.lit("x")).alias("steps"))
    return p.select("doc_id", F.explode(documents.page_decisions()).alias("d")).select("doc_id", "d.*")


@query(
    f"""with d as (select l_orderkey as id, l_linenumber as n, l_quantity::double as x, l_extendedprice::double / 3 as y from lineitem)
    select id, n, {rounded('x', 2)} as x1, {rounded('y', 2)} as y1, {rounded('x + 5.555', 2)} as x2, {rounded('y + 1.005', 2)} as y2, {rounded('x + 5.555', 2)} as corner_x, {rounded('y + 1.005', 2)} as corner_y from d"""
)
def detection_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections to blocks with boxes, and back."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice").cast("double") / 3).alias("y"))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    d = F.array(F.struct(F.lit("t").alias("text"), F.lit(0.5).alias("conf"), F.array(point(F.col("x"), F.col("y")), point(F.col("x") + 5.555, F.col("y") + 1.005)).alias("points")))
    b = l.select("id", "n", B.detection_blocks(d).alias("b")).select("id", "n", "b", B.block_detections("b").alias("back"))
    box, third = F.col("b")[0]["bbox"], F.col("back")[0]["points"][2]
    return b.select("id", "n", *[box[k].alias(k) for k in ("x1", "y1", "x2", "y2")], third["x"].alias("corner_x"), third["y"].alias("corner_y"))


_KIND = "case when w = 0 or h = 0 then 'unknown' when w / h > 0.85 and w / h < 1.15 and greatest(w, h) < 250 then 'seal' when w < 200 and h < 80 then 'signature' when w / h > 2.5 then 'table_or_chart' else 'photo' end"


@query(
    f"""with i as (select p_partkey, (p_size * 13 % 400)::int as w, (p_size * 7 % 300)::int as h, if(p_size % 3 = 0, repeat(p_name || ' ', 12), '') as said from part), k as (select *, {_KIND} as kind from i)
    select p_partkey, 1 as image_id, kind as type, if(said <> '', substring({strip('said')}, 1, 300), kind || ' (' || w || 'x' || h || 'px)') as description, if(said <> '', 0.8, 0.5)::double as confidence from k"""
)
def image_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded images through the describers, of which the first fails."""
    from .cascade import described

    p = table(spark, sf_dir, "part")
    image = F.struct(F.when(F.col("p_size") % 3 == 0, F.repeat(F.concat("p_name", F.lit(" ")), F.lit(12))).otherwise("").cast("binary").alias("image_bytes"), (F.col("p_size") * 13 % 400).cast("int").alias("width"), (F.col("p_size") * 7 % 300).cast("int").alias("height"))
    out = described(p.select("p_partkey", F.array(image).alias("images")), (lambda b: 1 / 0, lambda b: b.decode()))
    return out.select("p_partkey", F.explode("images").alias("i")).select("p_partkey", "i.image_id", "i.type", "i.description", "i.confidence")


@query(
    """with i as (select p_partkey, (p_size * 131 % 4000)::int as w, (p_size * 71 % 3000)::int as h from part), a as (select *, greatest(w, h) as e, w / greatest(h, 1) as a from i),
    n as (select *, floor(1280 * a) as l1, ceil(1280 * a) as u1, floor(1280 / nullif(a, 0)) as l2, ceil(1280 / nullif(a, 0)) as u2 from a)
    select p_partkey, case when e > 1280 then if(a > 1, 1280, greatest(if(abs(a - l1 / 1280) <= abs(a - u1 / 1280), l1, u1), 1)) when e < 896 then floor(w * (896 / greatest(e, 1))) else w end::int as width,
    case when e > 1280 then if(a > 1, greatest(if(if(l2 = 0, 0, abs(a - 1280 / nullif(l2, 0))) <= abs(a - 1280 / nullif(u2, 0)), l2, u2), 1), 1280) when e < 896 then floor(h * (896 / greatest(e, 1))) else h end::int as height from n"""
)
def image_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 131 % 4000).cast("int").alias("w"), (F.col("p_size") * 71 % 3000).cast("int").alias("h"))
    return p.select("p_partkey", T.resized("w", "h").alias("r")).select("p_partkey", "r.width", "r.height")


@query(
    f"""with p as (select conv_id, turn, text from conversations), t as (select conv_id, turn, [[{strip('text')}, ''], ['c', 'd', 'e']] as rows from p)
    select conv_id, turn, 1 as table_id, {rounded('0.5 * 0.6 + 4.0 / 5 * 0.4')} as structure_confidence, md5(rows[1][1]) as md5 from t where rows[1][1] <> ''
    union all select conv_id, turn, 1, {rounded('0.5 * 0.6 + 3.0 / 5 * 0.4')}, md5('') from t where rows[1][1] = '' union all select conv_id, turn, 3, 1.0, md5('x') from t"""
)
def digital_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables of a page, of which the second is empty."""
    row = lambda *x: F.array(*x)
    none = F.lit(None).cast("string")
    t = F.array(row(row(F.col("text"), none), row(F.lit(" c"), F.lit("d"), F.lit("e "))), F.array().cast("array<array<string>>"), row(row(F.lit(" x "))))
    out = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(C.digital_tables(t)).alias("t"))
    return out.select("conv_id", "turn", "t.table_id", "t.structure_confidence", _md5(F.col("t.rows")[0][0]).alias("md5"))


@query(
    """with c as (select conv_id, count(*) as n, sum(octet_length(encode(text))) as bytes from conversations group by conv_id)
    select conv_id::varchar as doc_id, if(conv_id % 7 = 0, 'failed', 'done') as status, if(conv_id % 7 = 0, 0, n)::int as total_pages, if(conv_id % 7 = 0, 'ValueError: no such page', null) as error_msg,
    if(conv_id % 7 = 0, 0, n)::bigint as images, if(conv_id % 7 = 0, 0, bytes)::bigint as image_bytes from c"""
)
def decoded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that decode to pages with images, and some that don't: their outcomes, and what images there are."""
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("doc_id")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("turn", "text")))).cast("binary").alias("content"))

    def decoder(content: bytes):
        for page in json.loads(content):
            data = page["text"].encode()
            yield {"text": page["text"], "image": data, "images": [{"xref": 1, "image_bytes": data, "ext": "png", "width": 1, "height": 2}]}

    bad = c.filter("doc_id % 7 = 0").withColumn("content", F.lit(b"").cast("binary"))

    def broken(content: bytes):
        raise ValueError("no such\npage")

    pages = files.decode_pages(c.filter("doc_id % 7 <> 0"), decoder).unionByName(files.decode_pages(bad, broken))
    images = pages.groupBy(F.col("doc_id").alias("_d")).agg(F.coalesce(F.sum(F.size("images")), F.lit(0)).alias("images"), F.coalesce(F.sum(F.octet_length(F.col("images")[0]["image_bytes"])), F.lit(0)).cast("long").alias("image_bytes"))
    images = images.withColumn("images", F.greatest("images", F.lit(0)).cast("long"))
    return jobs.outcomes(pages).join(images, F.col("doc_id") == F.col("_d")).drop("_d")


@query(f"select distinct {strip('x')} as word from (select unnest(string_split(replace(text, ' ', chr(10)), chr(10))) as x from benchmark) where not starts_with(x, '#') and {strip('x')} <> ''")
def lexicon_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word list in a file, read back as a lexicon."""
    at = scratch_path(spark, "words")
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("w"))
    words.unionAll(spark.createDataFrame([("# note",), ("",)], "w string")).write.text(at)
    return files.read_lexicon(spark, at)


@query("with s as (select page_id, url, regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '(.)\\.[^.]*$', '\\1') as stem from pages where octet_length(encode(html)) <= 2000) select page_id, stem || '_' || md5(stem)[:8] as doc_id from s")
def admitted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files under a size, with the ids of their names."""
    raw = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.octet_length("html").alias("length"), F.col("page_id").cast("string").cast("binary").alias("content"))
    return files.admitted(raw, 2000).select(F.col("content").cast("string").cast("long").alias("page_id"), "doc_id")


@query("select user_id::varchar as doc_id, (max(event_id) % 9)::int as current_page, 'processing' as status from events group by user_id")
def progress_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of progress, appended as files; the last of each document is read back."""
    at = scratch_path(spark, "progress")
    e = table(spark, sf_dir, "events")
    shot = e.select(F.col("user_id").cast("string").alias("doc_id"), (F.col("event_id") % 9).cast("int").alias("current_page"), F.lit(9).alias("total_pages"), F.lit("processing").alias("status"), F.lit("").alias("message"), F.lpad(F.col("event_id").cast("string"), 20, "0").alias("updated_at"))
    sinks.append_progress(shot.filter("current_page < 5"), at)
    sinks.append_progress(shot.filter("current_page >= 5"), at)
    return sinks.last_progress(spark, at).select("doc_id", "current_page", "status")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as processed pages."""
    engine = F.when(F.col("role") == "user", "surya").when(F.col("role") == "assistant", "gemini").otherwise("ollama:x")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("page_number"), F.col("text").alias("full_text"), engine.alias("engine"),
        (F.length("text") % 1000 / 1000).alias("confidence_score"), F.col("role").alias("domain"), F.lit(False).alias("verified"),
    )


_TURNS = "select conv_id::varchar as doc_id, turn::int as page_number, text as full_text, case role when 'user' then 'surya' when 'assistant' then 'gemini' else 'ollama:x' end as engine, length(text) % 1000 / 1000 as confidence_score, role as domain from conversations"


@query(
    f"""with p as ({_TURNS}), v as (select *, page_number % 3 = 1 or (page_number % 3 = 0 and conv_odd) as verified from (select *, doc_id::bigint % 2 = 1 as conv_odd from p))
    select doc_id, page_number, engine, verified, case when confidence_score >= 0.85 and verified then 'gold' when confidence_score >= 0.65 then 'silver' else 'bronze' end as confidence_tier,
    len({tokens('full_text')})::int as word_count, length(full_text)::int as char_count, domain, page_number % 3 = 2 as has_table, page_number >= 4 as has_image, domain || '.png' as source_image_path from v"""
)
def verified_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page JSON written and read back, pages verified twice with other verdicts, and the corpus that is rebuilt of both."""
    at = scratch_path(spark, "store")
    pages = _turns(spark, sf_dir)
    row = F.struct(F.lit(1).alias("table_id"), F.lit(1.0).alias("structure_confidence"), F.array(F.array(F.lit("x"))).alias("rows"))
    some = lambda due, x: F.when(due, F.array(x)).otherwise(F.slice(F.array(x), 1, 0))
    image = B.described_image(F.lit(1), F.lit(1), F.lit(2), F.lit(None).cast("string"))
    more = {"tables": some(F.col("page_number") % 3 == 2, row), "images": some(F.col("page_number") >= 4, image), "source_image_path": F.concat("domain", F.lit(".png"))}
    sinks.write_page_json(pages.withColumns(more), f"{at}/pages")
    first, last = F.timestamp_seconds(F.lit(1)), F.timestamp_seconds(F.lit(2))
    key = pages.select("doc_id", "page_number")
    odd = F.col("doc_id").cast("long") % 2 == 1
    key.select("*", (F.col("page_number") % 3 != 1).alias("verified"), first.alias("at")).write.json(f"{at}/votes")
    key.select("*", ((F.col("page_number") % 3 == 1) | ((F.col("page_number") % 3 == 0) & odd)).alias("verified"), last.alias("at")).write.mode("append").json(f"{at}/votes")
    sinks.rebuild_corpus(spark, f"{at}/pages", f"{at}/corpus", f"{at}/stats", f"{at}/votes")
    return spark.read.parquet(f"{at}/corpus").select("doc_id", "page_number", "engine", "verified", "confidence_tier", "word_count", "char_count", "domain", "has_table", "has_image", "source_image_path")


_TAGGED = "with p as (" + _TURNS + "), t as (select doc_id, if(count(distinct engine) > 1, 'mixed', replace(min(engine), 'ollama:x', 'ollama')) as tag from p group by doc_id)"


def _report_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with a block each, boxed on even ones and by hand on odd ones of the user, and tables, images and decisions on some."""
    turn, user = F.col("page_number"), F.col("domain") == "user"
    real = lambda x: x.cast("double")
    box = F.when(turn % 2 == 0, F.struct(*[real(turn + F.lit(i)).alias(k) for i, k in enumerate(("x1", "y1", "x2", "y2"))]))
    b = B.block(F.lit(1), F.col("full_text"), F.col("confidence_score"), language=F.when(user, "bn").otherwise("en"), bbox=box, handwritten=user & (turn % 2 == 1))
    grid = F.struct(F.lit(1).alias("table_id"), F.lit(0.123456).alias("structure_confidence"), F.array(F.array(F.lit("x"))).alias("rows"))
    some = lambda due, x: F.when(due, F.array(x)).otherwise(F.slice(F.array(x), 1, 0))
    decision = lambda keyword, severity: F.struct(turn.alias("page"), keyword.alias("keyword"), F.lit("d").alias("detail"), severity.alias("severity"))
    decisions = F.array(decision(F.lit("FINAL_ENGINE"), F.lit("info")), decision(F.col("domain"), F.when(turn % 4 == 3, "warning")))
    image = B.described_image(F.lit(1), F.lit(1), F.lit(2), F.lit(None).cast("string"))
    more = {"method": F.lit("ocr_local"), "blocks": F.array(b), "tables": some(turn % 3 == 2, grid), "images": some(turn >= 4, image), "decisions": decisions, "ms": real(turn), "verified": user}
    return _turns(spark, sf_dir).withColumns(more)


_REPORT = """struct<source:string,total_pages:bigint,language_detected:array<string>,has_handwriting:boolean,has_tables:boolean,has_images:boolean,
    processing_summary:struct<pages_processed_locally:bigint,pages_sent_to_api:bigint,overall_confidence:double,processing_time_ms:double>,
    decision_summary:struct<total:bigint,by_severity:struct<info:bigint,warning:bigint,error:bigint>,unique_keywords:array<string>>,all_decisions:array<struct<page:int,keyword:string>>,output_engine_tag:string>"""
_PAGE_OF = """array<struct<page_number:int,extraction:struct<method:string,engine:string,confidence_score:double,correction_applied:boolean,numeric_validation_passed:boolean>,
    content_blocks:array<struct<block_id:int,text:string,language:string,bbox:array<double>,is_handwritten:boolean>>,tables:array<struct<structure_confidence:double>>,images:array<struct<type:string>>,
    full_text:string,verified:boolean,domain:string,confidence_tier:string>>"""


@query(
    f"""with r as ({_TURNS}), p as (select *, domain = 'user' as by_user from r), t as (select doc_id, if(count(distinct engine) > 1, 'mixed', replace(min(engine), 'ollama:x', 'ollama')) as tag from p group by doc_id)
    select p.doc_id, p.doc_id || '.pdf' as source, tag as output_engine_tag, count(*) as pages, min(page_number) as first_page, sum(length(full_text))::bigint as chars,
    concat_ws(',', if(bool_or(by_user), 'bn', null), if(bool_or(not by_user), 'en', null)) as languages, bool_or(by_user and page_number % 2 = 1) as has_handwriting, bool_or(page_number % 3 = 2) as has_tables,
    bool_or(page_number >= 4) as has_images, count(*) filter (engine = 'surya') as pages_local, count(*) filter (engine <> 'surya') as pages_api, {rounded('avg(confidence_score)')} as confidence, sum(page_number)::double as ms,
    2 * count(*) as decisions, (2 * count(*) - count(*) filter (page_number % 4 = 3))::bigint as info, count(*) filter (page_number % 4 = 3) as warning, 0::bigint as error,
    array_to_string(list_sort(list_distinct(list(domain) || ['FINAL_ENGINE'])), ',') as keywords, string_agg(page_number || '=' || domain, ',' order by page_number) as decided,
    string_agg(engine || ':' || printf('%.4f', confidence_score) || ':' || case when confidence_score >= 0.85 and by_user then 'gold' when confidence_score >= 0.65 then 'silver' else 'bronze' end
        || ':' || if(page_number % 2 = 0, (page_number + 3)::varchar || '.0', '-') || ':' || if(by_user and page_number % 2 = 1, 'hand', '') || ':' || if(page_number % 3 = 2, '0.1235', '') , ',' order by page_number) as shown
    from p join t on p.doc_id = t.doc_id group by p.doc_id, tag"""
)
def document_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of documents, written to a table and read back from their JSON, field by field."""
    at = scratch_path(spark, "merged")
    pages = _report_pages(spark, sf_dir)
    docs = pages.select("doc_id").distinct().withColumn("source", F.concat("doc_id", F.lit(".pdf")))
    sinks.write_merged_json(docs, pages, at)
    whole = F.from_json("json", f"document {_REPORT}, pages {_PAGE_OF}")
    r = store.current(spark, at, form="json").select("doc_id", whole.alias("r")).select("doc_id", "r.*")
    chars = F.aggregate("pages", F.lit(0).cast("long"), lambda s, p: s + F.length(p["full_text"]))
    own = lambda p, b: F.concat_ws(
        ":", p["extraction"]["engine"], F.format_string("%.4f", p["extraction"]["confidence_score"]), p["confidence_tier"], F.coalesce(F.get(b["bbox"], F.lit(3)).cast("string"), F.lit("-")),
        F.when(b["is_handwritten"], "hand").otherwise(""), F.coalesce(F.get(p["tables"], F.lit(0))["structure_confidence"].cast("string"), F.lit("")),
    )
    line = lambda x: F.array_join(x, ",")
    decided = F.filter("document.all_decisions", lambda d: d["keyword"] != "FINAL_ENGINE")
    return r.select(
        "doc_id", "document.source", "document.output_engine_tag", F.size("pages").cast("long").alias("pages"), F.col("pages")[0]["page_number"].alias("first_page"), chars.alias("chars"),
        line("document.language_detected").alias("languages"), "document.has_handwriting", "document.has_tables", "document.has_images", F.col("document.processing_summary.pages_processed_locally").alias("pages_local"),
        F.col("document.processing_summary.pages_sent_to_api").alias("pages_api"), F.col("document.processing_summary.overall_confidence").alias("confidence"), F.col("document.processing_summary.processing_time_ms").alias("ms"),
        F.col("document.decision_summary.total").alias("decisions"), "document.decision_summary.by_severity.*", line("document.decision_summary.unique_keywords").alias("keywords"),
        line(F.transform(decided, lambda d: F.concat_ws("=", d["page"].cast("string"), d["keyword"]))).alias("decided"), line(F.transform("pages", lambda p: own(p, p["content_blocks"][0]))).alias("shown"),
    )


@query(
    f"""{_TAGGED} select p.doc_id || '_' || tag || '.txt' as name, md5(string_agg(full_text, chr(10) || chr(10) order by page_number)) as md5 from p join t on p.doc_id = t.doc_id group by p.doc_id, tag
    union all select doc_id || '/page_' || page_number || '_' || replace(engine, ':', '-') || '.json', null from p"""
)
def exported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and contents of a text for each document, and names of a file for each page."""
    pages = _turns(spark, sf_dir)
    texts = sinks.document_files(sinks.document_texts(pages), "text", ".txt")
    return texts.select("name", _md5("content").alias("md5")).unionAll(sinks.page_files(pages).select("name", F.lit(None).cast("string")))


@query("select l_orderkey::varchar as doc_id, l_linenumber::int as page_number, if(l_returnflag = 'R', 'second', 'first') as text from lineitem l where l_returnflag = 'R' or l_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two runs; the second replaces those of its documents."""
    at = scratch_path(spark, "rows")
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("doc_id"), F.col("l_linenumber").cast("int").alias("page_number"), "l_returnflag")
    sinks.write_page_rows(p.select("doc_id", "page_number", F.lit("first").alias("text")), at)
    sinks.write_page_rows(p.filter("l_returnflag = 'R'").select("doc_id", "page_number", F.lit("second").alias("text")), at)
    return sinks.read_page_rows(spark, at)


@query("select 'j' || o_orderkey as id, 'processing' as status from orders where o_orderstatus not in ('F', 'O')")
def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.transition(_jobs(spark, sf_dir), "processing", ("pending",), F.lit(0)).select("id", "status")


@query("select c_nationkey::varchar as user_id, c_name || '.pdf' as filename, c_name as stem, 'pending' as status, 'pending' as job_status, true as well_formed from customer")
def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and jobs of files that are handed in; only those of the right name are taken."""
    c = table(spark, sf_dir, "customer")
    given = c.select(F.col("c_nationkey").cast("string").alias("user_id"), F.concat("c_name", F.lit(".pdf")).alias("filename")).unionAll(c.select(F.lit("u"), F.concat("c_name", F.lit(".txt"))))
    made = jobs.submissions(given)
    d, j = jobs.documents(made), jobs.jobs(made).select(F.col("id").alias("job_id"), "document_id", F.col("status").alias("job_status"))
    is_id = lambda x: F.col(x).rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    out = d.join(j, F.col("id") == F.col("document_id"))
    return out.select("user_id", "filename", F.regexp_replace("doc_id", "^[0-9a-f]{32}_", "").alias("stem"), "status", "job_status", (is_id("id") & is_id("job_id") & (F.col("id") != F.col("job_id"))).alias("well_formed"))


@query("select count(*) filter (c_acctbal > 0) as selected, count(*) as total from customer")
def file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.file_counts(table(spark, sf_dir, "customer").select((F.col("c_acctbal") > 0).alias("selected")))


@query("select o_orderkey as doc_id, if(o_custkey % 200 <= 120, if(o_custkey % 200 > 0, o_custkey % 200, coalesce(n, 0)), null)::int as page_index from orders left join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey")
def page_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of documents of up to 120; without a total it is the number of rows."""
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 200).cast("int").alias("total_pages"))
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_number"))
    return documents.coverage(d, p).select("doc_id", F.when(F.col("page_index").isNotNull(), F.size("page_index")).alias("page_index"))


@query(
    f"""with j as (select c_nationkey::varchar as user_id, count(*) as jobs, count(*) filter ({_STATUS} in ('pending', 'processing')) as active from orders join customer on o_custkey = c_custkey group by 1),
    p as (select c_nationkey::varchar as user_id, count(*) as pages from lineitem join customer on l_orderkey = c_custkey group by 1), d as (select c_nationkey::varchar as user_id, count(*) as documents from customer group by 1)
    select d.user_id, documents, coalesce(jobs, 0) as jobs, coalesce(active, 0) as active, coalesce(pages, 0) as pages from d left join j on d.user_id = j.user_id left join p on d.user_id = p.user_id"""
)
def user_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, jobs and pages of each user, by their foreign keys."""
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("document_id"))
    return jobs.user_overview(_documents(spark, sf_dir), _jobs(spark, sf_dir), pages)


# The cascade over conversations. Engines read a page's bytes as text, each by a rule of its own; SQL follows the rules.
_TO_NAGARI = dict(zip(map(ord, LATIN), NAGARI))


def _primary(b: bytes) -> list[str]:
    t = b.decode()
    return t.translate(_TO_NAGARI).split("\n") if len(t) % 4 == 0 else t.split("\n") if len(t) >= 200 else []


def _quick(b: bytes) -> list:
    t = b.decode()
    return [] if len(t) % 3 == 0 else [(w, 0.3, [(i * 10.0, 0.0)]) for i, w in enumerate(t.split(" "))]


def _first_model(b: bytes) -> str:
    t = b.decode()
    return t if len(t) >= 150 else "a short answer"


def _second_model(b: bytes) -> str:
    t = b.decode()
    if len(t) % 5 == 0:
        raise ValueError("no\nanswer")
    return t.translate(_TO_NAGARI) if len(t) % 7 == 0 else t if len(t) >= 60 else ""


def _full(b: bytes) -> list:
    return [(b.decode(), 0.5, [])]


def _runs(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(array_to_string(list_transform(string_split({x}, chr(10)), lambda y: {strip('y')}), chr(10)), '\\n\\n+'), lambda r: regexp_replace(r, '\\A\\n+|\\n+\\z', '', 'g')), lambda r: r <> '')"


def _parts(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, if(contains({x}, chr(10) || chr(10)), chr(10) || chr(10), chr(10))), lambda p: {strip('p')}), lambda p: p <> '')"


def _scored(b: str, confidence: str) -> str:
    return _score_sql(b, f"coalesce(array_to_string({b}, ' '), '')", confidence)


_LINES = f"list_filter(list_transform(string_split(p, chr(10)), lambda x: {strip("regexp_replace(x, '<[^>]+>', '', 'g')")}), lambda x: x <> '' and upper(x) not in ('HERE', 'SEAL', 'COPY', 'STAMP'))"
_VALID = _validation_sql("text").replace("with e as", "with t as (select conv_id || '/' || turn as doc_id, text from conversations where role = 'user'), e as", 1)
_CASCADE = f"""
    with v as ({_VALID}), c as (select conv_id::varchar as doc_id, turn::int as page_number, role, text, length(text) as n, if(role = 'user' and length({strip('text')}) >= 30, 'digital', 'scanned') as kind,
        coalesce(v.is_valid, false) and role = 'user' and length({strip('text')}) >= 30 as digital from conversations left join v on v.doc_id = conv_id || '/' || turn),
    p as (select *, if(n % 4 = 0, {_NG}, if(n >= 200, text, '')) as p from c), k as (select *, coalesce(array_to_string({_kept_lines(_LINES)}, chr(10)), '') as k from p),
    g as (select *, if(length({strip('k')}) >= 20 and not {_wrong('k', 0.18, 0.12)}, k, '') as first, if(n % 3 = 0, []::varchar[], string_split(text, ' ')) as words,
        if(n >= 150, text, 'a short answer') as m1, if(n % 5 = 0, '', if(n % 7 = 0, {_NG}, if(n >= 60, text, ''))) as m2 from k),
    s as (select *, {_scored('words', '0.3')} as quick, if(length({strip('m1')}) >= 20, {strip('m1')}, if(length({strip('m2')}) >= 20, {strip('m2')}, '')) as said, length({strip('m1')}) >= 20 as by_first from g),
    a as (select *, {_runs('said')} as said_blocks from s),
    w as (select *, {_wrong("coalesce(array_to_string(list_filter(list_transform(said_blocks, lambda x: " + strip('x') + "), lambda x: x <> ''), chr(10)), '')", 0.16, 0.10)} as wrong from a),
    r as (select *, case when digital then 'digital' when first <> '' then 'first' when quick >= 0.55 then 'quick' when said <> '' and not wrong then 'model' else 'full' end as tier from w),
    b as (select *, case tier when 'digital' then {_parts('text')} when 'first' then {_parts('first')} when 'quick' then words when 'model' then said_blocks else [text] end as b,
        case tier when 'quick' then 0.3 when 'full' then 0.5 else 0.9 end as conf from r),
    z as (select *, {_scored('b', 'conf')} as score from b),
    l as (select *, ['type:' || kind] || if(tier = 'digital', ['digital_ok:' || n || 'chars'], if(kind = 'digital', ['digital_corrupt_rerouting'], []::varchar[]) || ['ocr_mode:surya_first', 'surya:trying']
        || if(tier = 'first', ['surya:ok:' || length(first) || 'chars'], ['surya:empty_fallthrough'] || if(tier = 'quick', ['llm:skipped_sufficient_local:' || printf('%.3f', quick)], ['llm_chain:trying']
        || if(tier = 'model', ['llm_chain:ok:' || if(by_first, 'ollama:a', 'gemini') || ':' || length(said) || 'chars'],
            [if(said <> '', 'llm_chain:script_mismatch:' || if(by_first, 'ollama:a', 'gemini'), 'llm_chain:failed:none:ollama:a=no usable text;gemini=' || if(n % 5 = 0, 'no answer', 'no usable text')), 'easyocr:trying']
            || ['easyocr:1detections', 'easyocr:score:' || printf('%.3f', score)])))) as steps from z)
    select doc_id, page_number, case tier when 'digital' then 'digital' when 'model' then 'ocr_api' else 'ocr_local' end as method,
    case tier when 'digital' then 'PyMuPDF' when 'first' then 'surya' when 'model' then if(by_first, 'ollama:a', 'gemini') else 'easyocr' end as engine, len(b)::int as blocks, score as confidence_score,
    array_to_string(steps, ',') as steps from l"""


@query(_CASCADE)
def recognition_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole page pipeline: digital pages, pages that the first engine reads, some of them in the wrong script, and what the others make of the rest."""
    c = table(spark, sf_dir, "conversations")
    none = F.array().cast("array<array<array<string>>>")
    pages = c.select(
        F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("page_number"), F.when(F.col("role") == "user", F.col("text")).otherwise("").alias("text"),
        F.col("text").cast("binary").alias("image"), none.alias("tables"), F.array().cast("array<struct<width:int,height:int>>").alias("images"),
    )
    engines = Engines(_primary, _quick, _first_model, _full, model_name="ollama:a", more_models=(("gemini", _second_model),), attempts=1)
    out = process_pages(pages, engines)
    return out.select("doc_id", "page_number", "method", "engine", F.size("blocks").alias("blocks"), "confidence_score", F.array_join("steps", ",").alias("steps"))


#: Runs over conversations: the second has no turns after the second one of every third, and none at all of every fifth; of all others it has nothing to say.
_SECOND = "(doc_id::bigint % 3 = 0 or doc_id::bigint % 5 = 0)"


def _two_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages of a first run, pages of a second, and the documents of the second."""
    first = _turns(spark, sf_dir)
    key = F.col("doc_id").cast("long")
    again = first.filter((key % 3 == 0) | (key % 5 == 0))
    second = again.filter((key % 5 != 0) & (F.col("page_number") <= 2)).withColumn("engine", F.lit("easyocr"))
    return first, second, again.select("doc_id").distinct()


_RUNS = f"r as (select doc_id, page_number, if({_SECOND}, 'easyocr', engine) as engine, full_text from ({_TURNS}) where not {_SECOND} or (doc_id::bigint % 5 <> 0 and page_number <= 2))"


@query(
    f"""with {_RUNS} select 'page json' as name, doc_id, page_number, engine, md5(full_text) as md5 from r union all select 'page rows', doc_id, page_number, engine, md5(full_text) from r
    union all select 'folded rows', doc_id, page_number, engine, md5(full_text) from r
    union all select 'texts', doc_id, null, if(count(distinct engine) > 1, 'mixed', replace(min(engine), 'ollama:x', 'ollama')), md5(string_agg(full_text, chr(10) || chr(10) order by page_number)) from r group by doc_id"""
)
def replaced_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs written to every table of pages: the second has fewer pages of some documents and none of others."""
    at = scratch_path(spark, "runs")
    first, second, documents = _two_runs(spark, sf_dir)
    for pages, ids in ((first, None), (second, documents)):
        sinks.write_page_json(pages, f"{at}/json", ids, 8)
        sinks.write_texts(pages, f"{at}/texts", ids)
    sinks.write_page_rows(first, f"{at}/rows")
    sinks.write_page_rows(second, f"{at}/rows", documents)
    for n, (pages, ids) in enumerate(((first, first.select("doc_id").distinct()), (second, documents))):
        sinks.write_page_rows(pages, f"{at}/runs", ids, str(n))
        sinks.write_page_rows(pages, f"{at}/folded", ids, str(n))
    sinks.fold_page_rows(spark, f"{at}/folded")
    shown = lambda df, name: df.select(F.lit(name).alias("name"), "doc_id", "page_number", "engine", _md5("full_text").alias("md5"))
    texts = store.current(spark, f"{at}/texts", form="json").select(F.lit("texts").alias("name"), "doc_id", F.lit(None).cast("int").alias("page_number"), F.col("output_engine_tag").alias("engine"), _md5("text").alias("md5"))
    same = sinks.read_page_rows(spark, f"{at}/rows").exceptAll(sinks.read_page_rows(spark, f"{at}/runs"))  # none: at once or by runs is the same
    out = shown(files.read_page_json(spark, f"{at}/json"), "page json").unionAll(shown(sinks.read_page_rows(spark, f"{at}/runs"), "page rows"))
    return out.unionAll(shown(sinks.read_page_rows(spark, f"{at}/folded"), "folded rows")).unionAll(texts).unionAll(shown(same, "differs"))


@query(
    """with c as (select text, length(text) as n from conversations), a as (select n, n % 3 = 0 as fails, n % 2 = 0 as empty from c)
    select 'ollama:a' as engine, sum(if(fails, 2, 1))::bigint as calls, coalesce(sum(if(fails or empty, 0, n)), 0)::bigint as tokens, coalesce(sum(if(fails, 2, 0)), 0)::bigint as errors from a
    union all select 'gemini', count(*), sum(n)::bigint, 0 from a where fails or empty"""
)
def logged_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cascade with two models, of which the first fails on some pages and is asked again, and says nothing of others, logs of its calls."""
    from .cascade import Answer, call_log, recognise

    def first(image: bytes) -> str:
        text = image.decode()
        if len(text) % 3 == 0:
            raise ValueError("busy")
        return "" if len(text) % 2 == 0 else Answer("an answer that is long enough to be of use", len(text))

    def second(image: bytes) -> str:
        return Answer("another answer that is long enough to be of use", len(image.decode()))

    pages = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").cast("binary").alias("image"))
    out = recognise(pages, Engines(model=first, model_name="ollama:a", more_models=(("gemini", second),), delay=0.0))
    return documents.call_stats(call_log(out.withColumnsRenamed({"conv_id": "doc_id", "turn": "page_number"})))


_SILENCE, _LATE = 8 * 86_400_000, 86_400_000
_EVENT = "case event_type when 'signup' then 'submitted' when 'click' then 'started' when 'view' then 'page' when 'purchase' then 'finished' else if(event_id % 2 = 0, 'canceled', 'failed') end"


@query(
    f"""with recursive v as (select user_id || '/' || (event_id % 12) as doc_id, epoch_us(ts) as us, event_id as seq, {_EVENT} as event, (event_id % 50)::int as page from events),
    e as (select *, row_number() over (partition by doc_id order by us, seq) as rn from v),
    s as (select doc_id, 0::bigint as rn, null::varchar as status, 0 as page, 0 as total, null::bigint as started, null::varchar as message, null::bigint as heard from (select distinct doc_id from e)
        union all select doc_id, rn, case when st is null then if(event = 'submitted', 'pending', null) when st = 'pending' and event = 'started' then 'processing' when st in ('pending', 'processing') and event = 'canceled' then 'failed'
            when st = 'processing' and event = 'finished' then 'done' when st = 'processing' and event = 'failed' then 'failed' else st end,
        case when st = 'processing' and event = 'page' then greatest(page, own) when st = 'processing' and event = 'finished' then 50 else page end,
        if(st = 'processing' and event in ('page', 'finished'), 50, total), if(st = 'pending' and event = 'started', us, started),
        case when st in ('pending', 'processing') and event = 'canceled' then 'Canceled by user' when st = 'processing' and event = 'failed' then 'm' || seq else msg end,
        case when st is null and event <> 'submitted' then null when st in ('done', 'failed') then at1 else us end
        from (select *, if(silent, 'failed', was) as st, if(silent, 'No progress', said) as msg, if(silent, heard + {_SILENCE}000, heard) as at1
            from (select e.doc_id, e.rn, e.us, e.seq, e.event, e.page as own, s.page, s.total, s.started, s.status as was, s.message as said, s.heard,
                coalesce(s.status in ('pending', 'processing') and e.us - s.heard > {_SILENCE}000, false) as silent from s join e on e.doc_id = s.doc_id and e.rn = s.rn + 1))),
    l as (select doc_id, unnest(arg_max(struct_pack(status := status, page := page, total := total, started := started, message := message, heard := heard), rn)) from s group by doc_id), w as (select max(us) // 1000 - {_LATE} as mark from v),
    x as (select *, status in ('pending', 'processing') and heard // 1000 + {_SILENCE} + 1 <= mark as silent from l, w where status is not null)
    select doc_id, if(silent, 'failed', status) as status, page as current_page, total as total_pages, started, case when silent then heard + {_SILENCE}000 when status in ('done', 'failed') then heard end as ended, if(silent, 'No progress', message) as error_msg from x"""
)
def job_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by a state machine over a stream of their events, with cancellations as a second one, that stops when it has read all: the last state of each."""
    from ..streaming import jobs as machine

    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    machine.with_state_store(spark)
    us = F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.col("ts").cast("timestamp_ntz"))
    event = F.expr(_EVENT)
    some = lambda x: F.when(F.col("event").isin("page", "finished"), x).cast("int")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema

    def stream(canceled: bool) -> DataFrame:
        e = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet").withColumn("event", event)
        e = e.filter(F.col("event") == "canceled" if canceled else F.col("event") != "canceled")
        doc = F.concat(F.col("user_id").cast("string"), F.lit("/"), (F.col("event_id") % 12).cast("string"))
        message = F.when(F.col("event") == "failed", F.concat(F.lit("m"), F.col("event_id").cast("string")))
        return e.select(doc.alias("doc_id"), "event", F.timestamp_micros(us).alias("at"), F.col("event_id").alias("seq"), some(F.col("event_id") % 50).alias("page"), some(F.lit(50)).alias("total"), message.alias("message"))

    at = scratch_path(spark, "job-stream")
    try:
        states = machine.job_states(stream(False).unionByName(stream(True)), f"{_SILENCE} milliseconds", f"{_LATE} milliseconds", "3650 days")
        machine.write_states(states, f"{at}/states", f"{at}/checkpoint").awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    last = machine.last_states(spark, f"{at}/states")
    return last.select("doc_id", "status", "current_page", "total_pages", F.unix_micros("started_at").alias("started"), F.when(F.col("status").isin("done", "failed"), F.unix_micros("updated_at")).alias("ended"), "error_msg")


@query(
    """with s as (select conv_id, turn, text, count(*) over (partition by conv_id) as n, row_number() over (partition by conv_id order by turn) as i from conversations)
    select conv_id::varchar as doc_id, i::int as page_number, md5(text) as md5, null as error from s where conv_id % 5 <> 0 and not (conv_id % 3 = 0 and i = 4)
    union all select conv_id::varchar, null, null, 'page 4: OSError: torn' from s where conv_id % 5 <> 0 and conv_id % 3 = 0 and i = 4
    union all select distinct conv_id::varchar, null, null, 'ValueError: no document' from s where conv_id % 5 = 0"""
)
def paged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of two pages a task: some can't be counted, and of some the fourth page breaks, so that all others are there."""
    from ..sources import paged

    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("doc_id")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("turn", "text")))).alias("json"))
    bad = F.when(F.col("doc_id").cast("long") % 5 == 0, "").otherwise(F.concat("doc_id", F.lit(":"), "json"))
    docs = c.select("doc_id", F.concat(F.lit("mem:/"), "doc_id").alias("path"), bad.cast("binary").alias("content"))

    def parts(content: bytes) -> tuple[int, list]:
        doc, _, rest = content.decode().partition(":")
        if not rest:
            raise ValueError("no document")
        return int(doc), json.loads(rest)

    def decode(content: bytes, first: int, last: int):
        doc, pages = parts(content)
        for n, page in enumerate(pages[first - 1 : last], first):
            if doc % 3 == 0 and n == 4:
                raise OSError("torn")
            yield {"text": page["text"]}

    out = paged.read_pages(docs, lambda content: len(parts(content)[1]), decode, 2)
    return out.select("doc_id", "page_number", _md5("text").alias("md5"), "error")


@query(
    f"""with p as ({_TURNS}), v as (select *, page_number % 3 = 1 or (page_number % 3 = 0 and doc_id::bigint % 2 = 1) as verified, round(confidence_score, 4) as score from p),
    r as (select *, case when confidence_score >= 0.85 and verified then 'gold' when confidence_score >= 0.65 then 'silver' else 'bronze' end as tier, len({tokens('full_text')}) as words from v)
    select k as kind, name, records::bigint as records, words::bigint as words, chars::bigint as chars, confidence from (
        select 'tier' as k, tier as name, count(*) as records, null as words, null as chars, null::double as confidence from r group by tier union all select 'domain', domain, count(*), null, null, null from r group by domain
        union all select 'engine', engine, count(*), null, null, null from r group by engine union all select 'total', null, count(*), sum(words), sum(length(full_text)), {rounded('sum((score * 10000)::bigint) / 10000 / count(*)')} from r)"""
)
def verified_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics that follow three runs of verdicts by deltas, one of them made again, and a late one that counts for nothing; pages aren't read."""
    at = scratch_path(spark, "cells")
    pages = corpus.measured(_turns(spark, sf_dir)).drop("full_text")
    corpus.corpus_records(pages).write.parquet(f"{at}/corpus")
    records = spark.read.parquet(f"{at}/corpus")
    sinks.write_cells(records, at)
    key, n = records.select("doc_id", "page_number"), F.col("page_number")
    odd = F.col("doc_id").cast("long") % 2 == 1
    when = lambda s: F.timestamp_seconds(F.lit(s)).alias("at")
    first = key.select("*", (n % 3 != 1).alias("verified"), when(2))
    last = key.select("*", ((n % 3 == 1) | ((n % 3 == 0) & odd)).alias("verified"), when(3))
    late = key.select("*", (n % 2 == 0).alias("verified"), when(1))
    for run, verdicts in (("1", first), ("2", last), ("2", last), ("3", late)):
        sinks.append_verdicts(records, verdicts, f"{at}/votes", at, run)
    s = sinks.read_stats(spark, at)
    entries = lambda k: F.transform(F.map_entries(f"by_{k}"), lambda e: F.struct(F.lit(k).alias("kind"), e["key"].alias("name"), e["value"].alias("records")))
    each = F.explode(F.flatten(F.array(*map(entries, ("tier", "domain", "engine")))))
    none = lambda kind: F.lit(None).cast(kind)
    named = s.select(each.alias("e")).select("e.*", none("long").alias("words"), none("long").alias("chars"), none("double").alias("confidence"))
    return named.unionAll(s.select(F.lit("total"), none("string"), "total_records", "total_words", "total_chars", "avg_confidence"))


@query(
    """with d as (select o_orderkey as doc_id, if(o_custkey % 4 = 0, 0, o_custkey % 9 * 250000) as total from orders), p as (select l_orderkey as doc_id, if(l_linenumber % 2 = 0, l_linenumber * 100000, l_linenumber) as p from lineitem),
    n as (select doc_id, count(*) as n from p group by doc_id), e as (select d.doc_id, if(total > 0, total, coalesce(n, 0))::bigint as expected_pages from d left join n on d.doc_id = n.doc_id),
    h as (select distinct e.doc_id, expected_pages, p from e join p on e.doc_id = p.doc_id where p <= expected_pages), c as (select * from h union all select doc_id, expected_pages, expected_pages + 1 from e),
    g as (select *, coalesce(lag(p) over (partition by doc_id order by p), 0) as before from c)
    select doc_id, expected_pages, count(*) - 1 as present, (expected_pages - count(*) + 1)::bigint as missing, coalesce(string_agg(if(p - before > 1, (before + 1) || '-' || (p - 1), null), ',' order by p), '') as ranges from g group by doc_id, expected_pages"""
)
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of missing pages of documents of up to two million pages."""
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_custkey") % 4 == 0, 0).otherwise(F.col("o_custkey") % 9 * 250_000).alias("total_pages"))
    n = F.col("l_linenumber")
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(n % 2 == 0, n * 100_000).otherwise(n).alias("page_number"))
    line = F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["first"].cast("string"), r["last"].cast("string"))), ",")
    return documents.missing_ranges(d, p).withColumn("ranges", line)


@query(
    """with w as (select distinct unnest(regexp_split_to_array(text, '[ \\x09-\\x0d]+')) as name from documents), p as (select distinct substring(x, 1, 1 + length(x) % 5) as prefix from (select unnest(regexp_split_to_array(text, '[ \\x09-\\x0d]+')) as x from benchmark) where x <> '')
    select prefix, count(*) as names, min(name) as first from w join p on starts_with(name, prefix) group by prefix"""
)
def prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents by beginnings of words of the benchmark."""
    words = lambda name: table(spark, sf_dir, name).select(F.explode(F.split("text", r"[ \x09-\x0d]+")).alias("name")).distinct()
    prefixes = words("benchmark").filter("name <> ''").select(F.substr("name", F.lit(1), 1 + F.length("name") % 5).alias("prefix")).distinct()
    return documents.by_prefix(words("documents"), prefixes).groupBy("prefix").agg(F.count("*").alias("names"), F.min("name").alias("first"))


@query(f"select 'j' || o_orderkey as job_id, {_STATUS} as status, c_name as doc_id from orders join customer on o_custkey = c_custkey where c_nationkey = 7 and o_orderkey % 2 = 1")
def user_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs of one user, and of these each that is asked for by its id."""
    jobs_ = _jobs(spark, sf_dir)
    out = jobs.job_status(jobs_, _documents(spark, sf_dir), job_id=F.when(F.substring("job_id", 2, 20).cast("long") % 2 == 1, F.col("job_id")), user_id="7")
    return out.select("job_id", "status", "document.doc_id")


@query(
    """with w as (select distinct x as word from (select unnest(regexp_split_to_array(text, '[ \\x09-\\x0d]+')) as x from benchmark) where length(x) > 3)
    select doc_id, count(word) as hits from documents left join w on contains(text, word) group by doc_id"""
)
def dictionary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of the benchmark occur in each document, also within others."""
    from ..operators import dictionary

    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"[ \x09-\x0d]+")).alias("word")).filter(F.length("word") > 3)
    return dictionary.hit_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), words).select("doc_id", "hits")
