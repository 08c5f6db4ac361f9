"""Queries over the driver's tables, one or more for each operator, and the same in DuckDB's SQL.

documents stand for pages of digital text (domain = source, engine = lang), labels for verifications, conversations for documents of pages (turns), orders and
lineitem for documents, jobs and pages, events for logs. Texts have no Bangla, so the operators for it run over texts transliterated character by character.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import correct as C
from ..functions import text as T
from ..functions.validate import corrupted_font, validate
from ..operators import blocks as B
from ..operators import corpus, documents, jobs, lexicon
from ..operators import score as S
from ..sources.scratch import scratch_path, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Letters and what they become in transliterated texts: Bangla letters, signs, the virama and digits; and Devanagari.
LATIN, BENGALI = "abcdefghijklmnoprstuvwyz", "াবচদেফগহিজকলমনোপরসতুভওয়য"
NAGARI = "अबचदएफगहइजकलमनओपरसतउभऊक्ज"[:24]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages", "conversations") else df


def bangla(text: str | Column = "text") -> Column:
    return F.translate(text if isinstance(text, Column) else F.col(text), LATIN, BENGALI)


# Fragments of SQL that stand for the expressions of functions.text.
_WS = r"\x09-\x0d\x1c-\x20\x{85}\p{Z}"
_BN = "ঀ-৿"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def strip(x: str) -> str:
    return sub(x, rf"\A[{_WS}]+|[{_WS}]+\z")


def number(x: str, cls: str) -> str:
    return f"length({sub(x, f'[^{cls}]+')})"


def matches(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def share(x: str, cls: str) -> str:
    within = "length(" + sub(x, r"[^\p{L}]+|[^" + cls + "]") + ")"
    return f"(case when {number(x, r'\p{L}')} > 0 then {within} / {number(x, r'\p{L}')} else 0 end)"


def per_char(count: str, x: str) -> str:
    return f"(case when length({x}) > 0 then {count} / length({x}) else 0 end)"


def rounded(x: str, places: int = 4) -> str:
    return f"printf('%.{places}f', ({x})::double)::double"


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(f'[{_WS}]+')}), lambda w: w <> '')"


def tag(ratio: str) -> str:
    return f"case when {ratio} > 0.5 then 'bn' when {ratio} > 0.1 then 'mixed' else 'en' end"


def entropy(x: str) -> str:
    return f"coalesce((select -sum(n / length({x}) * log2(n / length({x}))) from (select c, count(*) n from (select unnest(string_split({x}, '')) c) where c <> '' group by c)), 0)"


_NOISE = r"\p{L}\p{N}" + _WS + "".join(f"\\{c}" for c in T.PUNCTUATION)
_SQL_BN = f"translate(text, {q(LATIN)}, {q(BENGALI)})"
symbols = lambda x: per_char(f"length({sub(x, f'[{_NOISE}]+')})", x)
brackets = lambda x: per_char(number(x, r"{}\[\]<>"), x)
controls = lambda x: per_char(number(x, r"\x01-\x08\x0b\x0c\x0e-\x1f"), x)
cids = lambda x: matches(x, r"\(cid:\p{Nd}+\)")


@query(f"select doc_id, case when length({strip('text')}) >= 30 then 'digital' else 'scanned' end as page_type from documents")
def page_type_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.page_type("text").alias("page_type"))


@query(
    f"""with t as (select doc_id, text, {_SQL_BN} as bn, translate(text, {q(LATIN)}, {q(NAGARI)}) as dn from documents)
    select doc_id, {rounded(share('text', 'A-Za-z'), 6)} as ascii, {rounded(share('bn', _BN), 6)} as bangla, {rounded(share('dn', 'ऀ-ॿ'), 6)} as devanagari,
    {rounded(controls('text'), 6)} as control, {rounded(brackets('text'), 6)} as brackets, {rounded(symbols('text'), 6)} as symbols, {tag(share('bn', _BN))} as language,
    {number('dn', r'\p{L}')} >= 12 and {share('dn', 'ऀ-ॿ')} >= 0.16 and {share('dn', _BN)} < 0.1 as wrong_script from t"""
)
def script_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", "text", bangla().alias("bn"), F.translate("text", LATIN, NAGARI).alias("dn"))
    six = lambda x: T.rounded(x, 6)
    return t.select(
        "doc_id", six(T.ascii_ratio("text")).alias("ascii"), six(T.bangla_ratio("bn")).alias("bangla"), six(T.devanagari_ratio("dn")).alias("devanagari"),
        six(T.control_ratio("text")).alias("control"), six(T.bracket_density("text")).alias("brackets"), six(T.symbol_noise("text")).alias("symbols"),
        T.language_tag("bn").alias("language"), T.wrong_script("dn").alias("wrong_script"),
    )


_CORRUPT = f"({controls('text')} > 0.05 or {number('text', T.LEGACY_FONT)} >= 3 or {cids('text')} >= 3 or {brackets('text')} > 0.05 or ({symbols('text')} > 0.12 and {share('text', _BN)} < 0.05))"


@query(f"select doc_id, {number('text', T.SUSPICIOUS)} as suspicious, {number('text', T.LEGACY_FONT)} as legacy, {cids('text')} as cids, {_CORRUPT} as corrupted from documents")
def glyph_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    long = lambda x: x.cast("long")
    return d.select("doc_id", long(T.suspicious_glyphs("text")).alias("suspicious"), long(T.legacy_glyphs("text")).alias("legacy"), long(T.cid_references("text")).alias("cids"), corrupted_font("text").alias("corrupted"))


def _validation_sql(x: str) -> str:
    legacy = f"""(length({x}) >= 200 and (case when {matches(x, f'[{_BN}]+[a-zA-Z]+[{_BN}]*')} >= 3 then 2 else 0 end + case when regexp_matches({x}, {q(f'[{_BN}]+@|@[{_BN}]')}) then 2 else 0 end
        + case when regexp_matches({x}, {q('[\\p{Nd}]+\\[[\\p{Nd}]+\\][\\p{Nd}]+')}) then 2 else 0 end + case when length({x}) > 500 and {share(x, _BN)} < 0.15 then 1 else 0 end
        + case when {number(x, T.LEGACY_FONT)} >= 2 then 1 else 0 end) >= 3)"""
    reasons = f"""list_filter([case when {controls(x)} > 0.05 then 'control_characters' end, case when {number(x, T.LEGACY_FONT)} >= 3 then 'winansa_artifacts' end,
        case when {cids(x)} >= 3 then 'cid_references' end, case when {brackets(x)} > 0.05 then 'bracket_density' end,
        case when {symbols(x)} > 0.12 and {share(x, _BN)} < 0.05 then 'symbol_noise' end, case when {number(x, T.SUSPICIOUS)} >= 5 then 'suspicious_glyphs' end,
        case when length({x}) > 100 and entropy < 2.0 then 'low_entropy' end, case when regexp_matches({x}, {q('(?:^|[^\\p{L}\\p{N}])\\p{M}')}) then 'invalid_combining' end], lambda r: r is not null)"""
    return f"""with e as (select doc_id, {x}, {entropy(x)} as entropy from t), v as (select *, {legacy} as bijoy, {reasons} as reasons from e)
        select doc_id, bijoy as bijoy_detected, if(bijoy, null, {rounded(share(x, _BN))}) as bangla_char_ratio, if(bijoy, null, {rounded('entropy')}) as entropy,
        if(bijoy, null, {rounded(symbols(x))}) as symbol_noise_ratio, not bijoy and len(reasons) = 0 as is_valid, array_to_string(if(bijoy, ['bijoy_encoding'], reasons), ',') as reasons from v"""


def _validated(t: DataFrame) -> DataFrame:
    v = t.select("doc_id", validate("text").alias("v"))
    return v.select("doc_id", "v.bijoy_detected", "v.bangla_char_ratio", "v.entropy", "v.symbol_noise_ratio", "v.is_valid", F.array_join("v.rejection_reasons", ",").alias("reasons"))


@query(_validation_sql("text").replace("with e as", "with t as (select doc_id, text from documents), e as", 1))
def digital_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(table(spark, sf_dir, "documents"))


@query(_validation_sql("text").replace("with e as", f"with t as (select doc_id, translate(text, {q(LATIN[:12])}, {q(BENGALI[:12])}) as text from documents), e as", 1))
def digital_validation_bangla(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the letters become Bangla: words of both scripts, as of a legacy font."""
    return _validated(table(spark, sf_dir, "documents").select("doc_id", F.translate("text", LATIN[:12], BENGALI[:12]).alias("text")))


@query(f"with r as (select unnest(string_split(reasons, ',')) as reason from ({SQL['digital_validation']}) where reasons <> '') select reason, count(*) as pages from r group by reason")
def rejection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "documents").select(F.explode(validate("text")["rejection_reasons"]).alias("reason"))
    return v.groupBy("reason").agg(F.count("*").alias("pages"))


@query(f"select doc_id, {rounded(entropy('text'), 6)} as entropy from documents")
def char_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.rounded(T.entropy("text"), 6).alias("entropy"))


@query(f"select doc_id, {rounded(f'greatest(0.0, 1 - 0.05 * {matches("text", "[OoIlSsBGZ][0-9]|[0-9][OoIlSsBGZ]")})')} as numeric from documents")
def numeric_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.rounded(T.numeric_consistency("text")).alias("numeric"))


_CLEAN = strip(sub(sub(sub("text", r"\(cid:\p{Nd}+\)|[\x00-\x08\x0b\x0c\x0e-\x1f]"), r"[ \t]+", " "), r"\n{3,}", "\n\n"))


@query(f"select doc_id, length({_CLEAN}) as n, md5({_CLEAN}) as md5 from documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "documents").select("doc_id", C.clean_text("text").alias("c"))
    return c.select("doc_id", F.length("c").cast("long").alias("n"), F.md5(F.col("c").cast("binary")).alias("md5"))


@query(
    f"""with l as (select page_id, list_filter(list_transform(string_split(html, chr(10)), lambda x: {strip(sub('x', '<[^>]+>'))}), lambda x: x <> '' and upper(x) not in ('HERE', 'SEAL', 'COPY', 'STAMP')) as lines from pages)
    select page_id, len(lines) as lines, md5(coalesce(array_to_string(lines, chr(10)), '')) as md5 from l"""
)
def html_strip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "pages").select("page_id", C.clean_lines(F.split("html", "\n", -1)).alias("c"))
    return c.select("page_id", F.when(F.col("c") == "", 0).otherwise(F.size(F.split("c", "\n", -1))).cast("long").alias("lines"), F.md5(F.col("c").cast("binary")).alias("md5"))


_PARTS = f"list_filter(list_transform(string_split(text, if(contains(text, chr(10) || chr(10)), chr(10) || chr(10), chr(10))), lambda p: {strip('p')}), lambda p: p <> '')"


@query(
    f"""with p as (select doc_id, generate_subscripts(b, 1) as block_id, unnest(b) as t from (select doc_id, {_PARTS} as b from documents))
    select doc_id, block_id, length(t) as chars, md5(t) as md5, {tag(share('t', _BN))} as language from p"""
)
def paragraph_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "documents").select("doc_id", F.explode(B.paragraphs("text")).alias("b"))
    return b.select("doc_id", F.col("b.block_id").cast("long").alias("block_id"), F.length("b.text").cast("long").alias("chars"), F.md5(F.col("b.text").cast("binary")).alias("md5"), "b.language")


@query(
    f"""with p as (select conv_id, turn, list_filter(regexp_split_to_array(array_to_string(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), chr(10)), '\\n\\n+'), lambda r: r <> '') as r from conversations)
    select conv_id, turn, len(r) as blocks, md5(coalesce(array_to_string(list_transform(r, lambda x: {sub('x', chr(92) + 'A' + chr(92) + 'n+|' + chr(92) + 'n+' + chr(92) + 'z')}), '|'), '')) as md5 from p"""
)
def line_run_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "conversations").select("conv_id", "turn", B.grouped_lines("text").alias("b"))
    return b.select("conv_id", "turn", F.size("b").cast("long").alias("blocks"), F.md5(F.array_join(F.transform("b", lambda x: x["text"]), "|").cast("binary")).alias("md5"))


_SCORE = f"""case when len(b) = 0 then 0.0 else 0.35 * 0.9 + 0.10 * (1 - {share('t', _BN)}) + 0.20 * 0.8 + 0.15 * greatest(0.0, 1 - {number('t', T.SUSPICIOUS)} / greatest(0.02 * length(t), 5.0))
    + 0.10 * greatest(0.0, 1 - 0.05 * {matches('t', '[OoIlSsBGZ][0-9]|[0-9][OoIlSsBGZ]')}) + 0.10 * (1 - len(list_filter(b, lambda x: length(x) <= 1)) / len(b)) end"""


@query(f"with p as (select doc_id, {_PARTS} as b from documents), s as (select *, array_to_string(b, ' ') as t from p), c as (select doc_id, {rounded(_SCORE)} as score from s) select doc_id, score, score < 0.55 as needs_fallback from c")
def block_page_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "documents").select("doc_id", B.paragraphs("text").alias("blocks"))
    s = b.select("doc_id", S.page_score("blocks").alias("score"), S.is_bangla("blocks").alias("bn"))
    return s.select("doc_id", "score", S.needs_fallback("score", "bn").alias("needs_fallback"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their labels as pages: quality as verification, domain of the source, engine of the language."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    pages = d.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page_number"), F.col("text").alias("full_text"), F.col("lang").alias("engine"), F.col("source").alias("domain"),
        T.let(B.paragraphs("text"), lambda b: S.page_score(b)).alias("confidence_score"),
    )
    pages = corpus.measured(pages).drop("full_text")
    votes = l.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page_number"), (F.col("quality") == 1).alias("verified"), F.col("doc_id").alias("at"))
    return corpus.verify(pages, votes, "at")


_RECORDS = f"""p as (select doc_id, text, lang, source, {_PARTS} as b from documents), s as (select *, array_to_string(b, ' ') as t from p),
    c as (select doc_id, text, lang, source, {rounded(_SCORE)} as score from s),
    r as (select c.doc_id::varchar as doc_id, lang as engine, source as domain, score as confidence_score, coalesce(l.quality = 1, false) as verified,
        case when score >= 0.85 and coalesce(l.quality = 1, false) then 'gold' when score >= 0.65 then 'silver' else 'bronze' end as confidence_tier,
        {rounded(f"{number('text', _BN)} / greatest(length(text), 1)")} as language_ratio_bn, len({tokens('text')}) as word_count, length(text) as char_count
        from c left join labels l on c.doc_id = l.doc_id)"""


@query(f"with {_RECORDS} select *, 1 as page_number, false as has_table, false as has_image, '' as source_image_path from r")
def corpus_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_records(_pages(spark, sf_dir)).withColumns({c: F.col(c).cast("long") for c in ("word_count", "char_count")})


@query(
    f"""with {_RECORDS} select case when grouping(domain) = 0 then 'domain' when grouping(confidence_tier) = 0 then 'tier' when grouping(engine) = 0 then 'engine' else 'total' end as kind,
    coalesce(domain, confidence_tier, engine) as name, count(*) as records, {rounded('sum(confidence_score)', 3)} as confidence, sum(word_count)::bigint as words, sum(char_count)::bigint as chars
    from r group by grouping sets ((domain), (confidence_tier), (engine), ())"""
)
def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_counts(corpus.corpus_records(_pages(spark, sf_dir))).withColumn("confidence", T.rounded(F.col("confidence"), 3))


@query(
    f"""with {_RECORDS} select count(*) as total_records, (select string_agg(k || '=' || n, ',' order by k) from (select domain k, count(*) n from r group by 1)) as by_domain,
    (select string_agg(k || '=' || n, ',' order by k) from (select confidence_tier k, count(*) n from r group by 1)) as by_tier,
    (select string_agg(k || '=' || n, ',' order by k) from (select engine k, count(*) n from r group by 1)) as by_engine,
    {rounded('avg(confidence_score)')} as avg_confidence, sum(word_count)::bigint as total_words, sum(char_count)::bigint as total_chars from r"""
)
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = corpus.corpus_stats(corpus.corpus_records(_pages(spark, sf_dir)))
    line = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias(m)
    return out.select("total_records", line("by_domain"), line("by_tier"), line("by_engine"), "avg_confidence", "total_words", "total_chars")


@query(
    f"""with lex as (select distinct unnest({tokens('text')}) as w from benchmark), t as (select doc_id, unnest({tokens('text')}) as w from documents),
    s as (select doc_id, count(*) as n_words, count(lex.w) as hits from t left join lex on t.w = lex.w group by doc_id)
    select d.doc_id, coalesce(n_words, 0) as n_words, {rounded('case when coalesce(n_words, 0) > 0 then hits / n_words else 1 end', 6)} as validity from documents d left join s on d.doc_id = s.doc_id"""
)
def word_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(T.tokens("text")).alias("word"))
    out = lexicon.word_validity(table(spark, sf_dir, "documents"), words, "doc_id", only=None)
    return out.select("doc_id", "n_words", T.rounded(F.col("validity"), 6).alias("validity"))


@query(
    f"""with t as (select doc_id, {_SQL_BN} as text from documents), lex as (select distinct unnest({tokens(f'translate(text, {q(LATIN)}, {q(BENGALI)})')}) as w from benchmark),
    w as (select doc_id, w from (select doc_id, unnest({tokens('text')}) as w from t) where regexp_matches(w, '[{_BN}]')),
    s as (select doc_id, count(*) as n_words, count(lex.w) as hits from w left join lex on w.w = lex.w group by doc_id)
    select d.doc_id, coalesce(n_words, 0) as n_words, {rounded('case when coalesce(n_words, 0) > 0 then hits / n_words else 1 end', 6)} as validity from documents d left join s on d.doc_id = s.doc_id"""
)
def bangla_word_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only words with a Bangla character count."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(T.tokens(bangla())).alias("word"))
    out = lexicon.word_validity(table(spark, sf_dir, "documents").select("doc_id", bangla().alias("text")), words, "doc_id")
    return out.select("doc_id", "n_words", T.rounded(F.col("validity"), 6).alias("validity"))


@query(
    f"""with r as (select w as wrong, upper(w) || '+' as good from (select distinct unnest({tokens('text')}) as w from benchmark) where length(w) > 6 and not regexp_matches(w, '[।,?!;:()]+\\z')),
    w as (select doc_id, generate_subscripts(t, 1) as i, unnest(t) as w from (select doc_id, {tokens('text')} as t from documents)), b as (select *, {sub('w', '[।,?!;:()]+' + chr(92) + 'z')} as b from w),
    j as (select doc_id, string_agg(if(good is null, w, good || substring(w, length(b) + 1)), ' ' order by i) as t, count(good) as n from b left join r on b = wrong group by doc_id)
    select d.doc_id, md5(coalesce(t, '')) as md5 from documents d left join j on d.doc_id = j.doc_id"""
)
def replaced_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark replaced in documents, by a join with their table."""
    w = table(spark, sf_dir, "benchmark").select(F.explode(T.tokens("text")).alias("wrong")).distinct().filter((F.length("wrong") > 6) & ~F.col("wrong").rlike(r"[।,?!;:()]+\z"))
    out = lexicon.replace_words(table(spark, sf_dir, "documents").select("doc_id", "text"), w.select("wrong", F.concat(T.upper("wrong"), F.lit("+")).alias("right")), "doc_id")
    return out.select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"))


@query(
    """with p as (select conv_id, turn, case role when 'user' then 'surya' when 'assistant' then 'gemini' else 'ollama:x' end as engine, length(text) % 1000 / 1000.0 as c from conversations)
    select conv_id as doc_id, count(*) as pages, printf('%.6f', avg(c))::double as mean_confidence, count(*) filter (engine in ('surya', 'easyocr', 'PyMuPDF')) as pages_local,
    count(*) filter (engine like 'ollama%' or engine = 'gemini') as pages_api,
    case when count(distinct engine) > 1 then 'mixed' else replace(min(engine), 'ollama:x', 'ollama') end as output_engine_tag from p group by conv_id"""
)
def document_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = F.when(F.col("role") == "user", "surya").when(F.col("role") == "assistant", "gemini").otherwise("ollama:x")
    p = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_number"), engine.alias("engine"), (F.length("text") % 1000 / 1000).alias("confidence_score"))
    return documents.document_rollup(p).withColumn("mean_confidence", T.rounded(F.col("mean_confidence"), 6))


@query(
    f"""with t as (select conv_id, if(role = 'user', translate(text, {q(LATIN)}, {q(BENGALI)}), text) as t from conversations), l as (select conv_id, {tag(share('t', _BN))} as l from t)
    select conv_id as doc_id, concat_ws(',', if(bool_or(l in ('bn', 'mixed')), 'bn', null), if(bool_or(l in ('en', 'mixed')), 'en', null)) as languages from l group by conv_id"""
)
def document_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), T.language_tag(F.when(F.col("role") == "user", bangla()).otherwise(F.col("text"))).alias("language"))
    return documents.languages(t).select("doc_id", F.array_join("languages", ",").alias("languages"))


_ORDERS = "d as (select o_orderkey as doc_id, 7 as total_pages from orders), p as (select l_orderkey as doc_id, l_linenumber as page_number from lineitem)"


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(7).alias("total_pages"))
    return d, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_number"))


@query(f"with {_ORDERS}, e as (select doc_id, unnest(range(1, 8)) as page_number from d) select e.doc_id, e.page_number::int as page_number from e anti join p on e.doc_id = p.doc_id and e.page_number = p.page_number")
def missing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.missing_pages(*_orders(spark, sf_dir))


@query(
    f"""with {_ORDERS}, s as (select doc_id, list_sort(list(distinct page_number)) as present from p group by doc_id), m as (select d.doc_id, coalesce(present, []) as present from d left join s on d.doc_id = s.doc_id),
    x as (select *, list_filter(range(1, 8), lambda n: not list_contains(present, n)) as missing from m)
    select doc_id, 7 as expected_pages, len(present) as present, array_to_string(missing, ',') as missing, if(len(missing) > 0, 'Missing ' || len(missing), 'Complete') as status from x"""
)
def page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = documents.coverage(*_orders(spark, sf_dir))
    return out.select("doc_id", "expected_pages", F.size("present").cast("long").alias("present"), F.array_join("missing", ",").alias("missing"), "status")


_STATUS = "case o_orderstatus when 'F' then 'done' when 'O' then 'processing' else 'pending' end"


def _status() -> Column:
    return F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "processing").otherwise("pending")


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    none = F.lit(None)
    return o.select(
        F.concat(F.lit("j"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_custkey").cast("string").alias("document_id"), _status().alias("status"), none.cast("string").alias("error_msg"),
        F.col("o_orderdate").alias("started_at"), none.cast("timestamp").alias("completed_at"),
    )


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_nationkey").cast("string").alias("user_id"), F.col("c_name").alias("doc_id"), F.concat("c_name", F.lit(".pdf")).alias("filename"),
        F.lit("processing").alias("status"), F.lit("unknown").alias("domain"), F.lit(3).alias("total_pages"), F.col("c_custkey").alias("created_at"),
    )


@query(f"select 'j' || o_orderkey as job_id, c_nationkey::varchar as user_id, {_STATUS} as status, c_name as doc_id, c_name || '.pdf' as filename from orders join customer on o_custkey = c_custkey")
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.job_status(_jobs(spark, sf_dir), _documents(spark, sf_dir))
    return out.select("job_id", "user_id", "status", "document.doc_id", "document.filename")


@query(
    """with e as (select user_id, event_id, event_type from events), p as (select user_id, max(event_id) as event_id from e group by user_id),
    s as (select c_custkey, c_name, event_id, event_id % 9 as page, 5 as total from customer left join p on c_custkey = user_id)
    select c_custkey::varchar as id, c_name as doc_id, coalesce(least(100, greatest(0, round_even(page / total * 100, 0))), 0)::int as progress_percent, if(event_id is null, null, 'processing') as progress_status from s"""
)
def document_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _documents(spark, sf_dir)
    e = table(spark, sf_dir, "events")
    p = e.join(c.select(F.col("id").cast("long").alias("_u"), "doc_id"), F.col("user_id") == F.col("_u"))
    p = p.select("doc_id", (F.col("event_id") % 9).cast("int").alias("current_page"), F.lit(5).alias("total_pages"), F.lit("processing").alias("status"), F.lpad(F.col("event_id").cast("string"), 20, "0").alias("updated_at"))
    return jobs.list_documents(c, p).select("id", "doc_id", "progress_percent", "progress_status")


@query(
    """select user_id as doc_id, count(*) as total_decisions, count(*) filter (event_type not in ('error', 'purchase')) as info, count(*) filter (event_type = 'purchase') as warning,
    count(*) filter (event_type = 'error') as error, array_to_string(list_sort(list(distinct event_type)), ',') as keywords from events group by user_id"""
)
def decision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "warning")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("keyword"), severity.alias("severity"))
    return documents.decision_summary(e).withColumn("keywords", F.array_join("keywords", ","))


@query("select user_id, arg_max(event_type, event_id) as event_type, max(event_id) as event_id from events group by user_id")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return corpus.latest(e.withColumn("at", F.col("event_id")), ["user_id"], "at").select("user_id", "event_type", "event_id")


@query(f"select 'j' || o_orderkey as id, 'failed' as status, 'Canceled by user' as error_msg from orders where {_STATUS} in ('pending', 'processing')")
def cancel_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.cancel(_jobs(spark, sf_dir), F.lit(0)).select("id", "status", "error_msg")


_GONE = "select c_custkey as id from customer where c_acctbal < 0"


@query(f"with g as ({_GONE}) select 'documents' as name, count(*) as rows from customer where c_custkey not in (select id from g) union all select 'jobs', count(*) from orders where o_custkey not in (select id from g)")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").cast("string").alias("id"))
    left = jobs.delete_documents({"documents": (_documents(spark, sf_dir), "id"), "jobs": (_jobs(spark, sf_dir), "document_id")}, gone)
    count = lambda name: left[name].agg(F.lit(name).alias("name"), F.count("*").alias("rows"))
    return count("documents").unionAll(count("jobs"))


@query("select l_orderkey as document_id, l_linenumber::int as page_number, if(l_returnflag = 'R', 'second', 'first') as run from lineitem l where l_returnflag = 'R' or l_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def page_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").cast("int").alias("page_number"), "l_returnflag")
    fresh = p.filter("l_returnflag = 'R'").select("document_id", "page_number", F.lit("second").alias("run"))
    return jobs.replace_pages(p.select("document_id", "page_number", F.lit("first").alias("run")), fresh, "document_id")


@query("with s as (select page_id, regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '(.)\\.[^.]*$', '\\1') as stem from pages) select page_id, stem || '_' || md5(stem)[:8] as doc_id from s")
def doc_id_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.doc_id(T.file_stem("url")).alias("doc_id"))


@query(
    f"""with t as (select doc_id, text as a, {_CLEAN} as b from documents), z as (select doc_id, a, b, list_zip(string_split(a, ''), string_split(b, '')) as z from t)
    select doc_id, case when a = b then 0.0 else {rounded('len(list_filter(z, lambda x: x[1] is distinct from x[2])) / greatest(length(a), length(b))')} end as edit_ratio from z"""
)
def edit_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", "text", C.clean_text("text").alias("clean"))
    return t.select("doc_id", T.edit_ratio("text", "clean").alias("edit_ratio"))


@query("select p_partkey, w, h, case when w = 0 or h = 0 then 'unknown' when w / h > 0.85 and w / h < 1.15 and greatest(w, h) < 250 then 'seal' when w < 200 and h < 80 then 'signature' when w / h > 2.5 then 'table_or_chart' else 'photo' end as kind from (select p_partkey, (p_size * 13 % 400)::int as w, (p_size * 7 % 300)::int as h from part)")
def image_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 13 % 400).cast("int").alias("w"), (F.col("p_size") * 7 % 300).cast("int").alias("h"))
    return p.select("p_partkey", "w", "h", T.image_type("w", "h").alias("kind"))


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as detections: left edge by quantity, top edge by line number and discount."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("int").alias("n"), F.col("l_quantity").cast("double").alias("x"), F.floor(F.col("l_linenumber") / 2).cast("double").alias("y"), F.col("l_partkey").cast("string").alias("t"))
    point = F.array(F.struct(F.col("x"), (F.col("y") * 20).alias("y")))
    d = F.array_sort(F.collect_list(F.struct("n", "t", point.alias("points"))))
    return l.groupBy("id").agg(F.transform(d, lambda c: F.struct(c["t"].alias("text"), F.lit(0.9).alias("conf"), c["points"].alias("points"))).alias("d"))


@query(
    """with l as (select l_orderkey as id, l_linenumber as n, l_quantity as x, floor(l_linenumber / 2) * 20 as y, l_partkey::varchar as t from lineitem),
    r as (select id, y, string_agg(t, ',' order by x, n, t) as row, count(*) as w from l group by id, y),
    s as (select id, string_agg(row, ';' order by y) as rows, count(*) as n, count(distinct w) as widths, max(k) as modal from (select *, count(*) over (partition by id, w) as k from r) group by id)
    select id, if(n >= 2 and widths <= 3, rows, null) as rows, if(n >= 2 and widths <= 3, printf('%.4f', modal / n * 0.6 + 0.4)::double, 0.0) as confidence from s"""
)
def scanned_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _detections(spark, sf_dir).select("id", B.scanned_table("d").alias("r"))
    rows = F.when(F.col("r").isNotNull(), F.array_join(F.transform("r", lambda c: F.array_join(c, ",")), ";"))
    return t.select("id", rows.alias("rows"), F.coalesce(B.table_confidence("r"), F.lit(0.0)).alias("confidence"))


@query("select p_partkey, case when e like '%pymupdf%' or e like '%digital%' then 'digital' when e like '%easy%' then 'easyocr' when e like '%paddle%' then 'paddleocr' when e like '%gemini%' then 'gemini' when e like '%ollama%' then 'ollama' else 'digital' end as tag from (select p_partkey, lower(['PyMuPDF', 'EasyOCR', 'gemini', 'ollama:qwen2.5vl:7b', 'surya'][p_size % 5 + 1]) as e from part)")
def engine_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("PyMuPDF", "EasyOCR", "gemini", "ollama:qwen2.5vl:7b", "surya")))
    return table(spark, sf_dir, "part").select("p_partkey", T.engine_tag(F.get(names, (F.col("p_size") % 5).cast("int"))).alias("tag"))


_RAW = "'```json' || chr(10) || to_json({'content_blocks': 0, 'blocks': [{'text': text, 'type': role, 'confidence': 0.5}, {'text': ' '}, {'text': ' b ', 'language': 'bn'}]}) || chr(10) || '```'"


@query(
    f"""select conv_id, turn, 1 as block_id, role as type, 'en' as language, length({strip('text')}) as chars, 0.5::double as confidence from conversations where {strip('text')} <> ''
    union all select conv_id, turn, 3, 'paragraph', 'bn', 1, 0.9 from conversations"""
)
def json_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    item = lambda text, kind, lang, c: F.struct(text.alias("text"), kind.alias("type"), lang.alias("language"), c.alias("confidence"))
    real = lambda x: F.lit(x).cast("double")
    items = F.array(item(F.col("text"), F.col("role"), none, real(0.5)), item(F.lit(" "), none, none, real(None)), item(F.lit(" b "), none, F.lit("bn"), real(None)))
    raw = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.lit(0).alias("content_blocks"), items.alias("blocks"))), F.lit("\n```"))
    b = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(B.model_blocks(raw)).alias("b"))
    return b.select("conv_id", "turn", "b.block_id", "b.type", "b.language", F.length("b.text").cast("long").alias("chars"), "b.confidence")


def _correct(x: str) -> str:
    """Stages of unicode, combining marks, vowel signs and the virama."""
    a = sub(sub(f"nfc_normalize({x})", r"[\x{200b}-\x{200f}\x{feff}\x{ad}]"), r"(^|[^\p{L}\p{N}\p{M}])\p{M}+", "\\1")
    signs = a
    for c in range(0x09BE, 0x09CD):
        signs = sub(signs, f"{chr(c)}{{2,}}", chr(c))
    return sub(sub(f"replace({signs}, '্্', '্')", rf"([{_WS}])্", "\\1"), r"\A্")


@query(f"with t as (select doc_id, {_SQL_BN} as t from documents), c as (select doc_id, t, {_correct('t')} as c from t) select doc_id, length(c) as n, md5(c) as md5, c <> t as changed from c")
def correct_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", bangla().alias("t")).select("doc_id", "t", C.correct("t", "surya", log=False).alias("c"))
    return t.select("doc_id", F.length("c.text").cast("long").alias("n"), F.md5(F.col("c.text").cast("binary")).alias("md5"), (F.col("c.text") != F.col("t")).alias("changed"))


@query(
    f"""with t as (select doc_id, translate(text, {q(LATIN + '02468')}, {q(BENGALI + '০২৪৬৮')}) as t from documents),
    w as (select doc_id, t, {share('t', _BN)} as s, regexp_extract_all(t, {q(f'[{_WS}]+|[^{_WS}]+')}) as p from t),
    f as (select doc_id, if(s < 0.3, t, coalesce(array_to_string(list_transform(p, lambda x: if(regexp_matches(x, '[0-9]') and regexp_matches(x, '[০-৯]'), translate(x, '0123456789', '০১২৩৪৫৬৭৮৯'), x)), ''), '')) as f from w)
    select doc_id, md5(f) as md5, {number('f', '0-9')} as ascii_digits from f"""
)
def fix_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", F.translate("text", LATIN + "02468", BENGALI + "০২৪৬৮").alias("t")).select("doc_id", C.fix_digits("t").alias("f"))
    return t.select("doc_id", F.md5(F.col("f").cast("binary")).alias("md5"), T.count_of("f", "0-9").cast("long").alias("ascii_digits"))


@query(
    f"""with t as (select doc_id, list_transform(string_split(text, chr(10)), lambda x: if(length(x) % 2 = 0, translate(x, {q(LATIN)}, {q(NAGARI)}), x)) as l from documents),
    k as (select doc_id, list_filter(if(l[-1] = '', l[:-2], l), lambda x: {strip('x')} = '' or not ({number('x', r'\p{L}')} >= 12 and {share('x', 'ऀ-ॿ')} >= 0.1 and {share('x', _BN)} < 0.35)) as k from t)
    select doc_id, len(k) as lines, md5(coalesce(array_to_string(k, chr(10)), '')) as md5 from k"""
)
def drop_devanagari(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.array_join(F.transform(F.split("text", "\n", -1), lambda x: F.when(F.length(x) % 2 == 0, F.translate(x, LATIN, NAGARI)).otherwise(x)), "\n")
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", C.drop_devanagari_lines("t").alias("k"))
    return d.select("doc_id", F.when(F.col("k") == "", 0).otherwise(F.size(F.split("k", "\n", -1))).cast("long").alias("lines"), F.md5(F.col("k").cast("binary")).alias("md5"))


#: Other letters and marks than ASCII's as one letter that no number has, and one mark: RE2's word boundary knows ASCII only.
_SHADOW = "array_to_string(list_transform(string_split(text, ''), lambda c: if(c > chr(127), if(regexp_matches(c, '[\\p{L}\\p{N}]'), 'q', '~'), c)), '')"
_FIXED = f"if(contains(m, '.') and regexp_matches(m, '[A-Za-z]'), m, translate(m, {q(C.LOOK_ALIKES)}, {q(C.THEIR_DIGITS)}))"


@query(
    f"""with s as (select doc_id, coalesce(text, '') as text, coalesce({_SHADOW}, '') as s from documents),
    m as (select doc_id, text, length(s) as n, regexp_extract_all(s, {q(chr(92) + 'b[0-9OolISsBGZ]+[.,0-9]*' + chr(92) + 'b')}) as m, regexp_split_to_array(s, {q(chr(92) + 'b[0-9OolISsBGZ]+[.,0-9]*' + chr(92) + 'b')}) as g from s),
    p as (select doc_id, text, unnest(m) as m, generate_subscripts(m, 1) as i, list_sum(list_transform(g, lambda x: length(x))[:generate_subscripts(m, 1)]) + coalesce(list_sum(list_transform(m, lambda x: length(x))[:generate_subscripts(m, 1) - 1]), 0) as start from m),
    e as (select doc_id, text, i, m, start, lag(start + length(m), 1, 0) over (partition by doc_id order by i) as was, {_FIXED} as f from p),
    j as (select doc_id, string_agg(substring(text, (was + 1)::int, (start - was)::int) || f, '' order by i) || substring(any_value(text), (max(start + length(m)) + 1)::int) as fixed, count(*) filter (f <> m) as changes from e group by doc_id)
    select s.doc_id, coalesce(changes, 0)::int as changes, md5(coalesce(fixed, s.text)) as md5 from s left join j on s.doc_id = j.doc_id"""
)
def fix_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with look-alike letters."""
    f = table(spark, sf_dir, "documents").select("doc_id", C.fix_numbers("text").alias("f"))
    return f.select("doc_id", F.size("f.discrepancies").alias("changes"), F.md5(F.col("f.text").cast("binary")).alias("md5"))


def _edit_sql(a: str, b: str) -> str:
    return f"case when {a} = {b} then 0.0 else {rounded(f'len(list_filter(list_zip(string_split({a}, {chr(39) * 2}), string_split({b}, {chr(39) * 2})), lambda x: x[1] is distinct from x[2])) / greatest(length({a}), length({b}))')} end"


_UNICODE = sub(sub("nfc_normalize(t)", r"[\x{200b}-\x{200f}\x{feff}\x{ad}]"), r"(^|[^\p{L}\p{N}\p{M}])\p{M}+", "\\1")
_VOWELS = "case " + " ".join(f"when bare = {q(w)} then {q(r)}" for w, r in C.VOWEL_FIXES.items()) + " end"
_LETTERED = f"translate(text, {q(LATIN + C.ASCII_DIGITS)}, {q(BENGALI + C.BANGLA_DIGITS)})"


@query(
    f"""with t as (select doc_id, {_SQL_BN} as t from documents), a as (select doc_id, t, {_UNICODE} as a, {_correct('t')} as c from t),
    w as (select doc_id, t, a, c, list_transform({tokens('c')}, lambda w: [w, {sub('w', '[।,?!;:()]+' + chr(92) + 'z')}]) as w from a),
    f as (select doc_id, t, a, c, w, list_transform(w, lambda x: coalesce({_VOWELS.replace('bare', 'x[2]')} || substring(x[1], length(x[2]) + 1), x[1])) as f from w),
    d as (select *, coalesce(array_to_string(f, ' '), '') as d, list_transform(w, lambda x: x[1]) <> f as restored from f)
    select doc_id, length(d) as n, concat_ws(',', if(a <> t, 'unicode_normalization', null), if(c <> a, 'pattern_correction', null), if(restored, 'ollama_matra_restoration', null)) as corrections,
    {_edit_sql('t', 'd')} as edit_distance from d"""
)
def restore_vowels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "documents").select("doc_id", bangla().alias("t")).select("doc_id", C.correct("t", "ollama").alias("c"))
    return c.select("doc_id", F.length("c.text").cast("long").alias("n"), F.array_join("c.corrections", ",").alias("corrections"), "c.edit_distance")


def _artifacts(x: str) -> str:
    """Marks, years and words of stage F; what the next match needs of a match is looked at in a second pass."""
    out = sub(x, rf"\|([{_WS}]|\z)", "।\\1")
    for _ in range(2):
        out = sub(out, rf"([।{_WS}{_BN}])[\[\]]([{_WS}]|\z)", "\\1।\\2")
    out = sub(out, "[`^~]")
    for _ in range(2):
        out = sub(out, r"(^|[^\p{Nd}])১০([২-৯]\p{Nd})(\z|[^\p{Nd}])", "\\1২০\\2\\3")
    for wrong, right in C.WORD_FIXES:
        out = f"replace({out}, {q(wrong)}, {q(right)})"
    return out


@query(
    f"""with t as (select doc_id, {_LETTERED} as t from documents), a as (select doc_id, t, {_UNICODE} as a, {_correct('t')} as c from t), d as (select *, {_artifacts('c')} as d from a)
    select doc_id, length(d) as n, concat_ws(',', if(a <> t, 'unicode_normalization', null), if(c <> a, 'pattern_correction', null), if(d <> c, 'stage_f_easyocr_artifacts', null)) as corrections,
    if(d <> c, {' + '.join(f"contains(t, {q(w)})::int" for w, _ in C.WORD_FIXES)}, null) as stage_f_fixes,
    {share('c', _BN)} > 0.2 and regexp_matches(a, '[{_BN}]') and length(c) > 30 as needs_repair, {_edit_sql('t', 'd')} as edit_distance from d"""
)
def fix_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.translate("text", LATIN + C.ASCII_DIGITS, BENGALI + C.BANGLA_DIGITS)
    c = table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", C.correct("t", "easyocr").alias("c"))
    return c.select("doc_id", F.length("c.text").cast("long").alias("n"), F.array_join("c.corrections", ",").alias("corrections"), "c.stage_f_fixes", "c.needs_repair", "c.edit_distance")


@query(
    f"""with o as (select o_orderkey as id, o_custkey as n from orders) select id, n, case when n < 1024 then n || ' B' when n < 1048576 then floor(n / 1024 + 0.5)::bigint || ' KB' else printf('%.2f', floor(n / 1048576 * 100 + 0.5) / 100) || ' MB' end as size,
    case when n < 1000 then n || ' ms' when n < 60000 then printf('%.2f', if(n % 250 = 125, n / 1000 + 0.001, n / 1000)::double) || ' s' else floor(n / 60000)::bigint || 'm ' || printf('%.1f', floor(n / 1000 % 60 * 10 + 0.5) / 10) || 's' end as duration from o where n > 0"""
)
def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("n")).filter("n > 0")
    return o.select("id", "n", T.format_size("n").alias("size"), T.format_duration("n", exact=False).alias("duration"))


@query("select page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) as md5 from pages")
def escape_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.escape_html("html").cast("binary")).alias("md5"))


@query("select conv_id as doc_id, md5(string_agg(text, chr(10) || chr(10) order by turn)) as md5 from conversations group by conv_id")
def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_number"), F.col("text").alias("full_text"))
    return documents.document_text(p).select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"))


@query("select event_type as engine, count(*) as calls, printf('%.2f', sum(value))::double as tokens, count(*) filter (value > 90) as errors from events group by event_type")
def call_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("engine"), F.col("value").alias("tokens"), (F.col("value") > 90).alias("failed"))
    return documents.call_stats(e).withColumn("tokens", T.rounded(F.col("tokens"), 2))


_MODELS = ("mistral", "moondream", "llava", "qwen2.5vl", "gemma", "llama3.2-vision")
_WANTED = ("qwen3:7b", "llava:34b", "qwen2.5vl:32b", "moondream:1b", "minicpm:8b")


@query(
    f"""with m as (select n_nationkey as pos, {list(_MODELS)}[n_nationkey % 6 + 1] || ':' || n_nationkey || 'b' as name from nation),
    p as (select r_regionkey as rank, {list(_WANTED)}[r_regionkey + 1] as expected from region),
    j as (select m.*, rank from m left join p on m.name = expected or starts_with(m.name, split_part(expected, ':', 1)) where regexp_matches(lower(m.name), {q('|'.join(documents.VISION_KEYWORDS))}))
    select arg_min(name, (rank is null, coalesce(rank, 0), pos)) as name from j"""
)
def pick_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey").cast("int")
    models = table(spark, sf_dir, "nation").select(key.alias("pos"), F.concat(F.get(F.array(*map(F.lit, _MODELS)), key % 6), F.lit(":"), key.cast("string"), F.lit("b")).alias("name"))
    wanted = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("rank"), F.get(F.array(*map(F.lit, _WANTED)), F.col("r_regionkey").cast("int")).alias("expected"))
    return documents.pick_model(models, wanted)


@query("select lower(trim(c_name)) as email, min(c_custkey) as id from customer where lower(trim(c_name)) not in (select lower(trim(s_name)) from supplier) group by 1")
def new_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("email"))
    return jobs.new_users(users, table(spark, sf_dir, "customer").select(F.col("c_name").alias("email"), F.col("c_custkey").alias("id")))


@query(
    """with f as (select source || if(n_chars % 3 = 0, '.PDF', '.txt') as name, n_chars as size, lang as modified, if(n_chars % 2 = 0, 'application/pdf', 'text/plain') as mime from documents)
    select name, size, modified from f where mime = 'application/pdf' or ends_with(lower(name), '.pdf') group by all"""
)
def distinct_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, mime = F.concat("source", F.when(F.col("n_chars") % 3 == 0, ".PDF").otherwise(".txt")), F.when(F.col("n_chars") % 2 == 0, "application/pdf").otherwise("text/plain")
    d = table(spark, sf_dir, "documents").select(name.alias("name"), F.col("n_chars").alias("size"), F.col("lang").alias("modified"), mime.alias("mime"))
    return jobs.distinct_files(d).select("name", "size", "modified")


@query(
    f"""with t as (select conv_id, turn, text from conversations), p as (select *, case when length({strip('text')}) >= 30 then 'digital' else 'scanned' end as kind from t)
    select conv_id::varchar as doc_id, turn::int as page_number, kind from p"""
)
def decode_and_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bytes of their turns, through the decoder source and the router."""
    from ..sources.files import decode_pages, route

    c = table(spark, sf_dir, "conversations")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    docs = c.groupBy(F.col("conv_id").cast("string").alias("doc_id")).agg(F.to_json(ordered).cast("binary").alias("content"))

    def decoder(content: bytes):
        import json

        return [{"text": page["text"]} for page in json.loads(content)]

    pages = route(decode_pages(docs, decoder))
    first = c.groupBy(F.col("conv_id").cast("string").alias("_d")).agg(F.min("turn").alias("_first"))
    out = pages.join(first, F.col("doc_id") == F.col("_d"))
    return out.select("doc_id", (F.col("page_number") + F.col("_first") - 1).cast("int").alias("page_number"), F.col("page_type").alias("kind"))


@query("select user_id, arg_max(event_type, (ts, event_id)) as event_type, arg_max(event_id, (ts, event_id)) as event_id from events group by user_id")
def stream_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, by a stream over the events' file that stops when it has read all."""
    from ..streaming.ingest import last_of, last_states, write_last_states

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet")
    events = events.withColumn("order", F.struct("ts", "event_id"))
    at = scratch_path(spark, "stream-states")
    write_last_states(last_states(events, "user_id", "order", ["event_type", "event_id"]), "user_id", f"{at}/rows", f"{at}/checkpoint").awaitTermination()
    return last_of(spark, f"{at}/rows", "user_id").select("user_id", "event_type", "event_id")
