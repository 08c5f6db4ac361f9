"""The queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontam import leaks
from .exact_dedup import exact_dedup
from .fill_middle import fill_digest
from .langid import language_id
from .line_dedup import line_dedup
from .mixing import mixed_sources
from .token_links import linked_tokens
from .shard import shard_documents
from .simhash import near_dedup
from .spiece import round_trip
from .token_files import token_round_trip
from .toxicity import score_toxicity
from .warc import resolved_pages


def op1_shard_bfd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op8_decontam_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("start", F.col("start").cast("long"))


def op9_line_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_lines").cast("long"), F.col("n_deleted").cast("long"), F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_langid_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op3_sentencepiece_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def op4_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved_pages(spark, sf_dir)


def op6_token_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(table(spark, sf_dir, "documents"))


def op7_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_tokens(table(spark, sf_dir, "documents"))


def op12_mix_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sources(table(spark, sf_dir, "documents"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shard_bfd": op1_shard_bfd,
    "op2_langid_kernel": op2_langid_kernel,
    "op3_sentencepiece_suffix_array": op3_sentencepiece_suffix_array,
    "op4_toxicity_fm": op4_toxicity_fm,
    "op5_warc_revisits": op5_warc_revisits,
    "op6_token_rans": op6_token_rans,
    "op7_simhash_golay": op7_simhash_golay,
    "op8_decontam_simhash": op8_decontam_simhash,
    "op9_line_suffix_array": op9_line_suffix_array,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_token_alignment": op11_token_alignment,
    "op12_mix_pareto": op12_mix_pareto,
    "op13_fill_middle": op13_fill_middle,
}

SQL: dict[str, str] = {
    "op5_warc_revisits": r"""
        with u as (select *, regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(\?[^#]*)?', ['host', 'path', 'query']) as x from pages),
        p as (select page_id, html, regexp_replace(lower(x.host), '^www\.|:(80|443)$', '', 'g') as host, regexp_replace(x.path, '/+$', '') as path,
            list_sort(list_filter(string_split(x.query[2:], '&'), lambda q: q <> '' and not regexp_matches(q, '^(utm_[^=]*|fbclid|gclid|ref)(=|$)'))) as query from u),
        c as (select page_id, '"' || md5(coalesce(html, '')) || '"' as tag, octet_length(encode(coalesce(html, ''))) as size, nullif(host, '') as host,
            host || if(path = '', '/', path) || if(len(query) > 0, '?' || array_to_string(query, '&'), '') as canonical from p),
        r as (select page_id, page_id + 1000 as ts, tag, if(host is null, null, canonical) as canonical from c),
        j as (select r.page_id, r.canonical, r.tag, c.page_id as response_page, c.tag as was, c.size
            from r asof left join (select * from c where host is not null) c on r.canonical = c.canonical and r.ts >= c.page_id)
        select page_id, canonical, case when canonical is null then 'no_url' when response_page is null then 'missing' when tag = was then 'resolved' else 'mismatch' end as status,
            if(tag = was, response_page, null) as response_page,
            if(tag = was, concat_ws(chr(10), 'age=0', 'cache-control=max-age=600', 'content-length=' || size, 'content-type=text/html', 'etag=W/' || tag), null) as headers
        from j""",
    "op8_decontam_simhash": r"""
        with d as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
        b as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from benchmark),
        s as (select doc_id, m, generate_subscripts(s, 1) - 1 as p, unnest(s) as x from (select doc_id, greatest(len(w) - 4, 1) as m, list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')) as s from d where len(w) > 0)),
        i as (select item_id, n, unnest(s) as x from (select item_id, greatest(len(w) - 4, 1) as n, list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')) as s from b where len(w) > 0)),
        k as (select item_id, n, x, count(*) as c from i group by all),
        h as (select doc_id, item_id, n, m, c, p, x from s join k using (x)),
        starts as (select distinct doc_id, item_id, n, m, greatest(least(p, m - n), 0) as start from h),
        shared as (select doc_id, item_id, n, m, start, x, least(count(*), any_value(c)) as both_ from starts join h using (doc_id, item_id, n, m) where p >= start and p < start + n group by all),
        v as (select doc_id, item_id, start, sum(both_) / (n + least(n, m) - sum(both_)) as similarity from shared group by doc_id, item_id, n, m, start)
        select doc_id, item_id, max(similarity) as similarity, arg_max(start, (similarity, -start)) as start from v where similarity >= 0.8 group by doc_id, item_id""",
    "op9_line_suffix_array": """
        with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line, unnest(string_split(text, chr(10))) as x from documents),
        w as (select *, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) as words from l),
        s as (select *, row_number() over (partition by doc_id order by line) as n from w where words > 0),
        f as (select doc_id, n,
            list(x) over a as ax, list(words) over a as aw, list(line) over a as al,
            list(x) over b as bx, list(words) over b as bw, list(line) over b as bl
            from s window a as (partition by doc_id order by n rows between current row and 9 following),
                          b as (partition by doc_id order by n rows between 9 preceding and current row)),
        m as (select *,
            list_min(list_filter(range(1, len(aw) + 1), lambda j: list_sum(aw[1:j]) >= 10)) as am,
            list_min(list_filter(range(1, len(bw) + 1), lambda j: list_sum(bw[len(bw) - j + 1:]) >= 10)) as bm from f),
        r as (select doc_id, n, ax[1:am] as run, al[1:am] as lines from m where am is not null
              union all select doc_id, n - bm + 1, bx[len(bx) - bm + 1:], bl[len(bl) - bm + 1:] from m where bm is not null),
        h as (select *, min((doc_id, n)) over (partition by run) as head from r),
        gone as (select distinct doc_id, unnest(lines) as line from h where (doc_id, n) > head),
        g as (select doc_id, count(*) as n_deleted from gone group by doc_id),
        t as (select l.doc_id, string_agg(x, chr(10) order by l.line) filter (gone.doc_id is null) as text, count(*) as n_lines
              from l left join gone on gone.doc_id = l.doc_id and gone.line = l.line group by l.doc_id)
        select t.doc_id, t.n_lines, coalesce(g.n_deleted, 0) as n_deleted, length(coalesce(t.text, '')) as n_chars, md5(coalesce(t.text, '')) as text_md5
        from t left join g on g.doc_id = t.doc_id""",
    "op10_exact_dedup": """
        with d as (select doc_id, coalesce(text, '') t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') n from documents),
        g as (select n, count(*) group_size, arg_min(doc_id, (-length(t), doc_id)) keep_id from d group by n)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(n) as text_sha256 from d join g using (n)""",
    "op12_mix_pareto": r"""
        with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
            (('0x' || md5('42:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, '')))[:13])::bigint::double + 0.5) / 4503599627370496.0::double as u from documents),
        s as (select source, sum(size)::bigint as words, ([5, 2, 1])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::bigint as weight from d group by source),
        o as (select *, 2.0::double * words / weight as full_at from s),
        l as (select *, (sum(words) over () * 1.5::double - coalesce(sum(2 * words) over (order by full_at, source nulls last rows between unbounded preceding and 1 preceding), 0)::double)
            / sum(weight) over (order by full_at, source nulls last rows between current row and unbounded following)::double as level, row_number() over (order by full_at, source nulls last) as rank from o),
        v as (select coalesce(arg_min(level, rank) filter (2 * words > weight * level), 0) as level from l),
        t as (select source, words, least((2 * words)::double, weight * v.level) as target, coalesce(least((2 * words)::double, weight * v.level) / nullif(words, 0), 0) as mean from s, v),
        r as (select d.*, words, target, floor(mean)::bigint as copies, mean - floor(mean) as chance from d join t on d.source is not distinct from t.source),
        k as (select *, if(chance > 0, (u / (1 - u)) / (chance / (1 - chance)), null) as odds from r),
        n as (select source, floor(max(target) - sum(copies * size) + 0.5::double)::bigint as lack from k group by source),
        c as (select source, odds, sum(size) as n, count(*) as sharers, sum(sum(size)) over (partition by source order by odds) - sum(size) as before from k where odds is not null group by source, odds),
        e as (select c.source, odds as edge, (lack - before) // sharers as part from c join n on c.source is not distinct from n.source where before < lack and lack <= before + n)
        select doc_id, size::bigint as size, words as source_size, target, (copies * size + case when odds < edge then size when odds = edge then least(size, part) else 0 end)::bigint as taken
        from k left join e on k.source is not distinct from e.source""",
    "op13_fill_middle": r"""
        with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as t, sha256('42:' || coalesce(doc_id::varchar, '')) as h from documents),
        r as (select *, len(t) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
        c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
            case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from r),
        p as (select *, coalesce(array_to_string(t[1:a], ''), '') as prefix, coalesce(array_to_string(t[a + 1:b], ''), '') as middle, coalesce(array_to_string(t[b + 1:], ''), '') as suffix from c)
        select doc_id, n::bigint as n, form, if(form = 'plain', null, length(prefix))::bigint as prefix_chars, if(form = 'plain', null, length(middle))::bigint as middle_chars,
            sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
            sha256(prefix || middle || suffix) as restored_sha256 from p""",
}
