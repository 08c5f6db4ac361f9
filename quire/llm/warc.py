"""WARC records, and the resolution of not-modified revisits.

A server-not-modified revisit has no payload: it says that the latest full response to the same URL still holds. Resolution is an as-of join on
the canonical URL: the latest earlier full response is found, its validators are checked against the revisit's, and headers that a 304 may carry replace the stored ones.

A URL's records at one time are one point, made by partial aggregation, so however many share a time they don't meet in a task. A window carries the last
response on from point to point. A URL with a crowd of points is cut into spans by the quantiles of its own times; between them, of which there is a bounded number,
the last response of each is carried on. Revisits then look their point up in a join whose hot points Spark can split.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Query parameters that only track, and header fields of a 304 that describe the message itself and never replace stored ones.
TRACKING = r"^(utm_[^=]*|fbclid|gclid|ref)(=|$)"
UNMERGED = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"]
_URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(\?[^#]*)?"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, path without closing slashes, query sorted and without tracking; no scheme or fragment. Null if there is no host, as in a null, empty or blank URL."""
    url = F.trim(url)
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, _URL, 2), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.substr(F.regexp_extract(url, _URL, 3), F.lit(2)), "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    out = F.concat(host, F.when(path == "", "/").otherwise(path), F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))
    return F.when(host != "", out)


def _bare(etag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(etag, "^W/", "")


def in_spans(points: DataFrame, crowded: DataFrame, spans: int) -> DataFrame:
    """points (canonical, ts, ...) with span, which grows with ts: URLs in crowded (of_) are cut at the quantiles of their own times, so a stray time changes nothing; others have one span."""
    at = points.join(crowded, F.col("canonical") == F.col("of_")).select("canonical", F.col("ts").cast("double").alias("t"))
    cuts = at.groupBy("canonical").agg(F.percentile_approx("t", [i / spans for i in range(1, spans)], 50 * spans).alias("cuts")).withColumnRenamed("canonical", "of_")
    cut = points.join(materialize(cuts, "cuts"), F.col("canonical") == F.col("of_"), "left")  # a row for each crowded URL, of which there are at most all points over crowd
    return cut.withColumn("span", F.greatest(F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("ts"))), F.lit(0)), F.lit(0))).drop("of_", "cuts")


def resolve_revisits(records: DataFrame, spans: int = 256, crowd: int = 200_000) -> DataFrame:
    """One row per revisit of records (record_id, kind, url, ts, headers; kind is response or revisit, ts a number, headers a map of lower-case names).

    Returns record_id, canonical, status, response_id, headers. status: resolved, if the validators agree (entity tags weakly, or else dates of
    last change); unverified, if the two have none in common; mismatch; missing, without an earlier response; no_url. Only the first two have a response_id and
    merged headers. Of records at one time a response comes before a revisit and the larger record_id last. Nulls: a null url is no_url, a null ts is
    before all others, null headers are none. Repeated revisits have a row each; an empty table gives an empty result. URLs with more than crowd times are cut into so many spans.
    """
    own = records.filter(F.col("kind").isin("response", "revisit")).select(
        "record_id", (F.col("kind") == "revisit").alias("again"), canonical_url(F.col("url")).alias("canonical"), "ts", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers")
    )
    response = lambda x: F.when(~F.col("again"), x)
    points = own.filter("canonical is not null").groupBy("canonical", "ts").agg(
        F.max_by(response(F.struct(F.col("record_id").alias("id"), "headers")), response(F.col("record_id"))).alias("full"), F.bool_or("again").alias("asked")
    )
    points = materialize(points, "points")
    by_time = lambda *keys: Window.partitionBy("canonical", *keys).orderBy(F.col("ts").asc_nulls_first())
    crowded = points.groupBy("canonical").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select(F.col("canonical").alias("of_"))
    crowded = materialize(crowded, "crowded")
    if crowded.isEmpty():
        answers = points.withColumn("found", F.last("full", ignorenulls=True).over(by_time())).filter("asked")
    else:
        cut = in_spans(points, crowded, spans)
        near = materialize(cut.withColumn("near", F.last("full", ignorenulls=True).over(by_time("span"))), "near")
        last = near.groupBy("canonical", "span").agg(F.max_by("full", F.when(F.col("full").isNotNull(), F.struct(F.col("ts").isNotNull(), "ts"))).alias("last"))
        before = Window.partitionBy("canonical").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
        far = last.withColumn("far", F.last("last", ignorenulls=True).over(before)).select(F.col("canonical").alias("c_"), F.col("span").alias("s_"), "far")
        joined = near.filter("asked").join(materialize(far, "far"), (F.col("canonical") == F.col("c_")) & (F.col("span") == F.col("s_")))
        answers = joined.withColumn("found", F.coalesce("near", "far"))
    answers = materialize(answers.select(F.col("canonical").alias("c_"), F.col("ts").alias("t_"), "found"), "answers")
    asked = own.filter("again").drop("again")
    found = asked.filter("canonical is not null").join(answers, (F.col("canonical") == F.col("c_")) & F.col("ts").eqNullSafe(F.col("t_"))).drop("c_", "t_")
    found = found.unionByName(asked.filter("canonical is null").withColumn("found", F.lit(None).cast(answers.schema["found"].dataType)))
    was, now = F.col("found.headers"), F.col("headers")
    tags = was["etag"].isNotNull() & now["etag"].isNotNull()
    dates = was["last-modified"].isNotNull() & now["last-modified"].isNotNull()
    agrees = F.when(tags, _bare(was["etag"]) == _bare(now["etag"])).when(dates, was["last-modified"] == now["last-modified"])
    status = F.when(F.col("canonical").isNull(), "no_url").when(F.col("found").isNull(), "missing").when(agrees, "resolved").when(agrees.isNull(), "unverified").otherwise("mismatch")
    new = F.map_filter(now, lambda k, _: ~k.isin(UNMERGED))
    merged = F.map_concat(F.map_filter(was, lambda k, _: ~F.map_contains_key(new, k)), new)
    usable = F.col("status").isin("resolved", "unverified")
    return found.withColumn("status", status).select("record_id", "canonical", "status", F.when(usable, F.col("found.id")).alias("response_id"), F.when(usable, merged).alias("headers"))


def recrawl(pages: DataFrame, after: int) -> DataFrame:
    """The records of a crawl in order of page_id that asks for each page again, conditionally, after so many later pages, and is told that it is not modified.

    For each page a response with an entity tag of its bytes, and a revisit with the tag that was asked about. A record's id is the page's, whatever its type, and whether it is the revisit. Times are
    decimals, so that none of a page id, of any integer type or text of digits, is too large; an id that isn't a number has no time.
    """
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"'))
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    full = F.create_map(F.lit("etag"), tag, F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), size, F.lit("cache-control"), F.lit("max-age=60"))
    none = F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=600"), F.lit("age"), F.lit("0"))
    number = F.expr("try_cast(page_id as decimal(20, 0))")
    cell = lambda kind, late, headers: F.struct(
        F.struct(F.col("page_id").alias("page"), F.lit(kind == "revisit").alias("again")).alias("record_id"), F.lit(kind).alias("kind"), F.col("url").alias("url"), (number + late).alias("ts"), headers.alias("headers")
    )
    return pages.select(F.explode(F.array(cell("response", 0, full), cell("revisit", after, none))).alias("r")).select("r.*")


def write_records(records: DataFrame, path: str) -> None:
    """Write records (record_id, kind, url, ts, headers, payload) as gzip members of WARC/1.1 text, one row a record; Spark's writer carries them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([warc_bytes(*(c[i].as_py() for c in b.columns)) for i in range(b.num_rows)], pa.binary())], ["record_id", "warc"])

    records.select("record_id", "kind", "url", "ts", "headers", "payload").mapInArrow(run, "record_id long, warc binary").write.parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of write_records()."""
    schema = "record_id long, kind string, url string, ts long, headers map<string,string>, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
        for b in batches:
            rows = [warc_record(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["record_id", "kind", "url", "ts", "headers", "payload"])

    return spark.read.parquet(path).select("warc").mapInArrow(run, schema)


def warc_bytes(record_id: int, kind: str, url: str | None, ts: int | None, headers: list | dict | None, payload: bytes | None) -> bytes:
    """One gzip member: WARC header, HTTP header, payload."""
    status = "304 Not Modified" if kind == "revisit" else "200 OK"
    http = "".join([f"HTTP/1.1 {status}\r\n", *[f"{k}: {v}\r\n" for k, v in sorted(dict(headers or {}).items())], "\r\n"]).encode()
    body = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:quire:{record_id}>", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    head += [f"WARC-Target-URI: {url}"] * (url is not None) + [f"WARC-Date: {ts}"] * (ts is not None)
    head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/server-not-modified"] * (kind == "revisit")
    return gzip.compress("\r\n".join([*head, "", ""]).encode() + body + b"\r\n\r\n", 6, mtime=0)


def warc_record(data: bytes) -> tuple[int, str, str | None, int | None, list[tuple[str, str]], bytes | None]:
    head, _, rest = gzip.decompress(data).partition(b"\r\n\r\n")
    own = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(own["Content-Length"])].partition(b"\r\n\r\n")
    headers = [(k.lower(), v) for k, v in (x.split(": ", 1) for x in http.decode().split("\r\n")[1:])]
    record_id = int(re.search(r"\d+", own["WARC-Record-ID"])[0])
    ts = int(own["WARC-Date"]) if "WARC-Date" in own else None
    return record_id, own["WARC-Type"], own.get("WARC-Target-URI"), ts, headers, None if own["WARC-Type"] == "revisit" else payload


def resolved_pages(spark: SparkSession, sf_dir: str, after: int = 1000) -> DataFrame:
    """Over the table of pages: page_id (of the revisit), canonical, status, response_page (whose response holds), headers (merged, sorted, name=value lines).

    A row for each row of pages. A null html is empty; a page without a URL is no_url; a null page_id has a revisit at no time, before all others. Rows that repeat a
    page_id are records of one time, and ids that aren't numbers have none. Integer ids of any size come out as they are. An empty table gives an empty result; further columns are not looked at.
    """
    found = resolve_revisits(recrawl(table(spark, sf_dir, "pages"), after))
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\n")
    return found.select(F.col("record_id.page").alias("page_id"), "canonical", "status", F.col("response_id.page").alias("response_page"), lines.alias("headers"))
