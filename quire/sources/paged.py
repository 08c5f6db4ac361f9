"""Documents as a data source whose partitions are ranges of pages, so a file of many pages is read by many tasks.

The caller gives two functions: count, the number of pages of a file's bytes, and cheap; and decode, the pages from a first to a last number, in order. Paths and sizes are listed on the driver, as for any file
source; counting is a job over the files, and a plan of ranges follows from it. A task opens its file, decodes its range a page at a time and gives batches of bounded size, so a page is the most that it holds beside a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

Count = Callable[[bytes], int]
Decode = Callable[[bytes, int, int], Iterable[Mapping]]
RANGE_PAGES, BATCH_BYTES = 64, 32 << 20
PAGE_COLUMNS = ["page_number", "text", "image", "tables", "images"]


class PageRange(InputPartition):
    def __init__(self, doc_id: str, path: str, first: int, last: int, error: str | None = None) -> None:
        self.doc_id, self.path, self.first, self.last, self.error = doc_id, path, first, last, error


def _weight(page: Mapping) -> int:
    return len(page.get("image") or b"") + 4 * len(page.get("text") or "") + sum(len(x.get("image_bytes") or b"") for x in page.get("images") or ()) + 200


def decoded_range(doc_id: str, content: bytes, first: int, last: int, decode: Decode) -> Iterator[dict]:
    """Rows of pages first to last. If the decoder breaks off, the pages before stay, and a row with the error follows them."""
    number = first
    try:
        for page in decode(content, first, last):
            if number > last:
                break
            yield {"doc_id": doc_id, "page_number": number, **{k: page.get(k) for k in PAGE_COLUMNS[1:]}, "error": None}
            number += 1
    except Exception as e:  # noqa: BLE001  decoders are foreign code; the row says what happened
        yield {"doc_id": doc_id, **dict.fromkeys(PAGE_COLUMNS), "error": (f"page {number}: " * (number > first) + f"{type(e).__name__}: {e}").replace("\n", " ")[:180]}


def batched(rows: Iterable[dict], schema: pa.Schema, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about most bytes; a larger row is one by itself."""
    held, size = [], 0
    for r in rows:
        own = _weight(r)
        if held and size + own > most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
        held.append(r)
        size += own
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def page_source(load: Callable[[str], bytes], decode: Decode, plan: list[PageRange], name: str, schema: str, batch_bytes: int = BATCH_BYTES) -> type[DataSource]:
    """A source with that plan: each range is a partition. load gives a file's bytes in a worker."""
    from pyspark.sql.pandas.types import to_arrow_schema

    class Reader(DataSourceReader):
        def __init__(self, own: StructType) -> None:
            self.own = own

        def partitions(self) -> list[InputPartition]:
            return plan or [PageRange("", "", 1, 0)]

        def read(self, part: PageRange) -> Iterator[pa.RecordBatch]:
            arrow = to_arrow_schema(self.own)
            if part.error is not None:
                yield pa.RecordBatch.from_pylist([{"doc_id": part.doc_id, **dict.fromkeys(PAGE_COLUMNS), "error": part.error}], arrow)
            elif part.last >= part.first:
                yield from batched(decoded_range(part.doc_id, load(part.path), part.first, part.last, decode), arrow, batch_bytes)

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader(schema)

    return Pages


def counted(documents: DataFrame, count: Count) -> DataFrame:
    """doc_id, path, pages, error of documents (doc_id, path, content): a file that can't be counted has the error and no pages."""
    import pandas as pd

    def one(content: bytes) -> tuple[int, str | None]:
        try:
            return int(count(bytes(content))), None
        except Exception as e:  # noqa: BLE001  decoders are foreign code
            return 0, f"{type(e).__name__}: {e}".replace("\n", " ")[:180]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [one(x) for x in b["content"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "path": b["path"], "pages": [n for n, _ in got], "error": [e for _, e in got]}).astype({"error": object})

    return documents.select("doc_id", "path", "content").mapInPandas(run, "doc_id string, path string, pages int, error string")


def ranges(sizes: DataFrame, pages: int = RANGE_PAGES) -> DataFrame:
    """doc_id, path, first, last, error: the ranges of at most so many pages of each counted() file; a file with an error is one range with it, and one without pages has none."""
    last = F.least(F.col("first") + pages - 1, F.col("pages"))
    cut = sizes.filter("error is null and pages > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("pages"), F.lit(pages))).alias("first")).select("doc_id", "path", "first", last.alias("last"), "error")
    return cut.unionByName(sizes.filter("error is not null").select("doc_id", "path", F.lit(1).alias("first"), F.lit(0).alias("last"), "error"))


def read_pages(documents: DataFrame, count: Count, decode: Decode, pages: int = RANGE_PAGES, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, page columns and error of documents (doc_id, path, content): a page a row, and a row for each error. The ranges are rows, spread evenly over the tasks, each of which fetches its range's file.

    Unlike page_source() this plans no partition on the driver, so there may be any number of files; the ranges, and not the pages, are shuffled with their paths, and files meet them by a join on the path.
    """
    from .files import PAGE_SCHEMA
    from .scratch import written

    spark = documents.sparkSession
    plan = written(ranges(written(counted(documents, count), "counted"), pages), "ranges")
    # files of one range stay where they are read; those of several are sent once to each of their ranges
    parted = plan.filter("last >= first").select(F.col("path").alias("_path"), "first", "last")
    met = documents.select("doc_id", "path", "content").join(parted, F.col("path") == F.col("_path")).select("doc_id", "content", "first", "last")
    met = met.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "doc_id", "first")
    schema = StructType.fromDDL(f"doc_id string, {PAGE_SCHEMA}, error string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in batches:
            for i in range(b.num_rows):
                doc, content, first, last = (c[i].as_py() for c in b.columns)
                yield from batched(decoded_range(doc, content, first, last, decode), arrow, batch_bytes)

    failed = plan.filter("error is not null").select("doc_id", *[F.lit(None).cast(schema[c].dataType).alias(c) for c in PAGE_COLUMNS], "error")
    return met.mapInArrow(run, schema).unionByName(failed)


def read_paged_files(spark: SparkSession, documents: DataFrame, count: Count, decode: Decode, load: Callable[[str], bytes], pages: int = RANGE_PAGES, name: str = "quire_pages", batch_bytes: int = BATCH_BYTES, most_ranges: int = 1 << 20) -> DataFrame:
    """As read_pages(), where workers can open a path themselves (load): each range is a partition of a data source, and no file goes through a shuffle. The plan is a list of ranges on the driver, as those of Spark's own
    file sources are; above most_ranges of them it is read_pages() that reads."""
    from .files import PAGE_SCHEMA
    from .scratch import written

    plan = written(ranges(written(counted(documents, count), "counted"), pages), "ranges")
    if plan.count() > most_ranges:
        return read_pages(documents, count, decode, pages, batch_bytes)
    own = [PageRange(*r) for r in plan.orderBy("path", "first").collect()]
    spark.dataSource.register(page_source(load, decode, own, name, f"doc_id string, {PAGE_SCHEMA}, error string", batch_bytes))
    return spark.read.format(name).load()
