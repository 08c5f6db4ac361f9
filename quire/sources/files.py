"""Sources: documents as files, word lists, snapshots, page JSON, JDBC, settings. Decoders are functions that the caller gives."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text as T
from . import paged, store

MOST_BYTES = 100 * 1024 * 1024
PAGE_SCHEMA = "page_number int, text string, image binary, tables array<array<array<string>>>, images array<struct<xref:int,image_bytes:binary,ext:string,width:int,height:int>>"
#: What process_pages() gives, as JSON has it.
PAGE_JSON = (
    "doc_id string, page_number int, tables array<struct<table_id:int,structure_confidence:double,rows:array<array<string>>>>, "
    "images array<struct<image_id:int,type:string,detected_text:string,description:string,confidence:double>>, source_image_path string, "
    "blocks array<struct<block_id:int,type:string,language:string,text:string,confidence:double,bbox:struct<x1:double,y1:double,x2:double,y2:double>,is_handwritten:boolean>>, "
    "method string, engine string, correction_applied boolean, numeric_validation_passed boolean, confidence_tier string, unicode_validation string, ms double, steps array<string>, confidence_score double, full_text string, verified boolean, domain string, "
    "decisions array<struct<page:int,keyword:string,detail:string,severity:string>>"
)
#: What page files that are reports have instead of some of those columns.
PAGE_REPORT = (
    "extraction struct<method:string,engine:string,confidence_score:double,correction_applied:boolean,numeric_validation_passed:boolean>, "
    "content_blocks array<struct<block_id:int,type:string,language:string,text:string,confidence:double,bbox:array<double>,is_handwritten:boolean>>"
)
VERIFICATION_SCHEMA = "doc_id string, page_number int, verified boolean, at timestamp"
PROGRESS_SCHEMA = "doc_id string, current_page int, total_pages int, status string, message string, updated_at string"


def read_documents(spark: SparkSession, path: str, pattern: str = "*.[pP][dD][fF]", most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, doc_id, content of files of the right name and size; doc_id is the stem with the start of its MD5."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return admitted(raw, most_bytes)


def admitted(raw: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    small = raw.filter(F.col("length") <= most_bytes)
    return small.select("path", T.doc_id(T.file_stem(F.url_decode("path"))).alias("doc_id"), "content")


def decode_pages(documents: DataFrame, decoder: Callable[..., Iterable[Mapping]], dpi: int | None = None) -> DataFrame:
    """doc_id, page columns (PAGE_SCHEMA) and error. decoder gives a page's mapping at a time, in order; where a file can't be read, or read on, a row has the error, and the pages before it stay.

    A file is read by one task, which holds some pages at a time. paged.read_pages() splits files of many pages. dpi, if given, goes to the decoder by that name.
    """
    more = {} if dpi is None else {"dpi": dpi}
    schema = StructType.fromDDL(f"doc_id string, {PAGE_SCHEMA}, error string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for b in batches:
            for i in range(b.num_rows):
                doc, content = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                yield from paged.batched(paged.decoded_range(doc, content, 1, 1 << 30, lambda c, *_: decoder(c, **more)), arrow)

    return documents.select("doc_id", "content").mapInArrow(run, schema)


def route(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page_number", T.page_type("text").alias("page_type"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """word: lines of a word list, stripped, each once; blank lines and those that begin with # are left out."""
    lines = spark.read.text(path)
    return lines.filter(~F.col("value").startswith("#")).select(T.strip("value").alias("word")).filter("word <> ''").distinct()


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots; malformed ones are left out."""
    return spark.read.schema(PROGRESS_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def read_page_json(spark: SparkSession, root: str, schema: str | StructType = PAGE_JSON) -> DataFrame:
    """Pages that write_page_json() wrote, and page files page_<n>_<engine>.json or page_<n>.json in a folder for each document. The path gives
    doc_id, page_number and engine where the content has none."""
    own = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    both = StructType([*own.fields, *[f for f in StructType.fromDDL(PAGE_REPORT).fields if f.name not in own.names]])
    named = spark.read.schema(both).option("pathGlobFilter", "page_*.json").option("recursiveFileLookup", "true").option("multiLine", True).json(root)
    path = F.url_decode(F.col("_metadata.file_path"))
    given = {"doc_id": F.regexp_extract(path, r"([^/]+)/page_[^/]*$", 1), "page_number": F.regexp_extract(path, r"page_(\d+)[^/]*$", 1).cast("int"), "engine": F.nullif(F.regexp_extract(path, r"page_\d+_([^/]*)\.json$", 1), F.lit(""))}
    inner = {k: F.col(f"extraction.{k}") for k in ("method", "engine", "confidence_score", "correction_applied", "numeric_validation_passed")} | {"blocks": _own_blocks()}
    named = named.withColumns({k: F.coalesce(F.col(k), v) for k, v in inner.items() if k in own.names})
    named = named.withColumns({k: F.coalesce(F.col(k), v) for k, v in given.items() if k in own.names}).select(*own.names)
    if not store.exists(spark, f"{root}/rows"):
        return named
    return named.unionByName(store.current(spark, root, form="json", schema=own))


def _own_blocks() -> Column:
    corner = lambda b: F.when(F.size(b) == 4, F.struct(*[F.get(b, F.lit(i)).alias(k) for i, k in enumerate(("x1", "y1", "x2", "y2"))]))
    return F.transform("content_blocks", lambda b: b.withField("bbox", corner(b["bbox"])).withField("is_handwritten", F.coalesce(b["is_handwritten"], F.lit(False))))


def read_verifications(spark: SparkSession, path: str) -> DataFrame:
    """All verdicts, of appended files and of runs."""
    own = StructType.fromDDL(VERIFICATION_SCHEMA).names
    return spark.read.schema(VERIFICATION_SCHEMA).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path).select(*own)


def find_page(pages: DataFrame, doc_id: str, page_number: int) -> DataFrame:
    return pages.filter((F.col("doc_id") == doc_id) & (F.col("page_number") == page_number))


def read_table(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A table over JDBC, read in parts by a numeric key."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


@dataclass
class Settings:
    """Options with their defaults; a .env text and then the environment override them by the name in capitals. What a foreign engine or decoder needs of them (place, model, resolution, processor) is there for its factory."""

    data_dir: str = "data"
    dpi: int = 200
    use_gpu: bool = False
    max_workers: int = 2
    fast_mode: bool = False
    fast_mode_bangla: bool = True
    log_level: str = "INFO"
    database_url: str = ""
    ollama_base_url: str = "http://localhost:11434"
    ollama_image_model: str = "moondream2"
    surya_enabled: bool = True
    gemini_enabled: bool = False
    ollama_enabled: bool = True
    ocr_min_bangla_ratio: float = 0.10
    ocr_devanagari_reject_threshold: float = 0.16
    surya_min_bangla_ratio: float = 0.12
    surya_devanagari_reject_threshold: float = 0.18
    ollama_timeout: float = 180.0
    ollama_prompt: str = ""
    ocr_prompt: str = "Read all text of this page."

    @classmethod
    def load(cls, environment: Mapping[str, str] = os.environ, env_text: str = "") -> Settings:
        given = dict(x.split("=", 1) for x in env_text.splitlines() if "=" in x and not x.lstrip().startswith("#"))
        given = {k.strip(): v.strip().strip("\"'") for k, v in given.items()} | dict(environment)
        out = cls()
        for f in fields(cls):
            if (raw := given.get(f.name.upper())) is not None:
                kind = type(getattr(out, f.name))
                setattr(out, f.name, raw.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw))
        return out

    @property
    def flow_mode(self) -> str:
        return "surya_first" if self.surya_enabled else "skip_surya"

    def folders(self) -> dict[str, str]:
        """Where results go under data_dir: images, pages, merged documents, texts and logs."""
        names = {"images": "output_images", "pages": "output_jsons", "merged": "merged_outputs", "texts": "output_texts", "logs": "logs"}
        return {k: f"{self.data_dir.rstrip('/')}/{v}" for k, v in names.items()}

    def prompt(self, engine: str, folder: str | None = None) -> str:
        """The engine's prompt, or the general one: from <engine>.txt or ocr.txt in a folder, if it is there and not blank, else from the settings."""
        for name in dict.fromkeys((engine, "ocr")) if folder else ():
            try:
                with open(os.path.join(folder, f"{name}.txt"), encoding="utf-8") as f:
                    if said := f.read().strip():
                        return said
            except OSError:
                continue
        return (self.ollama_prompt if engine == "ollama" else "") or self.ocr_prompt
