"""Token-id output: texts to ids, ids to rANS segments, and back.

Documents are range-partitioned and sorted by id. A task encodes its texts (byte_pieces.py), appends the end id to each and cuts the stream into
segments at document bounds. A segment is one row of the written table: part, segment, the documents' ids and lengths, and the coded
ids (rans.py). Spark's writers carry the rows, so files go wherever Spark can write and tasks of lost executors are simply redone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rans
from .byte_pieces import PieceEncoder, piece_encoder
from .common import scratch_path, settled, whole

def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_SEGMENT = "part int, segment int, n_docs long, n_tokens long, doc_ids array<long>, lengths array<long>, data binary"
_FIELDS = ["part", "segment", "n_docs", "n_tokens", "doc_ids", "lengths", "data"]


def _documents(batch: pa.RecordBatch, encoder: PieceEncoder, end: np.ndarray) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Some documents' ids, their token ids, each with the end id, and the numbers of these."""
    ids, held = batch.column(0), []
    for at, found, sizes in encoder.encode(batch.column(1)):
        if held and held[0] != at:
            yield [ids[held[0]].as_py()], np.concatenate([*held[1], end]), np.array([sum(map(len, held[1])) + 1])
            held = []
        if len(sizes) == 1:  # of a long text there may be more
            held = [at, [*(held[1] if held else []), found]]
        else:
            yield ids.slice(at, len(sizes)).to_pylist(), np.insert(found, np.cumsum(sizes), end[0]), sizes + 1
    if held:
        yield [ids[held[0]].as_py()], np.concatenate([*held[1], end]), np.array([sum(map(len, held[1])) + 1])


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text: str = "text", segment: int = 1 << 20) -> None:
    """Write all documents, in ascending order of id, as coded segments of about so many ids (a longer document has one of its own).

    A null text is empty and has the end id alone. Ids are integers; null ones come first. Rows that share an id follow each other in the order
    of a hash of their texts, and may be many: ranges split them. An empty table gives an empty one; further columns are not looked at. Any file of the
    tokenizers library will do; whole texts are encoded if its pattern isn't the usual one of byte-level BPE.
    """
    tokenizer = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = piece_encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids: list[int | None] = []  # of the documents that the segment has so far
        lengths: list[int] = []
        coded: list[np.ndarray] = []
        held, end = 0, np.array([end_id], np.uint32)

        def flush() -> pa.RecordBatch:
            cells = [part, number, len(ids), held, ids, lengths, rans.encode(np.concatenate(coded))]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], _FIELDS)

        for b in batches:
            for doc_ids, found, sizes in _documents(b, encoder, end):
                at = 0
                while at < len(sizes):  # as many documents as the segment has room for, one at least
                    fits = int(np.searchsorted(np.cumsum(sizes[at:]), segment - held, "right"))
                    if ids and not fits:
                        yield flush()
                        ids, lengths, coded, held, number = [], [], [], 0, number + 1
                        continue
                    till = at + max(1, fits)
                    n = int(sizes[at:till].sum())
                    ids += doc_ids[at:till]
                    lengths += sizes[at:till].tolist()
                    coded.append(found[:n])
                    found, held, at = found[n:], held + n, till
        if ids:
            yield flush()

    # rows of one id, or of one text, are interchangeable or ordered by a hash, so that ranges can split them
    keys = [F.col(id_col).cast("long").alias("id"), whole(text).alias("text"), F.xxhash64(whole(text)).alias("h"), F.monotonically_increasing_id().alias("row")]
    sorted_ = docs.select(*keys).repartitionByRange("id", "h", "row").sortWithinPartitions("id", "h", "text").select("id", "text")
    sorted_.mapInArrow(settled(run), _SEGMENT).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document in the files: doc_id, start, n_tokens, ids_crc32, and with_ids the ids (unsigned 32-bit little-endian bytes)."""
    segments = spark.read.schema(_SEGMENT).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                part, number, data = (b.column(i)[row].as_py() for i in (0, 1, 6))
                ids, own = b.column(4)[row].values, b.column(5)[row].values.to_numpy()
                tokens, at = rans.decode(data).tobytes(), np.concatenate([[0], np.cumsum(own)])
                if at[-1] * 4 != len(tokens):
                    raise ValueError(f"segment {number} of part {part} is damaged")
                pieces = [tokens[s:e] for s, e in zip((4 * at).tolist(), (4 * at[1:]).tolist())]
                cells = [np.full(len(ids), part, np.int32), np.full(len(ids), number, np.int32), ids, at[:-1], own, np.array([zlib.crc32(x) for x in pieces], np.int64)]
                names = ["part", "segment", "doc_id", "at", "n_tokens", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([*(c if isinstance(c, pa.Array) else pa.array(c) for c in cells), pa.array(pieces if with_ids else [None] * len(ids), pa.binary())], names)

    rows = segments.mapInArrow(settled(run), "part int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long, ids binary")
    sizes = segments.groupBy(F.col("part").alias("p"), F.col("segment").alias("s")).agg(F.sum("n_tokens").alias("n"))
    parts = sizes.groupBy(F.col("p").alias("q")).agg(F.sum("n").alias("n"))  # a row for each written file
    before = Window.orderBy("q").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("q", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("p").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, F.col("p") == F.col("q")).select("p", "s", (F.col("base") + F.col("inner")).alias("base"))
    out = rows.join(starts, (F.col("part") == F.col("p")) & (F.col("segment") == F.col("s")))
    return out.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_round_trip(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Write docs to files in the shared folder and read their digest back: doc_id, start, n_tokens, ids_crc32."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer, end_id, id_col, text)
    return read_token_files(docs.sparkSession, path, with_ids=False)
