"""SimHash near-dedup through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each read as a word of the perfect (23, 12) Golay code. If two
fingerprints differ in at most three bits, then either one segment is equal and another differs in at most one bit, or each
segment differs in exactly one. A word decodes to one codeword within three bits; a word at distance three has five more codewords
at distance four. Of two words that differ in at most one bit, the nearest codeword of one is always among the nearest and next
codewords of the other. So a join of keys (exact segment, codeword index) and of keys (three codeword indices) finds every pair:
33 and 36 bits wide, so chance meetings stay rare. Pairs are verified on the whole fingerprints.

Fingerprints are joined once each, whatever number of documents has them. A bucket with many fingerprints is not joined with
itself: tiles of it, dealt over tasks, hand on the links of a spanning forest instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, settled, without
from .components import components, forest

#: The generator polynomial of the Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: Low bit and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
RADIUS = 3


def word_bytes(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "replace").lower().split()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of k words, repeats included; of all words if they are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(k)))) if len(words) >= k else [b" ".join(words)]
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(x, 42) for x in runs), np.uint64, max(1, len(words) - k + 1))


def fingerprint(hashes: np.ndarray, block: int = 1 << 15) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), block):
        part = np.ascontiguousarray(hashes[at : at + block], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 3) -> DataFrame:
    """id, fp (the 64 bits as a signed long). A null text has no words, like an empty one: fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(shingle_hashes(word_bytes(t), k)) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(settled(run), f"id {kind}, fp long")


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits of a word; by syndrome, up to six error patterns and their number, nearest first."""

    def syndrome(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - 11)
        return x

    low, high = np.array([syndrome(x) for x in range(4096)], np.int64), np.array([syndrome(x << 12) for x in range(2048)], np.int64)
    bits = [1 << i for i in range(23)]
    of = np.array([syndrome(b) for b in bits])
    patterns: list[list[int]] = [[] for _ in range(2048)]
    patterns[0].append(0)
    from itertools import combinations

    for weight in (1, 2, 3, 4):
        for at in combinations(range(23), weight):
            s = int(np.bitwise_xor.reduce(of[list(at)]))
            if weight < 4 or len(patterns[s]) >= 1 and bin(patterns[s][0]).count("1") == 3:
                patterns[s].append(sum(bits[i] for i in at))
    errors, count = np.zeros((2048, 6), np.int64), np.array([len(p) for p in patterns])
    for s, p in enumerate(patterns):
        errors[s, : len(p)] = p
    return low, high, errors, count


def codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """12-bit indices of the nearest codeword and, for words at distance three, of the five at distance four; how many there are."""
    low, high, errors, count = _tables()
    s = low[words & 4095] ^ high[words >> 12]
    return (words[:, None] ^ errors[s]) >> 11, count[s]


def fuzzy_keys(fps: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(row, key) for the probing and for the indexed side. A key's top bits say which segments it is made of."""
    u = fps.view(np.uint64)
    seg = [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    idx, cnt = zip(*(codewords(s) for s in seg))
    rows = np.arange(len(fps))
    six = np.arange(6)
    probe, index, kind = [], [], 0
    for i in range(3):
        for j in range(3):
            if i == j:
                continue
            kind += 1
            base = np.int64(kind << 40) + (seg[i] << 12)
            ok = six[None, :] < cnt[j][:, None]
            probe.append((np.broadcast_to(rows[:, None], ok.shape)[ok], (base[:, None] + idx[j])[ok]))
            index.append((rows, base + idx[j][:, 0]))
    base = np.int64(7 << 40)
    ok = (six[None, :, None] < cnt[0][:, None, None]) & (six[None, None, :] < cnt[1][:, None, None])
    both = base + (idx[0][:, :, None] << 24) + (idx[1][:, None, :] << 12) + idx[2][:, :1, None]
    probe.append((np.broadcast_to(rows[:, None, None], ok.shape)[ok], both[ok]))
    ok = six[None, :] < cnt[2][:, None]
    last = base + (idx[0][:, :1] << 24) + (idx[1][:, :1] << 12) + idx[2]
    index.append((np.broadcast_to(rows[:, None], ok.shape)[ok], last[ok]))
    return tuple(tuple(map(np.concatenate, zip(*x))) for x in (probe, index))


def _keys(fps: DataFrame, side: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy()
            for at in range(0, len(own), 2048):
                part = own[at : at + 2048]
                rows, keys = fuzzy_keys(part)[side]
                yield pa.RecordBatch.from_arrays([pa.array(part[rows]), pa.array(keys)], ["fp", "key"])

    return fps.select("fp").mapInArrow(settled(run), "fp long, key long")


def links(fps: DataFrame, radius: int = RADIUS, crowd: int = 64, tile: int = 2048) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) of at most radius bits, enough of them to connect all that all would connect.

    A key with at most crowd indexed fingerprints is joined; of a crowded key, each pair of tiles of about tile fingerprints gives a forest.
    """
    if radius > RADIUS:
        raise ValueError(f"the keys find pairs within {RADIUS} bits")
    probe, index = _keys(fps, 0), _keys(fps, 1)
    crowded = materialize(index.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).withColumnRenamed("key", "of"), "crowded")
    few = index.join(crowded, F.col("key") == F.col("of"), "left_anti").select(F.col("fp").alias("b"), F.col("key").alias("of"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= radius
    joined = probe.join(few, (F.col("key") == F.col("of")) & (F.col("fp") < F.col("b")) & near).select(F.col("fp").alias("a"), "b")

    tiles = F.ceil(F.col("n") / tile).cast("int")
    member = probe.unionAll(index).join(crowded, F.col("key") == F.col("of")).select("fp", "key", tiles.alias("tiles")).distinct()
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = member.select("fp", "key", own.alias("own"), other.alias("other")).select("fp", "key", F.least("own", "other").alias("s"), F.greatest("own", "other").alias("t"))

    def grow(group: pa.Table) -> pa.Table:
        a, b = forest(group.column("fp").to_numpy(), radius)
        return pa.table({"a": a, "b": b})

    return joined.unionAll(dealt.groupBy("key", "s", "t").applyInArrow(grow, "a long, b long"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hexadecimal digits), component_id.

    component_id is the least id that links of at most radius differing bits lead to, itself included. Texts without words, null
    among them, have fingerprint zero, which links like any other. Repeated rows and ties are rows like others; null ids count as
    larger than any. An empty table gives an empty result; further columns are not looked at.
    """
    printed = materialize(fingerprints(docs, id_col, text, k), "fingerprints")
    distinct = materialize(printed.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    found = components(links(distinct, radius)).withColumnRenamed("node", "fp_")
    joined = distinct.join(found, F.col("fp") == F.col("fp_"), "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    joined = materialize(joined, "labels")
    least = joined.groupBy("label").agg(F.min("first").alias("component_id")).withColumnRenamed("label", "of")
    by_fp = joined.join(least, F.col("label") == F.col("of")).select(F.col("fp").alias("fp_"), "component_id")
    out = printed.join(by_fp, F.col("fp") == F.col("fp_"))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each of near_dedup's groups: that of the least id. Rows that share an id stay or go together. The pipeline has `minhash.keep_one`."""
    return without(docs, near_dedup(docs, id_col, text).filter(f"not {id_col} <=> component_id").select(id_col), id_col)
