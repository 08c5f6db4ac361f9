"""Alignment of two tokenizers over the same bytes.

Each vocabulary marks the bytes at which its tokens end, one bit a byte, packed in words of 64. The conjunction of both marks is where both end: the cuts. How many tokens end up to a
cut is the number of marks below it, a running count of the words' bits and a count within one word; so cuts become ranges of tokens of either side, groups, without a walk over the tokens. Links are then
expanded: pairs of tokens that end at one byte.

Links are counted over the whole corpus by pairs of ids. Pairs with at least a given share of all links are few, whatever the corpus, and are broadcast; the others have each few links, and meet their counts in a shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_pieces import PieceEncoder
from .common import materialize, settled, whole
from .kept import gather
from .spiece import default_model, encoder
from .token_files import default_tokenizer

#: Bytes of text that are aligned at once; a longer text by itself.
SLICE_BYTES = 2 << 20
#: Pairs that are broadcast hold at least the share of links that one in so many is: there can't be more of them.
HOT_PAIRS = 1 << 19


class TokenBytes:
    """The bytes of every id of a vocabulary, in one array."""

    def __init__(self, own: list[bytes]) -> None:
        self.size = np.array([len(x) for x in own], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(own) or b"\0", np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.start[ids], self.size[ids])


def _byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones of Latin-1 for themselves, the others, in order, from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def _first(path: str) -> tuple[PieceEncoder, TokenBytes]:
    """Of a byte-level file of the tokenizers library: an encoder that takes the strings of special tokens for text, and the bytes of its ids."""
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    letters, by_id = _byte_letters(), {t["id"]: t["content"].encode() for t in own.get("added_tokens") or []}
    vocabulary = own["model"]["vocab"]
    by_id = {i: bytes(map(letters.__getitem__, t)) for t, i in vocabulary.items() if i not in by_id} | by_id
    return PieceEncoder(path, special_as_text=True), TokenBytes([by_id.get(i, b"") for i in range(max(by_id) + 1)])


@cache
def _second(path: str) -> TokenBytes:
    return TokenBytes(encoder(path).vocabulary.texts)


class Marks:
    """Bits at given places of a sequence, packed in words, with running counts."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.below = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    @classmethod
    def at(cls, places: np.ndarray, size: int) -> Marks:
        bits = np.zeros(-(-size // 64) * 64, bool)
        bits[places] = True
        return cls(np.packbits(bits, bitorder="little").view("<u8"))

    def __and__(self, other: Marks) -> Marks:
        return Marks(self.words & other.words)

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many marks are up to and at each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        upto = self.words[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit))
        return self.below[word] + np.bitwise_count(upto)

    def select(self) -> np.ndarray:
        """The places of all marks."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


@dataclass
class Aligned:
    """Texts one after another: ids of both sides, and by group (text, byte of its cut, tokens up to it on both sides). *_size: tokens of each text."""

    a: np.ndarray
    b: np.ndarray
    a_size: np.ndarray
    b_size: np.ndarray
    text: np.ndarray
    cut: np.ndarray
    a_upto: np.ndarray
    b_upto: np.ndarray

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text and both ids of every link: the tokens that end at a cut are the last of its group."""
        return self.text, self.a[self.a_upto - 1], self.b[self.b_upto - 1]


def align(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray, a_bytes: TokenBytes, b_bytes: TokenBytes, data: np.ndarray, length: np.ndarray) -> Aligned:
    """Align the ids of texts whose bytes are data, length[i] each. A text that the tokens of a side don't spell has none."""
    texts = np.arange(len(length))

    def spelled(ids: np.ndarray, size: np.ndarray, own: TokenBytes) -> np.ndarray:
        made = np.bincount(np.repeat(texts, size), own.size[ids], len(length)).astype(np.int64)
        fits = made == length
        if fits.all():
            same = own.of(ids) == data
        else:
            same = own.of(ids[np.repeat(fits, size)]) == data[np.repeat(fits, length)]
        wrong = np.bincount(np.repeat(texts[fits], length[fits])[~same], minlength=len(length))
        return fits & (wrong == 0)

    good = (length > 0) & spelled(a, a_size, a_bytes) & spelled(b, b_size, b_bytes)
    a, b = a[np.repeat(good, a_size)], b[np.repeat(good, b_size)]
    a_size, b_size, length = np.where(good, a_size, 0), np.where(good, b_size, 0), np.where(good, length, 0)
    total = int(length.sum())
    a_marks = Marks.at(np.cumsum(a_bytes.size[a]) - 1, total)
    b_marks = Marks.at(np.cumsum(b_bytes.size[b]) - 1, total)
    cuts = (a_marks & b_marks).select()
    ends = np.cumsum(length)
    text = np.searchsorted(ends, cuts, "right")
    return Aligned(a, b, a_size, b_size, text, cuts + 1 - (ends - length)[text], a_marks.rank(cuts), b_marks.rank(cuts))


class _Printed:
    """Decimal ids with a mark behind each, in one array: at id * 4 + mark."""

    def __init__(self, most: int) -> None:
        own = [str(i).encode() + bytes([m]) for i in range(most) for m in b",|;\n"]
        self.size = np.array([len(x) for x in own], np.int64)
        self.start, self.flat = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(own), np.uint8)


@cache
def _printed(most: int) -> _Printed:
    return _Printed(most)


def group_digests(x: Aligned, most: int) -> list[str]:
    """SHA-256 of each text's groups as a1,a2|b1;a3|b2,b3, or an empty string without tokens. most: ids are below it."""
    before_a, before_b = np.concatenate([[0], x.a_upto[:-1]]), np.concatenate([[0], x.b_upto[:-1]])
    group = np.arange(len(x.cut))
    # a token's place in the print: the tokens of its own side before it, and those of the other side in earlier groups, or up to its own
    a_group, b_group = np.repeat(group, x.a_upto - before_a), np.repeat(group, x.b_upto - before_b)
    at_a, at_b = np.arange(len(x.a)) + before_b[a_group], np.arange(len(x.b)) + x.a_upto[b_group]
    coded = np.empty(len(x.a) + len(x.b), np.int64)
    coded[at_a], coded[at_b] = x.a.astype(np.int64) * 4, x.b.astype(np.int64) * 4
    coded[at_a[x.a_upto - 1]] += 1
    coded[at_b[x.b_upto - 1]] += 2
    table = _printed(most)
    sizes = table.size[coded]
    raw = memoryview(gather(table.flat, table.start[coded], sizes))
    at = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(x.a_size + x.b_size)])]
    return [sha256(raw[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(at[:-1].tolist(), at[1:].tolist())]


def _slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Slices of texts with a space before each text that isn't empty; and where they begin."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        till = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield at, texts.slice(at, till - at)
        at = till


def _encoded(own: PieceEncoder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    ids, sizes = [], np.zeros(len(texts), np.int64)
    for at, found, n in own.encode(texts):
        ids.append(found)
        sizes[at : at + len(n)] += n
    return np.concatenate(ids) if ids else np.empty(0, np.uint32), sizes


def aligned(texts: pa.Array, tokenizer: str, model: str) -> Iterator[tuple[int, int, Aligned]]:
    """Texts (no nulls), slice by slice: where it begins, how many texts it has, and their alignment. Both sides see a space before the text: the second adds it itself."""
    import pyarrow.compute as pc

    own, a_bytes = _first(tokenizer)
    for at, some in _slices(texts):
        filled = pc.binary_length(some).to_numpy(zero_copy_only=False) > 0
        spaced = pc.if_else(pa.array(filled), pc.binary_join_element_wise(pa.scalar(""), some, " "), some)
        offsets = np.frombuffer(spaced.buffers()[1], np.int32, len(spaced) + 1, 4 * spaced.offset).astype(np.int64)
        data = np.frombuffer(spaced.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        a, a_size = _encoded(own, spaced)
        b, b_size = encoder(model).encode(some)
        yield at, len(some), align(a, b, a_size, np.asarray(b_size, np.int64), a_bytes, _second(model), data, np.diff(offsets))


def _base(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), whole(text).alias("text"))


def align_documents(docs: DataFrame, tokenizer: str | None = None, model: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of docs as id, a and b (its ids on both sides), and groups: byte (of the space and the text, where both sides have a token's end), a_upto and b_upto (tokens up to there).

    A null or empty text, and one that either side doesn't spell byte by byte, has no ids and no groups. Strings of special tokens are text. Rows are taken one by one, repeated ones and those with null ids too.
    """
    tokenizer, model = tokenizer or default_tokenizer(), model or default_model()
    fields = ["id", "a", "b", "byte", "a_upto", "b_upto"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, x in aligned(batch.column(1), tokenizer, model):
                groups = np.bincount(x.text, minlength=n)
                a_front, b_front = np.cumsum(x.a_size) - x.a_size, np.cumsum(x.b_size) - x.b_size
                lists = lambda values, size: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(values.astype(np.int64), pa.int64()))
                cells = [lists(x.a, x.a_size), lists(x.b, x.b_size), lists(x.cut, groups), lists(x.a_upto - a_front[x.text], groups), lists(x.b_upto - b_front[x.text], groups)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *cells], fields)

    kind = docs.schema[id_col].dataType.simpleString()
    out = _base(docs, id_col, text).mapInArrow(settled(run), f"id {kind}, " + ", ".join(f"{f} array<long>" for f in fields[1:]))
    return out.select(F.col("id").alias(id_col), "a", "b", F.arrays_zip("byte", "a_upto", "b_upto").alias("groups"))


def aligned_digests(docs: DataFrame, tokenizer: str | None = None, model: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of docs as row (a number of its own), id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (the ids that its links hold, a * 2^32 + b, each once) and times (how many links each has)."""
    tokenizer, model = tokenizer or default_tokenizer(), model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at, n, x in aligned(batch.column(1), tokenizer, model):
                groups = np.bincount(x.text, minlength=n)
                width = len(_second(model).size)
                most = max(len(_first(tokenizer)[1].size), width)
                of, a, b = x.links()
                # a slice has less than 2^32 texts, and pairs of two vocabularies are less than 2^31 unless they are very large
                span = most * width
                if n * span < 1 << 63:
                    key, times = np.unique((of * span + a.astype(np.int64) * width) + b, return_counts=True)
                    owner, pair = key // span, key % span
                    pair = (pair // width << 32) | pair % width
                else:
                    key, times = np.unique(np.stack([of, a.astype(np.int64), b.astype(np.int64)]), axis=1, return_counts=True)
                    owner, pair = key[0], (key[1] << 32) | key[2]
                bounds = pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32())
                cells = [np.arange(row, row + n), batch.column(0).slice(at, n), x.a_size, x.b_size, groups, np.bincount(of, minlength=n)]
                row += n
                lists = [pa.ListArray.from_arrays(bounds, pa.array(pair, pa.int64())), pa.ListArray.from_arrays(bounds, pa.array(times, pa.int32()))]
                made = [c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in cells]
                yield pa.RecordBatch.from_arrays([*made, pa.array(group_digests(x, most), pa.string()), *lists], ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    kind = docs.schema[id_col].dataType.simpleString()
    numbers = "n_a long, n_b long, n_groups long, n_links long"
    return _base(docs, id_col, text).mapInArrow(settled(run), f"row long, id {kind}, {numbers}, groups_sha256 string, pairs array<long>, times array<int>")


def link_counts(digests: DataFrame) -> DataFrame:
    """pair, n (its links in the corpus) and best (no other pair of its second id has more)."""
    each = digests.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    each = materialize(each, "pairs")
    second = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = each.groupBy(second.alias("_b")).agg(F.max("n").alias("_most"))  # a row for each id of the second vocabulary
    return each.join(F.broadcast(most), second == F.col("_b")).select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def linked_tokens(docs: DataFrame, tokenizer: str | None = None, model: str | None = None, id_col: str = "doc_id", text: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Per row of docs: id, n_a, n_b, n_groups, n_links, n_best (links of a pair that is its second id's most frequent, ties too), count_sum (of the links' pairs' counts), groups_sha256.

    Null and empty texts, and those that a side doesn't spell, have zeros and an empty groups_sha256. An empty table gives an empty result; columns other than the id and the text aren't looked at.
    """
    own = materialize(aligned_digests(docs, tokenizer, model, id_col, text), "alignments")
    counts = materialize(link_counts(own), "counts")
    links = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") * hot_pairs >= links  # of hot_pairs pairs at most
    each = own.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair_"), F.col("x.times").alias("times"))
    common = each.join(F.broadcast(counts.filter(hot)), F.col("pair_") == F.col("pair"), "left")
    gains = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    told = common.filter("pair is not null").groupBy("row").agg(*gains)
    rare = counts.filter(~hot)
    if not rare.isEmpty():
        told = told.unionAll(common.filter("pair is null").select("row", "pair_", "times").join(rare, F.col("pair_") == F.col("pair")).groupBy("row").agg(*gains))
        told = told.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    told = told.withColumnRenamed("row", "row_")
    out = own.drop("pairs", "times").join(told, F.col("row") == F.col("row_"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
