"""SentencePiece encoding and decoding by suffix-array matching.

The texts of a batch fall into segments that no piece crosses: a run of spaces and what follows up to the next. Segments not met before are concatenated
and indexed by a suffix array, cut at the longest piece's length. Every piece of the vocabulary finds its range of suffixes by binary search, so
its occurrences are edges over the concatenated text. Edges are sorted by position and then relaxed. For a unigram vocabulary that is the best path
by score. A BPE vocabulary asks for something else, as its pieces come from merges and not from the best sum: there, of each segment, the best
edge over two neighbouring tokens contracts them, leftmost first among equals, until no edge spans two; that gives exactly the merges' result.

Characters without a piece become byte pieces, or the unknown id if the vocabulary has none. The model file is read here; it is never trained.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, whole
from .kept import Kept, gather

#: Fixed values of the model file's format: model types, and types of pieces.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + n]
            at += n


class Vocabulary:
    def __init__(self, pieces: list[tuple[str, float, int]], kind: int, dummy_prefix: bool = True) -> None:
        self.pieces, self.kind, self.dummy_prefix = pieces, kind, dummy_prefix
        if any(t == USER for _, _, t in pieces):
            raise ValueError("user-defined pieces aren't supported")
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.bytes = {int(p[0][3:5], 16): i for i, p in enumerate(pieces) if p[2] == BYTE}
        own = [(p, i) for i, (p, _, t) in enumerate(pieces) if t == NORMAL and p]
        #: No piece has a space after another character, so segments can be encoded one by one.
        self.parts = all(SPACE not in p.lstrip(SPACE) for p, _ in own)
        self.scores = np.array([p[1] for p in pieces])
        self.depth = max((len(p) for p, _ in own), default=1)
        #: Characters of pieces have ranks from 1 on; all others share the one that no piece has.
        self.letters = np.array(sorted({ord(c) for p, _ in own for c in p}), np.uint32)
        #: Ranks that a key of 64 bits holds; their number without a piece, and the one above all.
        self.per = 4 if len(self.letters) < (1 << 16) - 2 else 2
        self.most = (1 << 64 // self.per) - 1
        self.ids = np.array([i for _, i in own], np.int64)
        self.lengths = np.array([len(p) for p, _ in own], np.int64)
        self.levels = -(-self.depth // self.per)
        grid = np.zeros((len(own), self.levels * self.per), np.uint64)
        for row, (p, _) in enumerate(own):
            grid[row, : len(p)] = self.ranks(np.array([ord(c) for c in p], np.uint32))
        self.low = [packed([grid[:, a + j] for j in range(self.per)]) for a in range(0, grid.shape[1], self.per)]
        grid[np.arange(grid.shape[1])[None, :] >= self.lengths[:, None]] = self.most
        self.high = [packed([grid[:, a + j] for j in range(self.per)]) for a in range(0, grid.shape[1], self.per)]
        self.texts = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, t in pieces]

    @classmethod
    def read(cls, data: bytes) -> Vocabulary:
        pieces, kind, prefix = [], UNIGRAM, True
        for number, value in _fields(data):
            if number == 1:
                p = dict(_fields(value))
                pieces.append((p[1].decode(), struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0], p.get(3, NORMAL)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                norm = dict(_fields(value))
                prefix = bool(norm.get(3, 1))
                if norm.get(2) or norm.get(4, 1) or not norm.get(5, 1):
                    raise ValueError("only models without normalisation are supported")
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        return cls(pieces, kind, prefix)

    def ranks(self, points: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        return np.where(self.letters[at] == points, at + 1, self.most - 1).astype(np.uint64)


def packed(ranks: list[np.ndarray]) -> np.ndarray:
    """Ranks side by side in 64 bits, the first on top."""
    out, bits = ranks[0], np.uint64(64 // len(ranks))
    for r in ranks[1:]:
        out = (out << bits) | r
    return out


class SuffixArray:
    """Of a sequence of ranks with 0 between segments, sorted by the first levels times per ranks."""

    def __init__(self, ranks: np.ndarray, levels: int, per: int = 4) -> None:
        padded, n = np.concatenate([ranks, np.zeros(per * levels, np.uint64)]), len(ranks)
        every = packed([padded[j : len(padded) - per + 1 + j] for j in range(per)])
        keys = [every[per * i : per * i + n] for i in range(levels)]
        order = np.argsort(keys[0])
        sorted_ = [keys[0][order]]
        # ties of the first level are broken by the others
        tie = np.concatenate([[False], sorted_[0][1:] == sorted_[0][:-1]])
        tied = tie | np.concatenate([tie[1:], [False]]) if n else tie
        if tied.any():
            at = np.flatnonzero(tied)
            some = order[at]
            order[at] = some[np.lexsort([*(k[some] for k in keys[:0:-1]), keys[0][some]])]
        self.order, self.keys = order, [sorted_[0], *[k[order] for k in keys[1:]]]

    def bounds(self, wanted: list[np.ndarray], right: bool) -> np.ndarray:
        """By wanted key, how many suffixes are less than it (right: or equal)."""
        lo = np.searchsorted(self.keys[0], wanted[0], "left")
        hi = np.searchsorted(self.keys[0], wanted[0], "right")
        for level, (own, key) in enumerate(zip(self.keys[1:], wanted[1:]), 2):
            last = level == len(self.keys)
            lo, hi = self._within(own, key, lo, hi, False) if not (last and right) else lo, self._within(own, key, lo, hi, True) if not (last and not right) else hi
            if last:
                return hi if right else lo
        return hi if right else lo

    @staticmethod
    def _within(own: np.ndarray, key: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            middle = (lo[live] + hi[live]) // 2
            less = own[middle] <= key[live] if right else own[middle] < key[live]
            lo[live] = np.where(less, middle + 1, lo[live])
            hi[live] = np.where(less, hi[live], middle)
            live = live[lo[live] < hi[live]]
        return lo


def edges(vocabulary: Vocabulary, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and id of every piece's every occurrence, sorted by start, then length."""
    index = SuffixArray(ranks, vocabulary.levels, vocabulary.per)
    lo, hi = index.bounds(vocabulary.low, False), index.bounds(vocabulary.high, True)
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    start = index.order[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
    length = vocabulary.lengths[which]
    by = np.argsort(start * (vocabulary.depth + 1) + length)
    return start[by], length[by], vocabulary.ids[which[by]]


def _merge_long(lookup: np.ndarray, scores: np.ndarray, depth: int, lo: int, hi: int) -> list[tuple[int, int]]:
    """The contracted tokens (start, end) of one long segment, with a heap."""
    end, before = {i: i + 1 for i in range(lo, hi)}, {i: i - 1 for i in range(lo, hi)}
    heap: list[tuple[float, int, int]] = []

    def offer(i: int) -> None:
        if (j := end[i]) < hi and (n := end[j] - i) <= depth and (p := lookup[i, n - 1]) >= 0:
            heapq.heappush(heap, (-scores[p], i, end[j]))

    for i in range(lo, hi - 1):
        offer(i)
    while heap:
        _, i, e = heapq.heappop(heap)
        if i not in end or (j := end[i]) >= hi or end.get(j) != e:
            continue
        end[i] = e
        del end[j]
        if e < hi:
            before[e] = i
        offer(i)
        if before[i] >= lo:
            offer(before[i])
    return sorted(end.items())


def contract(vocabulary: Vocabulary, start: np.ndarray, length: np.ndarray, ids: np.ndarray, bounds: np.ndarray, long: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the tokens of every segment [bounds[k], bounds[k + 1] - 1); between segments lies one separator."""
    depth, scores, total = vocabulary.depth, vocabulary.scores, int(bounds[-1])
    lookup = np.full((total, depth), -1, np.int32)
    lookup[start, length - 1] = ids
    sizes = np.diff(bounds) - 1
    segment = np.repeat(np.arange(len(sizes)), np.diff(bounds))
    inside = np.ones(total, bool)
    inside[bounds[1:] - 1] = False
    done_s, done_e = [], []
    for k in np.flatnonzero(sizes > long):
        inside[bounds[k] : bounds[k + 1]] = False
        got = np.array(_merge_long(lookup, scores, depth, int(bounds[k]), int(bounds[k + 1]) - 1))
        done_s.append(got[:, 0])
        done_e.append(got[:, 1])
    s = np.flatnonzero(inside)
    e, g = s + 1, segment[s]
    while len(s) > 1:
        pair = g[:-1] == g[1:]
        span = e[1:] - s[:-1]
        fits = pair & (span <= depth)
        piece = np.where(fits, lookup[s[:-1], np.minimum(span, depth) - 1], -1)
        value = np.append(np.where(piece >= 0, scores[piece], -np.inf), -np.inf)
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        best = np.maximum.reduceat(value, first)
        counts = np.diff(np.append(first, len(g)))
        live = np.repeat(best > -np.inf, counts)
        if not live.any():
            break
        done_s.append(s[~live])
        done_e.append(e[~live])
        hit = np.flatnonzero((value == np.repeat(best, counts)) & live)
        own = g[hit]
        hit = hit[np.concatenate([[True], own[1:] != own[:-1]])]
        e[hit] = e[hit + 1]
        live[hit + 1] = False
        s, e, g = s[live], e[live], g[live]
    starts, ends = np.concatenate([*done_s, s]), np.concatenate([*done_e, e])
    by = np.argsort(starts)
    return starts[by], ends[by]


def best_path(vocabulary: Vocabulary, start: np.ndarray, length: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As contract(), for the path with the largest sum of scores; a character without a piece costs 10 more than the worst piece."""
    total, unknown = int(bounds[-1]), float(vocabulary.scores[vocabulary.ids].min()) - 10 if len(vocabulary.ids) else -10.0
    first = np.concatenate([[0], np.cumsum(np.bincount(start, minlength=total))])
    score, back = np.full(total + 1, -np.inf), np.full(total + 1, -1, np.int64)
    values = vocabulary.scores[ids]
    separators = {int(b) - 1 for b in bounds[1:]}
    for b in bounds[:-1]:
        score[b] = 0.0
    for i in range(total):
        if i in separators:
            continue
        single = False
        for k in range(first[i], first[i + 1]):
            j, single = i + length[k], single or length[k] == 1
            if score[i] + values[k] > score[j]:
                score[j], back[j] = score[i] + values[k], i
        if not single and score[i] + unknown > score[i + 1]:
            score[i + 1], back[i + 1] = score[i] + unknown, i
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:] - 1):
        j = int(hi)
        while j > lo:
            out.append((back[j], j))
            j = int(back[j])
    got = np.array(sorted(out), np.int64).reshape(-1, 2)
    return got[:, 0], got[:, 1]


def safe_cuts(start: np.ndarray, length: np.ndarray, most: int) -> np.ndarray:
    """The places from 1 to most that no edge (start, length) lies across. Edges that start before most must all be there."""
    cover = np.zeros(most + 2, np.int64)
    long = (length > 1) & (start < most)
    np.add.at(cover, start[long] + 1, 1)
    np.add.at(cover, np.minimum(start[long] + length[long], most + 1), -1)
    return np.flatnonzero(np.cumsum(cover[: most + 1]) == 0)[1:]


class Encoder:
    def __init__(self, vocabulary: Vocabulary, most: int = 400_000, block: int = 64_000) -> None:
        self.vocabulary, self._kept, self._block = vocabulary, Kept(most), block

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of each text's."""
        v = self.vocabulary
        texts = pc.replace_substring(texts.fill_null(""), SPACE, " ")
        filled = pc.binary_length(texts).to_numpy() > 0
        if not v.parts or not v.dummy_prefix:
            ids, sizes = self._ids([self._full(x) if x else "" for x in texts.to_pylist()])
            return ids, sizes
        parted = pc.split_pattern(texts, " ")
        docs = parted.offsets.to_numpy().astype(np.int64)
        docs -= docs[0]
        coded = parted.flatten().dictionary_encode()
        of, names = coded.indices.to_numpy(), coded.dictionary
        at = self._kept.places(names, lambda new: self._ids([self._full(x) for x in new.to_pylist()]))
        local, start, size = self._kept.flat, self._kept.start[at], self._kept.size[at]
        # spaces that follow each other belong to the word after them
        hollow = (pc.binary_length(names).to_numpy() == 0)[of]
        begins = np.zeros(len(of), bool)
        begins[docs[:-1]] = True
        begins[1:] |= ~hollow[:-1]
        runs = np.flatnonzero(begins)
        count = np.diff(np.append(runs, len(of)))
        first, sizes = start[of[runs]], size[of[runs]]
        joined = np.flatnonzero(count > 1)
        if len(joined):
            asked: dict[str, int] = {}
            which = np.array([asked.setdefault(" ".join(names.take(pa.array(of[a : a + n])).to_pylist()), len(asked)) for a, n in zip(runs[joined].tolist(), count[joined].tolist())])
            ids, own = self._ids([self._full(x) for x in asked])
            first[joined], sizes[joined] = (len(local) + np.cumsum(own) - own)[which], own[which]
            local = np.concatenate([local, ids])
        sizes[np.searchsorted(runs, docs[:-1][~filled])] = 0  # an empty text has no ids
        total = np.concatenate([[0], np.cumsum(sizes)])
        return gather(local, first, sizes), np.diff(total[np.searchsorted(runs, docs)])

    def _full(self, text: str) -> str:
        return (SPACE if self.vocabulary.dummy_prefix else "") + text.replace(" ", SPACE)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each of texts, which no piece crosses, in a row, and their numbers. Texts are matched in blocks; a longer one is cut where no piece crosses."""
        found: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        block, held = [], 0

        def match() -> None:
            nonlocal block, held
            if block:
                ids, own = self._match(block)
                found.append(ids)
                sizes.append(own)
            block, held = [], 0

        for x in texts:
            if len(x) > self._block:
                match()
                ids = np.concatenate([self._match(parts)[0] for parts in self._cut(x)])
                if not self.vocabulary.bytes:  # unknown characters in a row are one, also across a cut
                    ids = ids[np.concatenate([[True], (ids[1:] != self.vocabulary.unknown) | (ids[:-1] != self.vocabulary.unknown)])]
                found.append(ids)
                sizes.append(np.array([len(ids)]))
                continue
            block.append(x)
            held += len(x) + 1
            if held >= self._block:
                match()
        match()
        return (np.concatenate(found), np.concatenate(sizes)) if sizes else (np.empty(0, np.uint32), np.empty(0, np.int64))

    def _cut(self, text: str) -> Iterator[list[str]]:
        """A long text in parts that no piece crosses, as short as the pieces allow, about a block of them at a time."""
        v, at, most = self.vocabulary, 0, self._block
        while at < len(text):
            ranks = v.ranks(np.frombuffer(text[at : at + most + v.depth].encode("utf-32-le", "replace"), np.uint32))
            start, length, _ = edges(v, ranks)
            end = min(most, len(text) - at)
            cuts = safe_cuts(start, length, end)
            if len(cuts):  # the text's end is one
                places = [0, *cuts.tolist()]
                yield [text[at + a : at + b] for a, b in zip(places, places[1:])]
                at, most = at + places[-1], self._block
            else:
                most *= 2

    def _match(self, full: list[str]) -> tuple[np.ndarray, np.ndarray]:
        v = self.vocabulary
        points = np.frombuffer("\0".join([*full, ""]).encode("utf-32-le", "replace"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum([len(x) + 1 for x in full])])
        ranks = v.ranks(points)
        ranks[bounds[1:] - 1] = 0
        start, length, ids = edges(v, ranks)
        s, e = (contract if v.kind == BPE else best_path)(v, start, length, ids, bounds)
        at = np.searchsorted(start * (v.depth + 1) + length, s * (v.depth + 1) + (e - s))
        at = np.minimum(at, max(len(start) - 1, 0))
        found = (start[at] == s) & (length[at] == e - s) if len(start) else np.zeros(len(s), bool)
        token = np.where(found, ids[at] if len(start) else 0, -1)
        cuts = np.searchsorted(s, bounds)
        bare = np.flatnonzero(token < 0)
        n = np.ones(len(token), np.int64)
        if v.bytes:
            point = points[s[bare]]
            n[bare] = 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
        else:
            token[bare] = v.unknown
            again = np.zeros(len(token), bool)
            again[1:] = ~found[1:] & ~found[:-1]
            again[cuts[:-1][cuts[:-1] < len(token)]] = False
            n[again] = 0
        out = np.repeat(token, n)
        first = np.cumsum(n) - n
        if v.bytes and len(bare):
            own = np.frombuffer("".join(map(chr, point.tolist())).encode("utf-8", "replace"), np.uint8)
            table = np.array([v.bytes[c] for c in range(256)])
            out[np.repeat(first[bare] - (np.cumsum(n[bare]) - n[bare]), n[bare]) + np.arange(len(own))] = table[own]
        total = np.concatenate([[0], np.cumsum(n)])
        return out.astype(np.uint32), np.diff(total[cuts])

    def decode(self, ids: np.ndarray) -> str:
        out = b"".join(map(self.vocabulary.texts.__getitem__, ids.tolist()))
        return (out[1:] if self.vocabulary.dummy_prefix and out[:1] == b" " else out).decode("utf-8", "replace")


@cache
def encoder(path: str) -> Encoder:
    """One for each model file and worker process; later tasks of the process find its segments."""
    with open(path, "rb") as f:
        return Encoder(Vocabulary.read(f.read()))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _coded(batches: Iterator[pa.RecordBatch], model: str, batch_bytes: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches of (id, text) and the texts' ids, in parts of about batch_bytes; a longer text is a part by itself."""
    for b in batches:
        ends, at = np.cumsum(pc.binary_length(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while at < b.num_rows:
            till = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + batch_bytes, "right")))
            some = b.slice(at, till - at)
            ids, sizes = encoder(model).encode(some.column(1))
            yield some, np.split(ids, np.cumsum(sizes)[:-1])
            at = till


def encode_documents(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text: str = "text", batch_bytes: int = 2 << 20) -> DataFrame:
    """id, text, ids (unsigned 32-bit little-endian bytes) of every row. Null counts as empty and has no ids; texts are matched in batches of about batch_bytes."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, coded in _coded(batches, model, batch_bytes):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.astype("<u4").tobytes() for x in coded], pa.binary())], ["id", "text", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), whole(text).alias("text")).mapInArrow(settled(run), f"id {kind}, text string, ids binary")
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text), "ids")


def decode_documents(coded: DataFrame, model: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """id, text of the ids of every row; bytes that aren't UTF-8 become replacement characters, null ids an empty text."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                some = b.slice(at, 512)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([encoder(model).decode(np.frombuffer(x or b"", "<u4")) for x in some.column(1).to_pylist()], pa.string())], ["id", "text"])

    kind = coded.schema[id_col].dataType.simpleString()
    return coded.select(F.col(id_col).alias("id"), "ids").mapInArrow(settled(run), f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text: str = "text", batch_bytes: int = 2 << 20) -> DataFrame:
    """Encode and decode every row of docs: id, n_ids, ids_crc32 (of the little-endian ids), same (the decoded text is the text, its marks for spaces as spaces).

    Null counts as empty: no ids, and the same. Repeated rows are rows like others; an empty table gives an empty result.
    """
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, coded in _coded(batches, model, batch_bytes):
            same = [encoder(model).decode(x) == t.replace(SPACE, " ") for t, x in zip(b.column(1).to_pylist(), coded)]
            cells = [pa.array([len(x) for x in coded], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in coded], pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cells], ["id", "n_ids", "ids_crc32", "same"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), whole(text).alias("text")).mapInArrow(settled(run), f"id {kind}, n_ids long, ids_crc32 long, same boolean")
    return out.withColumnRenamed("id", id_col)
