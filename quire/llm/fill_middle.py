"""Fill-in-the-middle: texts cut in three at unit bounds and put together again in another order.

A text is encoded as the maximal runs of its characters' classes, with the number of units that end in each run and those before it. A cut after so many units
is found by binary search of the run whose cumulative count reaches it; its place in the run follows by arithmetic. Units are tokens (white space and the word after it, or
what white space ends the text) or code points. All texts of a slice are encoded together, over their UTF-8 bytes.

What the parts become is drawn from SHA-256 of the seed and the id, so a row is cut alike in every run, and a retried task writes the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled, whole

#: Marks before prefix, suffix and middle; percent of texts that are cut, and of these that put the suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SUFFIX_FIRST, SEED = 50, 80, 42
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Bytes of text that are encoded at once; a longer text is a slice by itself.
SLICE_BYTES = 4 << 20
_FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass
class Runs:
    """Maximal runs of one class, texts apart: where each ends (in bytes), whether it is white space, and the units that end up to and in it. bounds: of the texts, in bytes."""

    bounds: np.ndarray
    end: np.ndarray
    blank: np.ndarray
    units: np.ndarray
    #: Code points before each byte where units are code points, else None: a run is then one unit at most, which ends with it.
    points: np.ndarray | None

    @classmethod
    def of(cls, data: np.ndarray, bounds: np.ndarray, unit: str = "token") -> Runs:
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        first = np.zeros(len(data) + 1, bool)
        first[1:-1] = blank[1:] != blank[:-1]
        first[bounds] = True
        first[-1] = False
        start = np.flatnonzero(first)
        end = np.append(start[1:], len(data))[: len(start)]
        kind = blank[start]
        if unit == "token":
            closing = np.zeros(len(data) + 1, bool)
            closing[bounds[1:]] = True
            return cls(bounds, end, kind, np.cumsum(~kind | closing[end]), None)
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        return cls(bounds, end, kind, points[end], points)

    def before(self, place: np.ndarray) -> np.ndarray:
        """Units that end up to a text's bound."""
        run = np.searchsorted(self.end, place, "right") - 1
        return np.where(run >= 0, self.units[np.maximum(run, 0)] if len(self.units) else 0, 0)

    def cut(self, text: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The bytes after k units of each text."""
        goal = self.before(self.bounds[text]) + k
        if not len(self.end):
            return self.bounds[text]
        run = np.minimum(np.searchsorted(self.units, goal), len(self.end) - 1)
        if self.points is None:
            at = self.end[run]
        else:  # as many code points after the run's front as are missing there
            at = np.searchsorted(self.points, goal, "right") - 1
            at = np.minimum(at, self.end[run])
        return np.where(k > 0, at, self.bounds[text])


def draws(seed: int, ids: list) -> np.ndarray:
    """Four unsigned 32-bit numbers for each id: the first groups of eight hexadecimal digits of SHA-256 of the seed, a colon and the id; null is an empty id."""
    joined = b"".join(sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(joined, ">u4").reshape(-1, 4).astype(np.int64)


def _sliced(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        till = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, till
        at = till


def transformed(texts: pa.Array, ids: list, seed: int, rate: int, suffix_first: int, marks: tuple[str, str, str], unit: str) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of texts without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    raw = memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]]
    data, bounds = np.frombuffer(raw, np.uint8), offsets - offsets[0]
    runs = Runs.of(data, bounds, unit)
    own, of = draws(seed, ids), np.arange(len(texts))
    reached = runs.before(bounds)
    n = np.diff(reached)
    cuts = own[:, :2] % (n + 1)[:, None]
    low, high = runs.cut(of, cuts.min(axis=1)), runs.cut(of, cuts.max(axis=1))
    marked = np.zeros(len(texts), bool)
    for m in marks:
        marked |= pc.match_substring(texts, m).to_numpy(zero_copy_only=False)
    plain = (n == 0) | marked | (own[:, 2] % 100 >= rate)
    turned = own[:, 3] % 100 < suffix_first
    p, s, m = (x.encode() for x in marks)
    out = []
    for i, a, b, c, d in zip(of.tolist(), bounds[:-1].tolist(), low.tolist(), high.tolist(), bounds[1:].tolist()):
        if plain[i]:
            out.append(bytes(raw[a:d]))
        else:
            out.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c]) if turned[i] else (p, raw[a:b], s, raw[c:d], m, raw[b:c])))
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    form = np.where(plain, PLAIN, np.where(turned, SPM, PSM))
    count = lambda x, y: pa.array(points[y] - points[x], pa.int64(), mask=plain)
    return [pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), count(bounds[:-1], low), count(low, high), pa.array(out, pa.binary()).cast(pa.string())]


def fill_in_middle(
    docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), unit: str = "token",
    id_col: str = "doc_id", text: str = "text", slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Every row of docs as id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output, the text to train on.

    rate percent of texts are cut, suffix_first percent of these as spm. Empty and null texts (null counts as empty) and those that hold a mark stay plain, so restored() can always take an output apart.
    unit: token or char. Blank texts are one token. Rows that share an id, null ids too, share their draws and are cut each by its own units; repeated rows are rows like others. An empty table gives an empty result;
    columns of docs other than the id and the text are not looked at.
    """
    if unit not in ("token", "char"):
        raise ValueError("unit is token or char")
    if len(set(marks)) < 3 or any(len(x) < 2 or x[0] in x[1:] for x in marks) or len({x[0] for x in marks}) > 1:
        raise ValueError("three different marks that share their first character and have it nowhere else")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, till in _sliced(b.column(1), slice_bytes):
                ids = b.column(0).slice(at, till - at)
                cells = transformed(b.column(1).slice(at, till - at), b.column(2).slice(at, till - at).to_pylist(), seed, rate, suffix_first, marks, unit)
                yield pa.RecordBatch.from_arrays([ids, *cells], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), whole(text).alias("text"), F.col(id_col).cast("string").alias("key"))
    return own.mapInArrow(settled(run), f"id {kind}, {_FIELDS}").withColumnRenamed("id", id_col)


def restored(output: str | Column = "output", form: str | Column = "form", marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output was made of, from it and its form alone. A mark is where it was put: it shares nothing with what is beside it, as no character after its first is a first one."""
    out, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    p, s, m = (F.lit(x) for x in marks)
    after = lambda x, mark: F.split_part(x, mark, F.lit(2))
    upto = lambda x, mark: F.split_part(x, mark, F.lit(1))
    middle = after(out, m)
    psm = F.concat(after(upto(out, s), p), middle, upto(after(out, s), m))
    spm = F.concat(upto(after(out, p), m), middle, after(upto(out, p), s))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(out)


def fill_digest(docs: DataFrame) -> DataFrame:
    """fill_in_middle() with the SHA-256 of each output and of the text that is rebuilt from it: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return fill_in_middle(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored()).alias("restored_sha256"))
