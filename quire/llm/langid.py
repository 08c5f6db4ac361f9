"""Language identification by a string kernel.

A text is the set of its blended-spectrum n-grams (2 to 4 characters, lower case, everything but letters one boundary mark), hashed
into BUCKETS. The kernel is the number of shared n-grams over the geometric mean of the numbers of either. Kernel ridge regression, one language
versus the rest, is solved on Nystroem landmarks: labelled texts that a hash of the id picks. Its scores for a batch of texts are one product of
their presence matrix with the landmarks' weighted presence, so a text is never compared landmark by landmark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, settled, text_slices, without

SPECTRUM = (2, 3, 4)
BUCKETS = 1 << 16
#: Labelled texts of each language that the fit takes on average, however many there are, and those of them that are landmarks.
FIT_ROWS, LANDMARKS = 500, 64
#: Texts of all languages, above which each language has fewer, LEAST_ROWS at least.
ALL_ROWS, LEAST_ROWS = 8000, 8
#: Landmarks in all, above which each language has fewer, one at least; languages that are scored together.
ALL_LANDMARKS, LANGUAGE_BLOCK = 1024, 64
RIDGE = 1e-3
#: Characters and texts that are looked at together.
SLICE_CHARS, SLICE_ROWS = 300_000, 64


@cache
def _letters() -> np.ndarray:
    """By code point: 0 for what isn't a letter, else the code point of its lower case."""
    return np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint32)


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and buckets of the n-grams that are in each text, each once, in order; nothing for a text without letters."""
    table, sizes = _letters(), np.array([len(t) + 2 for t in texts])
    flat = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "replace"), np.uint32)
    codes = table[flat]
    row = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    keep = (codes > 0) | np.concatenate([[True], codes[:-1] > 0]) | np.concatenate([row[1:] != row[:-1], [True]]) if len(codes) else np.zeros(0, bool)
    codes, row = codes[keep], row[keep]
    lettered = np.zeros(len(texts), bool)
    lettered[row[codes > 0]] = True
    seen = np.zeros(len(texts) * BUCKETS, bool)
    base = row * BUCKETS
    for n in SPECTRUM:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, 0x9E3779B1 * n & 0xFFFFFFFF, np.uint32)
        for i in range(n):
            h = (h ^ codes[i : len(codes) - n + 1 + i]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        ok = row[: len(h)] == row[n - 1 :]
        seen[(base[: len(h)] + (h & np.uint32(BUCKETS - 1)))[ok]] = True
    seen = seen.reshape(len(texts), BUCKETS)
    seen[~lettered] = False
    return np.nonzero(seen)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages: the landmarks' presence times the dual weights

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores by language, and the number of n-grams of each text."""
        rows, buckets = presence(texts)
        size = np.bincount(rows, minlength=len(texts))
        out = np.zeros((len(texts), len(self.languages)))
        filled = np.flatnonzero(size)
        if len(filled):
            starts = np.concatenate([[0], np.cumsum(size[filled])[:-1]])
            for at in range(0, len(self.languages), LANGUAGE_BLOCK):
                some = self.weights[:, at : at + LANGUAGE_BLOCK]
                out[filled, at : at + LANGUAGE_BLOCK] = np.add.reduceat(some[buckets], starts, axis=0) / np.sqrt(size[filled])[:, None]
        return out, size


def fit(grams: list[np.ndarray], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """grams: the buckets of each text. The first landmarks texts of each language stand for it, fewer if there are many languages."""
    names = sorted(set(languages))
    landmarks = max(1, min(landmarks, ALL_LANDMARKS // max(1, len(names))))
    step = -(-len(names) // ALL_LANDMARKS)  # of so many languages one has a landmark
    of, own = {name: i for i, name in enumerate(names)}, [[] for _ in names]
    y = np.array([of[x] for x in languages])
    for i, k in enumerate(y):
        own[k].append(i)
    marks = [i for some in own[:: max(1, step)] for i in some[:landmarks]]

    def dense(some: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(some), BUCKETS), np.float32)
        for i, g in enumerate(some):
            out[i, g] = 1 / np.sqrt(len(g))
        return out

    b = dense([grams[i] for i in marks])
    k_mm = (b @ b.T).astype(float)
    squares, sums = np.zeros((len(marks), len(marks))), np.zeros((len(names), len(marks)))
    for at in range(0, len(grams), 128):
        k_nm = (dense(grams[at : at + 128]) @ b.T).astype(float)
        squares += k_nm.T @ k_nm
        np.add.at(sums, y[at : at + 128], k_nm)
    alpha = np.linalg.solve(squares + ridge * len(grams) * (k_mm + 1e-6 * np.eye(len(marks))), sums.T)
    return Model(names, (b.T @ alpha).astype(np.float32))


def learn(docs: DataFrame, held_out_of: int = 5, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """A model of the rows with a language whose CRC-32 of the id isn't a multiple of held_out_of; None without such rows.

    The fit is bounded: of each language the fit_rows rows of least place, a hash of id and text, fewer if all languages together had more than ALL_ROWS, but LEAST_ROWS of each at least. Rows that agree in both
    are one example. So what is learned hangs on no id, and a language has all of its examples if they are that few.
    """
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % held_out_of != 0))
    place = F.shiftrightunsigned(F.xxhash64(id_col, text), 11).cast("double") / 2.0**53
    own = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), place.alias("place"))
    shares = materialize(own.groupBy(F.col("lang").alias("lang_")).agg(F.approx_count_distinct("place", 0.02).alias("n")), "languages")
    each = min(fit_rows, max(LEAST_ROWS, ALL_ROWS // max(1, shares.count())))
    # about twice as many examples as are wanted, and then the first of them
    shares = materialize(shares.select("lang_", F.least(F.lit(1.0), (2 * each + 64) / F.col("n")).alias("share_")), "shares")
    some = own.join(shares, (F.col("lang") == F.col("lang_")) & (F.col("place") < F.col("share_"))).groupBy("lang", "place").agg(F.min("text").alias("text"))
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place"))).filter(F.col("rank") <= each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some, texts in text_slices(b, 1, SLICE_CHARS, SLICE_ROWS):
                r, g = presence(texts)
                cells = [g[r == i].astype(np.int32) for i in range(len(texts))]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(cells, pa.list_(pa.int32())), some.column(2)], ["lang", "grams", "place"])

    picked = first.select("lang", "text", "place").mapInArrow(settled(run), "lang string, grams array<int>, place double")
    got = picked.toArrow()
    grams = [c.values.to_numpy() for c in got.column("grams")]
    rows = sorted((p, x, i) for i, (p, x) in enumerate(zip(got.column("place").to_pylist(), got.column("lang").to_pylist())) if len(grams[i]))
    return fit([grams[i] for _, _, i in rows], [x for _, x, _ in rows]) if rows else None


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, lang_pred, score (share of the language among the positive scores).

    und, with score 0, for a text that is null or has no letter, and for every text without a model. Repeated rows are rows like others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some, texts in text_slices(b, 1, SLICE_CHARS, SLICE_ROWS):
                names, shares = ["und"] * some.num_rows, np.zeros(some.num_rows)
                if model is not None:
                    raw, size = model.scores(texts)
                    raw = np.maximum(raw, 0)
                    best = raw.argmax(axis=1)
                    shares = np.where(size > 0, raw.max(axis=1) / np.maximum(raw.sum(axis=1), 1e-9), 0.0)
                    names = [model.languages[i] if n else "und" for i, n in zip(best, size)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(names, pa.string()), pa.array(shares.astype(float))], ["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(settled(run), f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def language_id(docs: DataFrame, held_out_of: int = 5, id_col: str = "doc_id") -> DataFrame:
    """Learn from docs and predict all of them: id, held_out (false for a null id, which is never learned from), lang_pred, score. An empty table gives an empty result."""
    found = identify(docs, learn(docs, held_out_of, id_col=id_col), id_col)
    return found.select(id_col, F.coalesce(F.crc32(F.col(id_col).cast("string")) % held_out_of == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.35, id_col: str = "doc_id") -> DataFrame:
    """docs whose language is found with a share of at least least; undetermined texts and those torn between languages go. Rows that share an id stay or go together, null ids too; without labelled rows all go."""
    return without(docs, language_id(docs, id_col=id_col).filter((F.col("lang_pred") == "und") | (F.col("score") < least)).select(id_col), id_col)
