"""Toxicity by a factorization machine over hashed terms.

Terms are a text's words in lower case and the beginnings of its words, so an inflected word shares a term with its kin; each is a 32-bit hash. The
fit takes a bounded sample of labelled texts, keeps the TERMS that say most about the label, and learns a weight and a vector of FACTORS for
each: the score adds the weights of the terms that are there and, over pairs, the products of their vectors. A pair such as an insult and the mention
of a group so counts for more, or less, than its parts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, settled, whole

_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the beginnings of words that are terms.
BEGINNINGS = (4, 5, 6)
#: Labelled rows that the fit takes at most, terms that it keeps at most, and length of the terms' vectors.
FIT_ROWS, TERMS, FACTORS = 12_000, 1024, 8
#: Terms below this G statistic, and those of fewer rows, say too little.
LEAST_G, LEAST_ROWS = 4.0, 3
THRESHOLD = 0.7


def word_terms(word: str) -> list[int]:
    crc = zlib.crc32
    return [crc(word.encode()), *[crc(b"^" + word[:n].encode()) for n in BEGINNINGS if len(word) >= n]]


def terms(text: str) -> np.ndarray:
    """The hashed terms of a text, each once, in order."""
    return np.unique(np.array([h for w in set(_WORD.findall(text.lower())) for h in word_terms(w)], np.uint32))


def informative(rows: DataFrame, most: int = TERMS, least: int = LEAST_ROWS) -> np.ndarray:
    """Of rows (y, terms), the terms with the largest G statistic against y, LEAST_G or more, of those that at least least rows have. Counted where the rows are; at most most come here."""
    total, pos = rows.agg(F.count("*"), F.sum("y")).first()
    counts = rows.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("ones")).filter(F.col("n") >= least)
    n, ones = F.col("n"), F.col("ones")

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)

    g = part(ones, n * pos / total) + part(n - ones, n * (total - pos) / total) + part(pos - ones, (total - n) * pos / total) + part(total - n - pos + ones, (total - n) * (total - pos) / total)
    best = counts.select("term", F.round(g, 9).alias("g")).filter(F.col("g") >= LEAST_G).orderBy(F.desc("g"), "term").limit(most)
    return np.sort(np.array([r[0] for r in best.collect()], np.uint32))


@dataclass
class Machine:
    hashes: np.ndarray  # sorted
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, own: np.ndarray) -> float:
        """own: places of a text's terms among the hashes."""
        v = self.vectors[own]
        z = self.bias + self.weights[own].sum() + 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def gradient(x: np.ndarray, y: np.ndarray, p: dict[str, np.ndarray], decay: float) -> tuple[float, dict[str, np.ndarray]]:
    """The mean logistic loss, with decay / 2 times the squares of weights and vectors, and its gradient by bias (b), weights (w) and vectors (v)."""
    v, w = p["v"].astype(x.dtype), p["w"].astype(x.dtype)
    xv = x @ v
    z = p["b"] + x @ w + 0.5 * ((xv**2).sum(axis=1) - x @ (v**2).sum(axis=1))
    z = np.clip(z, -40, 40)
    loss = float(np.mean(np.logaddexp(0, z) - y * z) + decay / 2 * ((p["w"] ** 2).sum() + (p["v"] ** 2).sum()))
    e = ((1 / (1 + np.exp(-z)) - y) / len(y)).astype(x.dtype)
    return loss, {"b": np.array([e.sum()]), "w": x.T @ e + decay * p["w"], "v": x.T @ (e[:, None] * xv) - v * (x.T @ e)[:, None] + decay * p["v"]}


def fit(rows: list[np.ndarray], labels: np.ndarray, hashes: np.ndarray, factors: int = FACTORS, rounds: int = 250, rate: float = 0.05, decay: float = 2e-5) -> Machine:
    """A machine over hashes (sorted), of the rows' terms among them. Logistic loss by full-batch Adam; deterministic."""
    x = np.zeros((len(rows), len(hashes)), np.float32)
    for i, r in enumerate(rows):
        x[i, np.searchsorted(hashes, r[np.isin(r, hashes)])] = 1
    base = (labels.sum() + 0.5) / (len(labels) + 1.0)
    p = {"b": np.array([np.log(base / (1 - base))]), "w": np.zeros(len(hashes)), "v": np.random.default_rng(0).normal(0, 0.01, (len(hashes), factors))}
    m, s = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for t in range(1, rounds + 1):
        if not len(hashes):
            break
        _, g = gradient(x, labels, p, decay)
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return Machine(hashes, float(p["b"][0]), p["w"], p["v"])


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> Machine | None:
    """A machine of the labelled documents whose CRC-32 of the id modulo 3 isn't 1, at most fit_rows of them, picked by a hash of the id; None without any. An id on several rows counts once, with the last of its texts in order."""
    usable = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 3 != 1))
    picked = usable.groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("double").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                cells = [terms(t).astype(np.int64) for t in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(cells, pa.list_(pa.int64()))], ["id", "y", "terms"])

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), whole(text).alias("text")).join(F.broadcast(picked), F.col("id") == F.col("_id"))  # at most fit_rows pairs of numbers
    one = own.groupBy("id").agg(F.max("text").alias("text"), F.max("y").alias("y"))
    known = materialize(one.mapInArrow(settled(run), f"id {kind}, y double, terms array<long>"), "terms")
    if known.isEmpty():
        return None
    hashes = informative(known)
    wanted = F.array(*[F.lit(int(h)) for h in hashes]).cast("array<long>") if len(hashes) else F.array().cast("array<long>")
    got = known.select("id", "y", F.array_intersect("terms", wanted).alias("terms")).toArrow().sort_by("id")  # so few terms of so few rows
    discard(docs.sparkSession, known)
    return fit([c.values.to_numpy().astype(np.uint32) for c in got.column("terms")], got.column("y").to_numpy(), hashes)


class _Places(dict):
    """Places of a word's terms among the machine's, for words seen so far."""

    def __init__(self, machine: Machine) -> None:
        super().__init__()
        self._at = {int(h): i for i, h in enumerate(machine.hashes)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(self._at[h] for h in word_terms(word) if h in self._at)
        if len(self) > 400_000:
            self.clear()
        self[word] = found
        return found


def toxicity(docs: DataFrame, machine: Machine | None, threshold: float = THRESHOLD, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, score, predicted (1 from threshold on). Whole texts; null counts as empty and gets the score of no terms.

    Without a machine, as there are no labelled rows, every score is 0. Repeated rows are rows like others; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(machine) if machine is not None else {}
        for b in batches:
            scores = np.zeros(b.num_rows)
            if machine is not None:
                for i, t in enumerate(b.column(1).to_pylist()):
                    own = {x for found in map(places.__getitem__, set(_WORD.findall(t.lower()))) if found for x in found}
                    scores[i] = machine.score(np.array(sorted(own), np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), whole(text).alias("text")).mapInArrow(settled(run), f"id {kind}, score double, predicted int")
    return out.withColumnRenamed("id", id_col)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Learn from the labels of docs and score all of docs: id, held_out (false for a null id, which is never learned from), score, predicted."""
    found = toxicity(docs, learn(docs, labels, id_col=id_col), id_col=id_col)
    return found.select(id_col, F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "score", "predicted")
