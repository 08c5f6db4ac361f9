"""Near copies by the similarity of sets of five-word shingles: SimHash with Golay keys, and MinHash bands, find candidates, the sets themselves decide.

Fingerprints of five-word shingles go through the Golay keys of simhash.py, which find all pairs within three bits. At a similarity of 0.8, though, 9.7 of 64 bits
differ on average, and a key for so many errors would be shared by everything; so MinHash bands find the pairs farther apart.

A text is the set of the hashes of its runs of five words. Of each of BANDS times ROWS permutations of the hashes a set has a least one; two sets of
similarity s have the same in a share s of them, so some band of ROWS agrees with a chance of 1 - (1 - s^ROWS)^BANDS: at 0.8 all but 4 in ten million.
Every candidate is verified on the whole sets, so no pair below the similarity links.

Equal sets are one node, whatever number of documents has them. A key with many nodes is not joined with itself: tiles of it, dealt over tasks,
hand on the links of a spanning forest instead of all pairs. The sets of candidates only are computed again, all others never leave their task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, settled, without
from .components import components
from .simhash import fingerprint, shingle_hashes, word_bytes
from .simhash import links as golay_links

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 28, 4
#: Fixed odd factors: a permutation of 64-bit values each, and those that mix a band's values into its key.
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.random.default_rng(43).integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
#: Nodes of a key that are joined; shingles of a tile of a key that has more.
CROWD, TILE = 64, 1 << 19


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's shingles, each once, in order."""
    return np.unique(shingle_hashes(word_bytes(text), k))


def band_keys(own: np.ndarray, block: int = 1 << 12) -> np.ndarray:
    """A key for each band; none for an empty set."""
    if not len(own):
        return np.empty(0, np.uint64)
    least = np.full(len(_FACTORS), ~np.uint64(0))
    for at in range(0, len(own), block):
        np.minimum(least, (_FACTORS[:, None] * own[None, at : at + block]).min(axis=1), out=least)
    mixed = ((least.reshape(BANDS, ROWS) ^ (least.reshape(BANDS, ROWS) >> np.uint64(29))) * _MIX).sum(axis=1, dtype=np.uint64)
    return mixed ^ (mixed >> np.uint64(32))


def _print(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.astype("<u8").tobytes())


def _prints(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, print (128 bits that stand for the set), n (its size), keys, fp (the SimHash of the shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                prints, sizes, keys, fps = [], [], [], []
                for t in part.column(1):
                    every = shingle_hashes(word_bytes(t.as_py()), SHINGLE)
                    own = np.unique(every)
                    fps.append(fingerprint(every))
                    prints.append(_print(own))
                    sizes.append(len(own))
                    keys.append(band_keys(own).view(np.int64))
                cells = [pa.array(prints, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(np.array(fps, np.uint64).view(np.int64))]
                yield pa.RecordBatch.from_arrays([part.column(0), *cells], ["id", "print", "n", "keys", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(settled(run), f"id {kind}, print binary, n long, keys array<long>, fp long")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text: str) -> DataFrame:
    """node, own (its set) of each node in wanted (node, print, first: an id that has it). Of rows that share the id, one with the print is taken."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    again = texts.join(wanted.select(F.col("first").alias("first_")).distinct(), F.col("id").eqNullSafe(F.col("first_")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                sets = [shingle_set(t.as_py()) for t in b.column(0).slice(at, 256)]
                yield pa.RecordBatch.from_arrays([pa.array(map(_print, sets), pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["print_", "own"])

    found = again.mapInArrow(settled(run), "print_ binary, own array<long>").join(wanted, F.col("print_") == F.col("print"))
    return found.groupBy("node").agg(F.any_value("own").alias("own"))


def set_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph over sets (in order, no value twice) that joins those of at least that similarity."""
    sizes, out = np.array([len(s) for s in sets], np.int64), []
    left = np.arange(len(sets))
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            fits = np.minimum(sizes[left], sizes[x]) >= similarity * np.maximum(sizes[left], sizes[x])
            some = left[fits]
            if not len(some):
                continue
            flat = np.concatenate([sets[i] for i in some])
            at = np.minimum(np.searchsorted(sets[x], flat), sizes[x] - 1)
            shared = np.add.reduceat(sets[x][at] == flat, np.concatenate([[0], np.cumsum(sizes[some])[:-1]]), dtype=np.int64)
            found = some[shared / (sizes[some] + sizes[x] - shared) >= similarity]
            if len(found):
                out += [(int(x), int(i)) for i in found]
                todo.extend(found)
                left = left[~np.isin(left, found)]
    return out


def golay_pairs(nodes: DataFrame, similarity: float) -> DataFrame:
    """a, b: nodes (node, n, fp) whose fingerprints are within three bits, of each fingerprint one; and each node with the least of its fingerprint."""
    filled = nodes.filter("n > 0").select("node", "n", "fp")
    one = materialize(filled.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("of")), "by-fp")
    of = lambda name: one.select(F.col("fp").alias(f"{name}_"), F.col("of").alias(name))
    met = golay_links(one.select("fp")).join(of("x"), F.col("a") == F.col("x_")).join(of("y"), F.col("b") == F.col("y_")).select("x", "y")
    same = filled.join(of("x"), F.col("fp") == F.col("x_")).select("x", F.struct("node", "n").alias("y")).filter("x.node <> y.node")
    fits = F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n")
    return met.unionAll(same).filter(fits).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def links(docs: DataFrame, nodes: DataFrame, similarity: float, id_col: str, text: str, crowd: int = CROWD, tile: int = TILE) -> DataFrame:
    """a, b: links between nodes (node, print, first, n, keys, fp) of at least that similarity, enough of them to connect all that all would connect.

    A key with at most crowd nodes is joined; of a crowded key, each pair of tiles of about tile shingles gives a forest.
    """
    keyed = materialize(nodes.select("node", "n", F.explode("keys").alias("key")), "keys")
    counts = keyed.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("total")).filter("c > 1").withColumnRenamed("key", "of")
    counts = materialize(counts, "key-counts")
    few, crowded = counts.filter(F.col("c") <= crowd).select("of"), counts.filter(F.col("c") > crowd).select("of", F.ceil(F.col("total") / tile).cast("int").alias("tiles"))
    met = keyed.join(few, F.col("key") == F.col("of")).select("node", "n", "key")
    other = met.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("key").alias("key_"))
    fits = F.least("n", "m") >= similarity * F.greatest("n", "m")
    banded = met.join(other, (F.col("key") == F.col("key_")) & (F.col("node") < F.col("b")) & fits).select(F.col("node").alias("a"), "b")
    pairs = materialize(banded.unionAll(golay_pairs(nodes, similarity)).distinct(), "pairs")
    member = materialize(keyed.join(crowded, F.col("key") == F.col("of")).select("node", "key", "tiles"), "members")

    needed = pairs.select(F.col("a").alias("node_")).unionAll(pairs.select("b")).unionAll(member.select("node")).distinct()
    wanted = materialize(nodes.select("node", "print", "first").join(needed, F.col("node") == F.col("node_"), "left_semi"), "wanted")
    sets = materialize(_sets(docs, wanted, id_col, text), "sets")

    x, y = sets.select(F.col("node").alias("x"), F.col("own").alias("xs")), sets.select(F.col("node").alias("y"), F.col("own").alias("ys"))
    shared = pairs.join(x, F.col("a") == F.col("x")).join(y, F.col("b") == F.col("y"))
    shared = shared.select("a", "b", F.size(F.array_intersect("xs", "ys")).alias("i"), (F.size("xs") + F.size("ys")).alias("of"))
    joined = shared.filter(F.col("i") / (F.col("of") - F.col("i")) >= similarity).select("a", "b")

    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = member.select("node", "key", own.alias("o"), others.alias("p")).select("node", "key", F.least("o", "p").alias("s"), F.greatest("o", "p").alias("t"))
    dealt = dealt.join(x, F.col("node") == F.col("x")).select("key", "s", "t", "node", "xs")

    def grow(group: pa.Table) -> pa.Table:
        at = group.column("node").to_numpy()
        found = set_forest([np.sort(c.values.to_numpy()) for c in group.column("xs")], similarity)
        return pa.table({"a": pa.array([at[i] for i, _ in found], pa.int64()), "b": pa.array([at[j] for _, j in found], pa.int64())})

    return joined.unionAll(dealt.groupBy("key", "s", "t").applyInArrow(grow, "a long, b long"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, crowd: int = CROWD, tile: int = TILE) -> DataFrame:
    """One row per row of docs: id, component_id: the least id that links lead to, itself included.

    Two texts link if the sets of their five-word shingles have at least that similarity (shared over all). A text of fewer than five words is one shingle
    and meets only its equal; texts without words, null among them, are equal. Null ids count as larger than any. An empty table gives an empty result.
    """
    printed = materialize(_prints(docs, id_col, text), "prints")
    # numbers are fixed once they are written
    nodes = printed.groupBy("print").agg(F.min("id").alias("first"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys"), F.any_value("fp").alias("fp"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = components(links(docs, nodes, similarity, id_col, text, crowd, tile)).withColumnRenamed("node", "node_")
    joined = nodes.join(found, F.col("node") == F.col("node_"), "left").select("print", "first", F.coalesce("label", "node").alias("label"))
    joined = materialize(joined, "labels")
    least = joined.groupBy("label").agg(F.min("first").alias("component_id")).withColumnRenamed("label", "of")
    by_print = joined.join(least, F.col("label") == F.col("of")).select(F.col("print").alias("print_"), "component_id")
    out = printed.select("id", "print").join(by_print, F.col("print") == F.col("print_"))
    return out.select(F.col("id").alias(id_col), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group of near copies: that of the least id. Rows that share an id stay or go together; null ids go if another id has a copy; texts without words are copies of each other."""
    return without(docs, near_copies(docs, id_col, text).filter(f"not {id_col} <=> component_id").select(id_col), id_col)
