"""Benchmark decontamination by SimHash of item-sized windows (native).

A document is a sequence of hashed five-word shingles. Windows as long as an item are fingerprinted by SimHash. A radius that follows from the similarity
holds all but a few in a million of the fingerprints of windows that are similar enough; such a one agrees with the item's, up to one bit, in one of its blocks: the items' blocks
with each bit flipped form the index, and a window's blocks probe it for the items that its document may hold. What is within the radius is verified by the similarity of the
bags of shingles, the sum of the lesser over that of the larger counts.

Which items a document may hold, and where, is decided without loss (candidates()): it has one of an item's rarest shingles, and as many of all as the similarity asks for. A window whose first shingle isn't the
item's can slide right and gain; where no shingle of the item occurs twice, one whose preceding shingle is the item's can slide left and gain. So windows start at the first of adjacent shingles of the item,
or at each of them if one of them recurs in the document; at the document's end they are moved back, and a shorter document is one window. The item stays with its windows, so the number of
comparisons follows that of candidates and not the product of windows and items.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, discard, let, materialize, whole, without

SHINGLE, SIMILARITY = 5, 0.8
#: Deviations above the mean of fingerprints' distances that the radius takes in: all but two in a million.
DEVIATIONS = 4.6
#: A table below this many bytes goes to every task; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Rows of the map that keeps shingles of no item out of that shuffle, 64 bits each.
MAP_BITS = 20
_SPACES = " \t\n\x0b\x0c\r"


def radius(similarity: float) -> int:
    """Bits of 64 within which fingerprints of windows and items of that similarity are: bits differ with the angle of the bags, whose cosine is 2s / (1 + s) or more."""
    if not 0 < similarity <= 1:
        raise ValueError("a similarity above 0, up to 1")
    share = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return min(64, math.ceil(64 * share + DEVIATIONS * math.sqrt(64 * share * (1 - share))))


def placed_shingles(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """p and x for each row of docs and each place p, from 0, of its text: x is the hash of the k words from there on, as of shingles(). The columns other than text are kept.

    Words are zipped with those after them and hashed in a row each, so no lambda runs over them.
    """
    rest = [c for c in docs.columns if c != "text"]
    words = docs.select(*rest, F.split(F.btrim(F.lower(whole()), F.lit(_SPACES)), f"{ASCII_SPACE}+").alias("_w0"))
    ahead = words.select("*", *[F.slice("_w0", F.lit(i + 1), F.greatest(F.size("_w0") - i, F.lit(0))).alias(f"_w{i}") for i in range(1, k)])
    each = ahead.select(*rest, F.posexplode(F.arrays_zip(*[f"_w{i}" for i in range(k)])).alias("p", "c"))
    full = (F.col("c")[f"_w{k - 1}"].isNotNull() | (F.col("p") == 0)) & (F.col("c._w0") != "")
    return each.filter(full).select(*rest, "p", F.xxhash64(*[F.col("c")[f"_w{i}"] for i in range(k)]).alias("x"))


def shingles(text: str | Column = "text", k: int = SHINGLE) -> Column:
    """Hashes of each run of k words in lower case, of all words if they are fewer; none without words."""
    words = F.filter(F.split(F.lower(whole(text)), f"{ASCII_SPACE}+"), lambda w: w != "")
    runs = lambda own: F.transform(F.sequence(F.lit(1), F.greatest(F.size(own) - (k - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(own, i, F.lit(k))))
    return let(words, lambda own: F.when(F.size(own) > 0, runs(own)).otherwise(F.array().cast("array<long>")))


def simhash(hashes: Column) -> Column:
    """A bit is 1 if it is set in over half of the hashes. Sixteen longs of four 16-bit counters each count them; longer lists are counted in parts."""
    part = 32768
    mask = F.lit(0x0001000100010001)
    zero = F.lit(0).cast("long")

    def field(counters: Column, at: Column) -> Column:
        return F.call_function("shiftrightunsigned", counters, at).bitwiseAND(F.lit(0xFFFF))

    def ones(own: Column, lane: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(own), F.lit(1)), F.lit(part))
        sums = F.transform(starts, lambda at: F.aggregate(F.slice(own, at, F.lit(part)), zero, lambda s, h: s + F.call_function("shiftrightunsigned", h, lane).bitwiseAND(mask)))
        bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at + lane)
        majority = lambda c, at: 2 * F.aggregate(c, zero, lambda n, x: n + field(x, at)) > F.size(own)
        return let(sums, lambda c: F.aggregate(F.sequence(F.lit(0), F.lit(48), F.lit(16)), zero, lambda s, at: F.when(majority(c, at), s.bitwiseOR(bit(at))).otherwise(s)))

    return let(hashes, lambda own: F.aggregate(F.sequence(F.lit(0), F.lit(15)), zero, lambda s, lane: s.bitwiseOR(ones(own, lane))))


def _bounds(blocks: int) -> list[tuple[int, int]]:
    cuts = [64 * b // blocks for b in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def block_keys(fp: Column, flipped: bool, within: int) -> Column:
    """Block number and value, as one long; with flipped, also the values that differ in one bit. So many blocks that within errors leave one at most one."""
    out = []
    for number, (at, width) in enumerate(_bounds(within // 2 + 1)):
        value = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit(((1 << width) - 1) - (1 << 64 if width == 64 else 0)))
        one = lambda i: F.lit((1 << i) - (1 << 64 if i == 63 else 0))
        out += [F.xxhash64(F.lit(number), x) for x in ([value, *[value.bitwiseXOR(one(i)) for i in range(width)]] if flipped else [value])]
    return F.array(*out)


def bag_similarity(a: Column, b: Column) -> Column:
    """Sum of the lesser over the sum of the larger counts, of the elements of two arrays."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    shared = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(
        F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    )
    return let(shared, lambda n: n / (F.size(a) + F.size(b) - n))


def _small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, to be broadcast if its rows are few enough."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def _likely(shingled: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows of shingled (x) that may be in listed (h): a map of 2^MAP_BITS rows at most says which parts of the hashes occur, and drops nearly all others."""
    part, bit = (lambda h: F.shiftrightunsigned(h, 64 - MAP_BITS)), (lambda h: F.shiftrightunsigned(h, 58 - MAP_BITS).bitwiseAND(F.lit(63)).cast("int"))
    known = listed.select(part(F.col("h")).alias("part_"), F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("h"))).alias("m")).groupBy("part_").agg(F.bit_or("m").alias("bits_"))
    met = shingled.join(F.broadcast(known), part(F.col("x")) == F.col("part_"))
    return met.filter(F.call_function("shiftrightunsigned", "bits_", bit(F.col("x"))).bitwiseAND(F.lit(1)) == 1).drop("part_", "bits_")


def leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", item_col: str = "item_id", text: str = "text") -> DataFrame:
    """One row per document and item that it holds: id, item id, similarity (of the best window), start (its first word, from 0).

    Only windows with the item's number of shingles are compared, or the whole of a shorter document. Of windows of equal similarity the first counts. A null, empty or blank text, on either
    side, has no shingles and leaks nothing; a text of fewer than five words is one shingle and meets only its equal. Rows that repeat an id are
    looked at one by one and give one row an item together, likewise items that repeat an id. Empty tables give an empty result.
    """
    within = radius(similarity)
    goal = items.select(F.col(item_col).alias("item"), shingles(text).alias("goal")).filter(F.size("goal") > 0)
    goal = materialize(goal.distinct().withColumn("n", F.size("goal")).withColumn("g", F.xxhash64("item", "goal")), "items")
    listed = materialize(goal.select(F.explode("goal").alias("h")).distinct(), "item-shingles")
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(whole(text)).alias("t"), F.col(text).alias("text"))
    all_ = placed_shingles(own)
    known = _small(listed, 32)
    # an occurrence once, however many items have its shingle
    hits = (all_ if known is not listed else _likely(all_, listed)).join(known, F.col("x") == F.col("h")).select("id", "t", "p", "x")
    hits = materialize(hits.distinct(), "hits")

    # the hits of documents on the items that they may hold; a document's hits on one item are never more than its words
    near = materialize(candidates(hits, goal, similarity), "candidates")
    wanted_hits = near.join(goal.select(F.col("g").alias("g_"), "n", F.explode(F.array_distinct("goal")).alias("h")), F.col("g") == F.col("g_")).drop("g_")
    at = hits.select(F.col("id").alias("id_"), F.col("t").alias("t_"), "p", "x")
    met = materialize(wanted_hits.join(at, F.col("id").eqNullSafe(F.col("id_")) & (F.col("t") == F.col("t_")) & (F.col("h") == F.col("x"))).select("id", "t", "g", "n", "p", "h"), "met")
    line = Window.partitionBy("id", "t", "g", "n")
    recurs = met.groupBy("id", "t", "g", "n", "h").agg(F.count("*").alias("c")).groupBy("id", "t", "g", "n").agg(F.max("c").alias("most"), F.sum("c").alias("all"))
    recurs = recurs.filter(F.col("all") >= similarity * F.col("n") - 1e-9).select(*[F.col(c).alias(f"{c}_") for c in ("id", "t", "g", "n")], "most")
    edge = F.coalesce(F.lag("p").over(line.orderBy("p")) < F.col("p") - 1, F.lit(True))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in ("id", "t", "g", "n")]
    starts = met.withColumn("edge", edge).join(recurs, same).filter("edge or most > 1").select("id", "t", "g", "n", "p").distinct()
    wanted = starts.groupBy("id", "t").agg(F.collect_set(F.struct("n", "p", "g")).alias("wanted")).select(F.col("id").alias("id_"), F.col("t").alias("t_"), "wanted")
    wanted = materialize(wanted, "wanted")
    few = wanted.agg(F.coalesce(F.sum(F.size("wanted") * 24 + 32), F.lit(0))).first()[0] <= BROADCAST_BYTES
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(whole(text)).alias("t"), whole(text).alias("text"))
    again = texts.join(F.broadcast(wanted) if few else wanted, F.col("id").eqNullSafe(F.col("id_")) & (F.col("t") == F.col("t_")))

    def cut(s: Column) -> Column:
        first = lambda w: F.greatest(F.least(w["p"], F.size(s) - w["n"]), F.lit(0))
        return F.transform("wanted", lambda w: F.struct(w["n"].alias("n"), w["g"].alias("g"), first(w).alias("start"), F.slice(s, first(w) + 1, w["n"]).alias("window")))

    windows = again.select("id", F.explode(let(shingles("text"), cut)).alias("w")).select("id", "w.*")
    windows = windows.dropDuplicates(["id", "g", "start", "window"])
    # one fingerprint for each distinct window, whatever the number of documents that have it, and one comparison with an item
    placed = materialize(windows.withColumn("key", F.xxhash64("n", "window")), "windows")
    distinct = materialize(placed.select("key", "g", "n", "window").distinct().withColumn("fp", simhash(F.col("window"))), "prints")
    index = goal.select("item", F.col("g").alias("g_"), "goal", simhash(F.col("goal")).alias("print")).select("*", F.explode(block_keys(F.col("print"), True, within)).alias("block_"))
    probe = distinct.select("key", "g", "n", "window", "fp", F.explode(block_keys(F.col("fp"), False, within)).alias("block"))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("print"))) <= within
    found = probe.join(index, (F.col("g") == F.col("g_")) & (F.col("block") == F.col("block_")) & close).select("key", "g", "window", "item", "goal").distinct()
    found = found.withColumn("similarity", bag_similarity(F.col("window"), F.col("goal"))).filter(F.col("similarity") >= similarity)
    found = found.select(F.col("key").alias("key_"), F.col("g").alias("g_"), F.col("window").alias("window_"), "item", "similarity")
    out = placed.join(found, (F.col("key") == F.col("key_")) & (F.col("g") == F.col("g_")) & (F.col("window") == F.col("window_")))
    best = out.groupBy("id", "item").agg(F.max(F.struct("similarity", -F.col("start"))).alias("best"))
    out = best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("best.similarity").alias("similarity"), (-F.col("best.col2")).alias("start"))
    out = materialize(out, "leaks")
    discard(docs.sparkSession, goal, listed, hits, near, met, wanted, placed, distinct)
    return out


def candidates(hits: DataFrame, goal: DataFrame, similarity: float) -> DataFrame:
    """id, t, g: the items (g, n, goal) that a document (id, t) may hold, by its hits (id, t, p, x).

    A text of that similarity shares at least similarity x n of an item's n shingles, counted with repeats, so of the n - similarity x n + 1 rarest it has one: only these are looked up. Stock phrases,
    which many documents and items have, are among them only where an item has little else.
    """
    often = hits.groupBy("x").agg(F.count("*").alias("often")).withColumnRenamed("x", "x_")
    each = goal.select("g", "n", F.explode("goal").alias("h"))
    ranked = each.join(materialize(often, "often"), F.col("h") == F.col("x_"), "left").select("g", "n", "h", F.coalesce("often", F.lit(0)).alias("often"))
    rank = F.row_number().over(Window.partitionBy("g").orderBy("often", "h"))  # an item's shingles
    rare = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1
    probes = ranked.withColumn("rank", rank).filter((F.col("rank") <= rare) & (F.col("often") > 0)).select("g", "h").distinct()
    return hits.join(materialize(probes, "probes"), F.col("x") == F.col("h")).select("id", "t", "g").distinct()


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that leak an item. Rows that share an id stay or go together, null ids too; documents without words stay."""
    return without(docs, leaks(docs, items, id_col=id_col, text=text).select(id_col), id_col)
