"""Sharding by best-fit-decreasing bin packing.

Groups of equal texts are indivisible. Groups of one size are interchangeable, so the packer sees a histogram of group sizes, rounded up to 12 significant
bits: at most some 200 000 sizes, however much there is. It places each size, largest first, into the
fullest bin that still takes it, found in a balanced tree over (room, bin), many equal groups at a time. Which group of a
size goes where follows from its gapless rank among the groups of that size, numbered without a single-task step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, gapless, materialize, whole


class RoomTree:
    """A treap over (room, bin): the least room that is enough, insertion and removal in O(log bins)."""

    def __init__(self) -> None:
        self._root: list | None = None  # [key, priority, left, right]

    @staticmethod
    def _priority(key: tuple[int, int]) -> int:
        return (key[0] * 0x9E3779B97F4A7C15 + key[1] * 0xC2B2AE3D27D4EB4F) % (1 << 61)

    def _split(self, node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        if node is None:
            return None, None
        if node[0] < key:
            a, b = self._split(node[3], key)
            return [node[0], node[1], node[2], a], b
        a, b = self._split(node[2], key)
        return a, [node[0], node[1], b, node[3]]

    def _merge(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return [a[0], a[1], a[2], self._merge(a[3], b)]
        return [b[0], b[1], self._merge(a, b[2]), b[3]]

    def add(self, room: int, bin_: int) -> None:
        a, b = self._split(self._root, (room, bin_))
        self._root = self._merge(self._merge(a, [(room, bin_), self._priority((room, bin_)), None, None]), b)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least room >= size."""
        node, found = self._root, None
        while node is not None:
            node, found = (node[2], node[0]) if node[0] >= (size, -1) else (node[3], found)
        if found is not None:
            a, b = self._split(self._root, found)
            _, b = self._split(b, (found[0], found[1] + 1))
            self._root = self._merge(a, b)
        return found


def best_fit_runs(histogram: list[tuple[int, int]], capacity: int, bins: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """(size, groups, first, each) in the order of placement, for a histogram of (size, groups): so many groups go into the bins from first on, each of which takes so many, the last perhaps fewer.

    Bins of equal room that follow each other are one node of the tree, however many they are: what fills them fills them alike. So the runs, and the steps, grow with the number of sizes and not with that of groups.
    Without bins, as many are opened as needed, each of the capacity or of a larger single group. With bins, None if they don't suffice.
    """
    tree, opened, out = RoomTree(), 0, []
    count: dict[int, int] = {}  # bins that stand together, by the first of them

    def put(room: int, first: int, n: int) -> None:
        if n:
            count[first] = n
            tree.add(room, first)

    if bins is not None:
        put(capacity, 0, bins)
    for size, left in sorted(histogram, reverse=True):
        while left:
            at = tree.take_tightest(size)
            if at is None:
                if bins is not None:
                    return None
                each = max(capacity, size) // size
                at, n = (max(capacity, size), opened), -(-left // each)
                opened += n
            else:
                each, n = at[0] // size, count.pop(at[1])
            room, first = at
            used = min(n, -(-left // each))
            groups = min(left, used * each)
            out.append((size, groups, first, each))
            left -= groups
            last = groups - (used - 1) * each  # of the last used bin
            full = used if last == each else used - 1
            put(room - each * size, first, full)
            if full < used:
                put(room - last * size, first + full, 1)
            put(room, first + used, n - used)
    return out


def best_fit_decreasing(histogram: list[tuple[int, int]], capacity: int, bins: int | None = None) -> list[tuple[int, int, int]] | None:
    """best_fit_runs() bin by bin: (size, groups, bin)."""
    runs = best_fit_runs(histogram, capacity, bins)
    if runs is None:
        return None
    return [(size, min(each, groups - i * each), first + i) for size, groups, first, each in runs for i in range(-(-groups // each))]


def pack_into(histogram: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int]]:
    """Best-fit-decreasing into a given number of bins, under the least capacity found that holds all: sizes near equal.

    Groups larger than an equal share get bins of their own; the others share the rest.
    """
    sizes, own = sorted(histogram, reverse=True), []
    while sizes and len(own) < bins - 1 and sizes[0][0] * (bins - len(own)) > sum(s * n for s, n in sizes):
        own.append((sizes[0][0], 1, bins - 1 - len(own)))
        sizes[0] = (sizes[0][0], sizes[0][1] - 1)
        if not sizes[0][1]:
            sizes.pop(0)
    bins -= len(own)
    total = sum(s * n for s, n in sizes)
    low = max(-(-total // bins), sizes[0][0] if sizes else 1, 1)
    step = max(1, low // 100_000)
    high, found = low, best_fit_decreasing(sizes, low, bins)
    while found is None:
        low, high = high + 1, high + step
        step *= 2
        found = best_fit_decreasing(sizes, high, bins)
    while high - low > max(1, low // 100_000):
        middle = (low + high) // 2
        if (better := best_fit_decreasing(sizes, middle, bins)) is None:
            low = middle + 1
        else:
            high, found = middle, better
    return own + found


def size_class(size: Column, capacity: int | None = None, bits: int = 12) -> Column:
    """size rounded up to so many significant bits, but not beyond a capacity that it fits: what is placed by it never takes more room than it was given."""
    low = F.greatest(F.length(F.bin(size)) - bits, F.lit(0))
    up = F.call_function("shiftleft", F.call_function("shiftright", size + F.call_function("shiftleft", F.lit(1).cast("long"), low) - 1, low), low)
    return up if capacity is None else F.when(size <= capacity, F.least(up, F.lit(capacity))).otherwise(up)


def shard_documents(docs: DataFrame, shards: int | None = 16, capacity: int | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: id, size, text_crc32, law, shard, slot, grown_shard. Law: bytes.

    Give shards for a fixed number of near-equal ones, or capacity for as few as best-fit-decreasing needs of that many bytes.
    Size: UTF-8 bytes plus 1; a null text has 1 and the CRC of no bytes, and forms one group with the other null texts, apart
    from empty ones. Repeated rows and ids are rows like others, each with its slot. An empty table gives an empty result.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    spark = docs.sparkSession
    base = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(whole(text)) + 1).cast("long").alias("size"),
            F.crc32(whole(text).cast("binary")).cast("long").alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(F.col(text).cast("binary"), 256)), F.lit(b"")).alias("digest"),
        ),
        "sizes",
    )
    groups = base.groupBy("digest").agg(F.sum("size").alias("bytes"))
    groups = materialize(groups.select("digest", size_class(F.col("bytes"), capacity).alias("group_size")), "groups")
    histogram = [(r[0], r[1]) for r in groups.groupBy("group_size").count().collect()]
    rows = base.count()
    runs = [(s, n, at, n) for s, n, at in pack_into(histogram, shards)] if capacity is None else best_fit_runs(histogram, capacity)
    upto: dict[int, list[tuple[int, int, int, int]]] = {}
    for size, n, first, each in runs:
        own = upto.setdefault(size, [])
        own.append((own[-1][1] if own else 0, (own[-1][1] if own else 0) + n, first, each))
    allotted = spark.createDataFrame(list(upto.items()), "group_size long, upto array<struct<start: long, end: long, first: int, each: long>>").withColumnRenamed("group_size", "_size")
    ranked = gapless(groups, ["group_size"], ["digest"], F.xxhash64("digest"), max(1, len(histogram) and groups.count() // 1_000_000), "rank")
    where = ranked.join(allotted, F.col("group_size") == F.col("_size")).select(
        F.col("digest").alias("_digest"), F.get(F.transform(F.filter("upto", lambda x: F.col("rank") < x["end"]), lambda x: (x["first"] + F.floor((F.col("rank") - x["start"]) / x["each"])).cast("int")), F.lit(0)).alias("shard")
    )
    out = base.join(where, F.col("digest") == F.col("_digest")).select("id", "size", "text_crc32", "shard", F.monotonically_increasing_id().alias("row"))
    out = materialize(out, "sharded")
    discard(spark, base, groups)
    # the row's number spreads rows that share id and text as well
    out = gapless(out, ["shard"], ["id", "text_crc32", "row"], F.xxhash64("id", "row"), max(64, rows // 1_000_000), "slot")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
