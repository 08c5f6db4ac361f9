"""Connected components over links, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, label for every node of links (a, b; longs): label is the least node that it is linked to, itself included.

    Each round is written to the shared folder. A star's centre may have any number of links: they meet in partial
    aggregates, and in a join whose large partitions adaptive execution splits.
    """
    spark = links.sparkSession
    now = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    mark = _mark(now)
    for _ in range(rounds):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")).withColumnRenamed("a", "of")
        large = both.filter("b > a").join(least, F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # what a node's larger neighbours now point at; the node itself keeps its own least neighbour
        own = least.filter("of > m").select(F.col("of").alias("a"), F.col("m").alias("b"))
        starred = materialize(large.unionAll(own).filter("a <> b").distinct(), "large")
        least = starred.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "of")
        small = starred.join(least, F.col("a") == F.col("of")).filter("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        after = materialize(small.unionAll(least.select(F.col("of").alias("a"), F.col("m").alias("b"))).distinct(), "small")
        discard(spark, now, starred)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
    raise RuntimeError(f"components have not settled after {rounds} rounds")


def _mark(links: DataFrame) -> tuple:
    """Equal for equal sets of links."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first())


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the graph over distinct fingerprints that joins those within radius bits."""
    left, a, b = fps.copy(), [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count((left ^ x).view(np.uint64)) <= radius
            if near.any():
                found = left[near]
                a.append(np.full(len(found), x))
                b.append(found)
                todo.extend(found)
                left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (left[:0], left[:0])
