"""Exact dedup by content-defined chunk recipes (native).

A text without ASCII white space is cut after byte triples that a fixed rule picks, so an edit moves only the cuts next to it.
Each chunk becomes a 128-bit identifier. One pass moves the chunks once, each distinct one once a task, and checks that no
identifier stands for two byte strings; if one did, all identifiers are made anew under another salt. From then on documents
are compared by their ordered identifiers alone and no text moves again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, materialize, whole, without

MIN_CHUNK, MAX_CHUNK = 512, 8192


def _cut_class(rest: int) -> str:
    """A quarter of all byte values, by their remainder, as a character class over bytes read as Latin-1. Neighbouring letters have different ones, so small alphabets have cuts too."""
    return "[" + "".join(f"\\x{b:02X}" for b in range(rest, 256, 4)) + "]"


def chunk_pattern(least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> str:
    cut = "".join(map(_cut_class, (1, 2, 0)))
    return f"(?s).{{{least - 3},{most - 3}}}?{cut}|.{{1,{most}}}"


def normalised(text: str | Column = "text") -> Column:
    return F.regexp_replace(whole(text), f"{ASCII_SPACE}+", "")


def chunks(norm: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The UTF-8 bytes of norm, each read as one character, in content-defined pieces."""
    return F.regexp_extract_all(F.decode(norm.cast("binary"), "ISO-8859-1"), F.lit(chunk_pattern(least, most)), F.lit(0))


def identifier(chunk: Column, salt: int) -> Column:
    return F.struct(F.xxhash64(chunk, F.lit(salt)).alias("a"), F.xxhash64(F.lit(salt + 1), chunk).alias("b"))


def chunk_table(docs: DataFrame, text: str = "text", salt: int = 0) -> DataFrame:
    """Each distinct chunk once: id, chunk (bytes), copies."""
    one = docs.select(F.explode(chunks(normalised(text))).alias("c"))
    return one.select(identifier(F.col("c"), salt).alias("id"), F.encode("c", "ISO-8859-1").alias("chunk")).groupBy("id", "chunk").agg(F.count("*").alias("copies"))


def verified_salt(docs: DataFrame, text: str = "text") -> int:
    """The first salt under which every identifier stands for one chunk."""
    salt = 0
    while not chunk_table(docs, text, salt).groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        salt += 2
    return salt


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are without ASCII white space; of equal ones the row with the most code points, then the least id, stays.
    Null counts as empty; empty and blank texts are one group. A null id stays only if no other row is as long. Rows that
    repeat an id with the same text share its flag. An empty table gives an empty result; other columns are not looked at.
    """
    docs = docs.select(F.col(id_col).alias("id"), whole(text).alias("text"))
    salt = verified_salt(docs)
    norm = normalised("text")
    recipe = F.transform(chunks(norm), lambda c: identifier(c, salt))
    digest = materialize(docs.select("id", recipe.alias("recipe"), F.length("text").alias("n"), F.sha2(norm.cast("binary"), 256).alias("sha")), "recipes")
    order = F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("none"), "id")  # ids of any type that has an order
    best = digest.groupBy("recipe").agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
    best = best.select(F.col("recipe").alias("of"), F.col("best.id").alias("keep_id"), (-F.col("best.n")).alias("most"), "group_size")
    best = materialize(best, "best")  # a join of two plain exchanges, whose hot recipes Spark can split
    out = digest.join(best, F.col("recipe") == F.col("of"))
    return out.select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("most"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that are copies of another, all columns as they were. Rows that share an id stay or go together, null ids too; null and blank texts are copies of each other."""
    return without(docs, exact_dedup(docs, id_col, text).filter("not kept").select(id_col), id_col)


__all__ = ["chunk_table", "exact_dedup", "keep_first"]
