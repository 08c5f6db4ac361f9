"""Joins of words with a lexicon table of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.correct import bare_word, replaced_words


def word_validity(df: DataFrame, lexicon: DataFrame, id_col: str, text: str = "text", only: str | None = f"[{T.BANGLA}]", word: str = "word") -> DataFrame:
    """id, n_words, validity: share of a text's words (those that match only) in the lexicon; 1.0 without words.

    Words are counted within their text, by runs of its sorted words, before they meet the lexicon, so a frequent word crosses the join once a text; Spark broadcasts the lexicon if it is small, and then
    only a text's sums are shuffled.
    """
    fits = F.filter(T.tokens(text), lambda w: w.rlike(only)) if only else T.tokens(text)
    counts = T.let(F.array_sort(fits), _runs)
    counted = df.select(F.col(id_col), F.explode_outer(counts).alias("c")).select(id_col, F.col("c.w").alias("w"), F.col("c.n").alias("n"))
    known = lexicon.select(F.col(word).alias("known")).filter("known is not null").distinct()
    joined = counted.join(known, F.col("w") == F.col("known"), "left")
    total = lambda x: F.sum(F.coalesce(x, F.lit(0).cast("long")))
    out = joined.groupBy(id_col).agg(total(F.col("n")).alias("n_words"), total(F.when(F.col("known").isNotNull(), F.col("n"))).alias("hits"))
    return out.select(id_col, "n_words", F.when(F.col("n_words") > 0, F.col("hits") / F.col("n_words")).otherwise(1.0).alias("validity"))


def _runs(words: Column) -> Column:
    """Different words of a sorted array, with the number of each: w, n."""
    firsts = F.filter(F.transform(words, lambda w, i: F.when((i == 0) | (w != F.get(words, i - 1)), i)), lambda i: i.isNotNull())
    run = lambda at: F.transform(at, lambda i, k: F.struct(F.get(words, i).alias("w"), (F.coalesce(F.get(at, k + 1), F.size(words)) - i).cast("long").alias("n")))
    return T.let(firsts, run)


def replace_words(df: DataFrame, replacements: DataFrame, id_col: str, text: str = "text", wrong: str = "wrong", right: str = "right") -> DataFrame:
    """id, text: words that a table of any size replaces are replaced, as correct.restore_vowels() does by a small map; all white space becomes single spaces.

    Each different word of a text crosses the join once, and only replacements come back to it, as a map. Of several replacements of a word the least counts.
    """
    table = replacements.filter(F.col(right) != "").groupBy(F.col(wrong).alias("_wrong")).agg(F.min(right).alias("_right"))
    words = df.select(F.col(id_col).alias("_id"), F.explode(F.array_distinct(F.transform(T.tokens(text), bare_word))).alias("_word"))
    found = words.join(table, F.col("_word") == F.col("_wrong")).groupBy("_id").agg(F.map_from_entries(F.collect_set(F.struct("_wrong", "_right"))).alias("_map"))
    joined = df.join(found, F.col(id_col).eqNullSafe(F.col("_id")), "left")
    plain = F.array_join(T.tokens(text), " ")
    return joined.select(id_col, F.when(F.col("_map").isNull(), plain).otherwise(replaced_words(T.tokens(text), F.col("_map"))).alias(text))
