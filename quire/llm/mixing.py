"""Mixing sources to target weights by Pareto order sampling.

A source's target in words gives each of its documents an expected number of copies. The whole part of that number is allotted for certain; the rest is an inclusion
probability, and a sample of fixed size fills what is missing: documents rank by the odds of a random number over the odds of their inclusion, and the first ones whose words make up the
rest are taken. The document at the border is taken in part, so a source's words are its target to within one.

No text moves: its words are counted where it is. The border of a source is found in a histogram of its ranks, and then among the few documents of one of its cells,
so the taken documents are those below a threshold that every row is compared with, however many of the rows one source has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, discard, materialize, whole

#: Weights of the sources in turn, the mix's share of all words, and how often a word may be used.
WEIGHTS, SHARE, REPEATS, SEED = (5, 2, 1), 1.5, 2, 42
#: Documents of a cell of the histogram, about.
CELL_ROWS = 1 << 12
_SPACES = " \t\n\x0b\x0c\r"


def count_words(text: str | Column = "text") -> Column:
    """Runs of characters that aren't ASCII white space; 0 for null."""
    word = "[^" + ASCII_SPACE[1:]
    return F.length(F.regexp_replace(F.btrim(whole(text), F.lit(_SPACES)), f"{word}++{ASCII_SPACE}*+", ".")).cast("long")


def chance(seed: int, id_: Column, text: Column) -> Column:
    """A number between 0 and 1 that follows from the seed, the id and the text: 52 bits of an MD5. Null ids, and null texts, count as empty."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_.cast("string"), F.lit("")), F.md5(whole(text).cast("binary"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def numbered(values: DataFrame, name: str) -> DataFrame:
    """The single-column values, all different, with their places from 0 in ascending order, null last. Ranges are numbered each by itself, from where those before end."""
    (column,) = values.columns
    placed = values.repartitionByRange(F.col(column).asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    placed = materialize(placed, "ranges")
    parts = placed.groupBy(F.col("_part").alias("_p")).agg(F.count("*").alias("_n"))  # a row for each range
    starts = parts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(F.col(column).asc_nulls_last())) - 1
    return placed.withColumn("_rank", rank).join(F.broadcast(starts), F.col("_part") == F.col("_p")).select(column, (F.col("_start") + F.col("_rank")).cast("long").alias(name))


def targets(sources: DataFrame, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """sources (source, words, weight) with target: share of all words by weight, none above repeats times its source's words; what that leaves over is shared again.

    The level, words for each unit of weight, rises with every round until no source that it fills is left to find. A round is an aggregate of a row a source.
    """
    full = F.col("words") * repeats
    total, weights = sources.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level, held = (float(total) * share / float(weights) if weights else 0.0), -1
    while True:
        filled = full <= F.col("weight") * F.lit(level)
        spent, n, open_ = sources.agg(F.coalesce(F.sum(F.when(filled, full)), F.lit(0)), F.count_if(filled), F.coalesce(F.sum(F.when(~filled, F.col("weight"))), F.lit(0))).first()
        if n <= held or not open_:
            break
        held, level = n, (float(total) * share - float(spent)) / float(open_)
    return sources.withColumn("target", F.least(full.cast("double"), F.col("weight") * F.lit(level)))


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = SEED, favour: str | None = None,
    id_col: str = "doc_id", text: str = "text", source: str = "source", cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Per row of docs: id, source, size (its words), source_size, target (both of its source), copies (whole ones) and taken (words that the mix takes, those of a part of a copy too).

    Sources in the order of their code points, null last, weigh weights in turn. favour: a column of positive numbers by which documents of a source are preferred; a document's expected copies are in
    proportion to it, up to repeats. Without it all documents of a source have the same. No document gives more than repeats times its words.

    A null text has no words and gives none, as do empty and blank ones; a source without words has the target 0. Rows that agree in id, text and source share one draw: all of them are taken or none, and at the
    border their words are shared out evenly, so fewer words than there are such rows may be lacking. Rows of one id with other texts are documents of their own. An empty table gives an empty result.
    """
    if not weights or min(weights) <= 0 or not 0 < share or repeats < 1:
        raise ValueError("positive weights and share, one repeat at least")
    spark = docs.sparkSession
    liking = F.col(favour).cast("double") if favour else F.lit(1.0)
    base = docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), count_words(text).alias("size"), chance(seed, F.col(id_col), F.col(text)).alias("u"), liking.alias("liking"))
    base = materialize(base, "words")
    sizes = materialize(base.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("rows")), "sources")
    order = numbered(sizes.select("source"), "place").withColumnRenamed("source", "_s")
    weighed = sizes.join(order, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    weighed = weighed.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")).cast("long"))
    aimed = materialize(targets(materialize(weighed, "weights"), share, repeats), "targets")
    of = aimed.select(F.col("source").alias("_s"), F.col("words").alias("source_size"), "target", "rows")
    rated = _rated(base, of, repeats, favour is not None)

    # odds of the random number over those of inclusion, and the cell of the histogram that they fall in
    odds = (F.col("u") / (1 - F.col("u"))) / F.try_divide(F.col("chance"), 1 - F.col("chance"))
    ranked = rated.withColumn("odds", F.when(F.col("chance") > 0, odds))
    cells = F.least(F.greatest(F.col("rows") / cell_rows, F.lit(1)), F.lit(1 << 20)).cast("long")
    ranked = ranked.withColumn("cell", F.floor(F.col("odds") / (1 + F.col("odds")) * cells).cast("long"))
    histogram = ranked.groupBy("source", "cell").agg(F.sum("size").alias("n"), F.sum(F.col("copies") * F.col("size")).alias("sure"), F.max("target").alias("target"))
    histogram = materialize(histogram, "cells")
    lacking = histogram.groupBy("source").agg(F.floor(F.max("target") - F.sum("sure") + 0.5).cast("long").alias("lack"))
    upto = Window.partitionBy("source").orderBy("cell")
    running = histogram.filter("cell is not null").select("source", "cell", (F.sum("n").over(upto) - F.col("n")).alias("before"), "n").alias("h")
    met = running.join(lacking.select(F.col("source").alias("_l"), "lack"), F.col("source").eqNullSafe(F.col("_l")))
    border = met.filter("before < lack and lack <= before + n").select(F.col("source").alias("_b"), F.col("cell").alias("at"), (F.col("lack") - F.col("before")).alias("left"))
    border = materialize(border, "border")

    # the border's cell, document by document
    inside = ranked.join(border, F.col("source").eqNullSafe(F.col("_b")) & (F.col("cell") == F.col("at"))).groupBy("source", "at", "odds", "left").agg(F.sum("size").alias("n"), F.count("*").alias("sharers"))
    inside = inside.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("odds")) - F.col("n"))
    last = inside.filter("before < left and left <= before + n").select(F.col("source").alias("_t"), "at", F.col("odds").alias("limit"), F.floor((F.col("left") - F.col("before")) / F.col("sharers")).cast("long").alias("part"))
    # a source that needs nothing has no border, and no row of it is below one; one whose sample can't give what it lacks would give all of it
    known = lacking.select(F.col("source").alias("_k"), "lack").join(materialize(last, "limits"), F.col("_k").eqNullSafe(F.col("_t")), "left")
    edge = F.when(F.col("lack") > 0, F.lit((1 << 63) - 1)).otherwise(-1)
    some = materialize(known.select("_k", F.coalesce("at", edge).alias("at"), F.coalesce("limit", F.lit(0.0)).alias("limit"), F.coalesce("part", F.lit(0)).alias("part")), "thresholds")
    final = ranked.join(some, F.col("source").eqNullSafe(F.col("_k")))
    below = (F.col("cell") < F.col("at")) | ((F.col("cell") == F.col("at")) & (F.col("odds") < F.col("limit")))
    copies = F.col("copies") + F.when(below, 1).otherwise(0)
    part = F.when((F.col("cell") == F.col("at")) & (F.col("odds") == F.col("limit")), F.least("size", "part")).otherwise(0)
    taken = copies * F.col("size") + part
    out = final.select(F.col("id").alias(id_col), F.col("source").alias(source), "size", "source_size", "target", copies.cast("int").alias("copies"), taken.cast("long").alias("taken"))
    discard(spark, sizes)
    return out


def _rated(base: DataFrame, of: DataFrame, repeats: int, favoured: bool) -> DataFrame:
    """base with its source's columns, copies (for certain) and chance (of one more)."""
    if not favoured:
        mean = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
        joined = base.join(of, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("mean", mean)
        return joined.withColumns({"copies": F.floor("mean").cast("long"), "chance": F.col("mean") - F.floor("mean")}).drop("mean")
    # each source's factor: expected copies are liking times it, and no more than repeats; it rises until no further document is full
    factors = base.groupBy("source").agg(F.sum(F.col("size") * F.col("liking")).alias("_w")).withColumnRenamed("source", "_f")
    joined = materialize(base.join(of, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "favoured")
    now = materialize(of.select("_s", "target").join(factors, F.col("_s").eqNullSafe(F.col("_f"))).select("_s", "target", F.coalesce(F.try_divide("target", "_w"), F.lit(0.0)).alias("factor"), F.lit(0).cast("long").alias("full")), "factors")
    while True:
        full = F.col("liking") * F.col("factor") >= repeats
        met = joined.drop("target").join(now, F.col("source").eqNullSafe(F.col("_s")))
        told = met.groupBy("_s", "target", "factor", "full").agg(F.count_if(full).alias("n"), F.coalesce(F.sum(F.when(full, F.col("size") * repeats)), F.lit(0)).alias("spent"), F.coalesce(F.sum(F.when(~full, F.col("size") * F.col("liking"))), F.lit(0.0)).alias("open"))
        raised = F.when(F.col("open") > 0, (F.col("target") - F.col("spent")) / F.col("open")).otherwise(F.col("factor"))
        after = materialize(told.select("_s", "target", raised.alias("factor"), F.col("n").alias("full"), (F.col("n") > F.col("full")).alias("moved")), "factors")
        if after.filter("moved").isEmpty():
            break
        now = after.drop("moved")
    mean = F.least(F.col("liking") * F.col("factor"), F.lit(float(repeats)))
    rated = joined.drop("target").join(after.drop("full", "moved"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("mean", mean)
    return rated.withColumns({"copies": F.floor("mean").cast("long"), "chance": F.col("mean") - F.floor("mean")}).drop("mean", "factor")


def mixed_sources(docs: DataFrame) -> DataFrame:
    """mix() of documents: doc_id, size, source_size, target, taken."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
