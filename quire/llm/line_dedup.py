"""Line dedup over a suffix array of line ids, built by distributed prefix doubling (native).

Every line that is not blank is a 128-bit id, and a document is the sequence of its ids. Only ids that occur twice can be in a
repeated run, so the others break the sequences and drop out first. Rank 0 orders the suffixes by their first line; rank k + 1
orders them by their first 2^(k+1) lines, from the ranks k of a suffix and of the one 2^k lines on. Ranks are numbered over
distinct pairs in order-preserving buckets, so no task sees all of them and a line that is everywhere is one pair.

The suffixes that agree in their first m lines are an interval of the suffix array with a longest common prefix of m or more. Two
ranks name it: those of the blocks of 2^k lines, 2^k <= m, at its front and at its end. A run with at least min_words words is the
union of the shortest such runs from each of its lines on and up to each of its lines; so it is enough to look up the intervals of
these, and the union of those that do not come first in their interval is exactly what maximal repeated runs leave to delete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, gapless, let, materialize, whole

MIN_WORDS = 10


def line_table(docs: DataFrame) -> DataFrame:
    """id, t (hash of the text), line (number in the text), n (number among lines that aren't blank), a and b (the line's id), words."""
    cells = F.filter(
        F.transform(F.split(whole(), "\n", -1), lambda x, i: F.struct(i.alias("line"), x.alias("x"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))),
        lambda c: c["words"] > 0,
    )
    cells = F.transform(cells, lambda c: F.struct(c["line"].alias("line"), c["words"].alias("words"), F.xxhash64(c["x"]).alias("a"), F.xxhash64(F.lit(1), c["x"]).alias("b")))
    return docs.select("id", F.xxhash64(whole()).alias("t"), F.posexplode(cells).alias("n", "c")).select("id", "t", "n", "c.line", "c.words", "c.a", "c.b")


def _numbered(keys: DataFrame, order: list[str], bucket: Column, buckets: int, name: str) -> DataFrame:
    """keys with their place in the order, which bucket (0 to buckets - 1) must follow."""
    return gapless(keys, [], order, bucket, buckets, name)


def suffix_ranks(lines: DataFrame, depth: int) -> DataFrame:
    """The lines that occur again, with r0 to r<depth>: ranks of the suffixes by their first 1, 2, 4, ... lines; null if fewer follow without a break."""
    spark = lines.sparkSession
    again = lines.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").select("a", "b")
    again = materialize(again, "again")
    total = again.count()
    buckets = max(64, total // 1_000_000)
    place = ((F.col("a").cast("double") / 2.0**64 + 0.5) * buckets).cast("int")
    names = _numbered(again, ["a", "b"], F.least(place, F.lit(buckets - 1)), buckets, "r0").withColumnsRenamed({"a": "a_", "b": "b_"})
    now = lines.join(names, (F.col("a") == F.col("a_")) & (F.col("b") == F.col("b_"))).select("id", "t", "n", "line", "words", "r0").distinct()
    now = materialize(now, "rank0")
    discard(spark, again)
    by_doc = Window.partitionBy("id", "t").orderBy("n")
    for k in range(depth):
        ahead = F.when(F.lead("n", 2**k).over(by_doc) == F.col("n") + 2**k, F.lead(f"r{k}", 2**k).over(by_doc))
        paired = now.withColumn("s", ahead)
        keys = paired.filter("s is not null").select(F.col(f"r{k}").alias("p"), F.col("s").alias("q")).distinct()
        size = max(total, 1)
        place = ((F.col("p") + F.col("q") / size) / size * buckets).cast("int")
        names = _numbered(keys, ["p", "q"], F.least(place, F.lit(buckets - 1)), buckets, f"r{k + 1}")
        grown = materialize(paired.join(names, (F.col(f"r{k}") == F.col("p")) & (F.col("s") == F.col("q")), "left").drop("s", "p", "q"), f"rank{k + 1}")
        total = max(total, names.count() if k + 1 < depth else 0)
        discard(spark, now)
        now = grown
    return now


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """id, t, line: lines in a run of at least min_words words that an earlier place (id, then line) has as well. docs: id, text."""
    depth = max(0, min_words.bit_length() - 1)
    lines = materialize(line_table(docs), "lines")
    ranks = suffix_ranks(lines, depth)
    discard(docs.sparkSession, lines)
    cell = F.struct("n", "words", "line", *[f"r{k}" for k in range(depth + 1)])
    by_doc = Window.partitionBy("id", "t").orderBy("n")
    cells = ranks.select(
        "id", "t", "n",
        F.collect_list(cell).over(by_doc.rowsBetween(0, min_words - 1)).alias("ahead"),
        F.reverse(F.collect_list(cell).over(by_doc.rowsBetween(1 - min_words, 0))).alias("behind"),
    )

    def least_run(side: str) -> Column:
        """The fewest lines from the first cell on that have min_words words, or null."""
        run = F.aggregate(
            side,
            F.struct(F.lit(0).alias("m"), F.lit(0).cast("long").alias("w"), F.lit(True).alias("ok")),
            lambda s, c: F.when(~s["ok"] | (s["w"] >= min_words), s).otherwise(
                F.struct((s["m"] + 1).alias("m"), (s["w"] + c["words"]).alias("w"), (F.abs(c["n"] - F.col("n")) == s["m"]).alias("ok"))
            ),
        )
        return F.when(run["ok"] & (run["w"] >= min_words), run["m"])

    def rank_at(side: str, at: Column, k: Column) -> Column:
        cell = F.element_at(side, at)
        out = F.lit(None).cast("long")
        for j in range(depth + 1):
            out = F.when(k == j, cell[f"r{j}"]).otherwise(out)
        return out

    runs = cells.withColumns({"m": least_run("ahead"), "l": least_run("behind")})
    power = lambda m: F.floor(F.log2(m.cast("double") + 0.25)).cast("int")
    first = runs.filter("m is not null").withColumn("k", power(F.col("m")))
    first = first.select(
        "id", "t", "m",
        rank_at("ahead", F.lit(1), F.col("k")).alias("p"),
        rank_at("ahead", (F.col("m") - F.pow(F.lit(2.0), "k") + 1).cast("int"), F.col("k")).alias("q"),
        "n", F.transform(F.slice("ahead", F.lit(1), F.col("m")), lambda c: c["line"]).alias("lines"),
    )
    last = runs.filter("l is not null").withColumn("k", power(F.col("l")))
    last = last.select(
        "id", "t", F.col("l").alias("m"),
        rank_at("behind", F.col("l"), F.col("k")).alias("p"),
        rank_at("behind", F.pow(F.lit(2.0), "k").cast("int"), F.col("k")).alias("q"),
        (F.col("n") - F.col("l") + 1).alias("n"), F.transform(F.slice("behind", F.lit(1), F.col("l")), lambda c: c["line"]).alias("lines"),
    )
    found = materialize(first.unionAll(last), "intervals")
    place = F.struct("id", "t", "n")
    heads = found.groupBy("m", "p", "q").agg(F.min(place).alias("head")).select(F.col("m").alias("m_"), F.col("p").alias("p_"), F.col("q").alias("q_"), "head")
    heads = materialize(heads, "heads")  # a join of two plain exchanges, whose hot intervals Spark can split
    later = found.join(heads, (F.col("m") == F.col("m_")) & (F.col("p") == F.col("p_")) & (F.col("q") == F.col("q_"))).filter(place > F.col("head"))
    return later.select("id", "t", F.explode("lines").alias("line")).distinct()


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, text (without later copies of repeated runs of lines), n_lines, n_deleted.

    Lines end at line feeds and are equal if their bytes are; blank lines neither count nor break a run, and stay. A run has at least min_words
    words. Places are ordered by id, then line; the first keeps its lines, also within one document. A null or empty text has one empty line
    and stays as it is. Rows that repeat id and text count as one and get the same result; of rows that repeat an id alone the order is by
    a hash of the text. An empty table gives an empty result; further columns are not looked at.
    """
    found = _cut(docs, min_words, id_col, text)
    return found.select(F.col("id").alias(id_col), F.col("cut").alias(text), "n_lines", "n_deleted")


def keep_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with their cut texts, all other columns as they were, but for documents of which nothing but blank lines is left."""
    found = _cut(docs, min_words, id_col, text).filter(F.col("n_deleted").eqNullSafe(0) | F.col("cut").rlike(r"[^\x20\x09-\x0D]"))
    return found.select(*[F.col("cut").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def _cut(docs: DataFrame, min_words: int, id_col: str, text: str) -> DataFrame:
    """row (all columns), id, cut (the text without later copies), n_lines, n_deleted."""
    own = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text).alias("text"))
    gone = repeated_lines(own.drop("row"), min_words).groupBy("id", "t").agg(F.collect_list("line").alias("gone"))
    gone = materialize(gone, "gone").withColumnsRenamed({"id": "id_", "t": "t_"})
    lines = F.split("text", "\n", -1)
    others = lambda own: F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("gone"))
    rest = let(lines, lambda own: F.array_join(F.transform(others(own), lambda i: F.get(own, i)), "\n"))
    joined = own.join(gone, F.col("id").eqNullSafe(F.col("id_")) & (F.xxhash64(whole()) == F.col("t_")), "left")
    return joined.select(
        "row", "id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(rest).alias("cut"),
        F.greatest(F.size(lines), F.lit(1)).alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("n_deleted"),
    )
