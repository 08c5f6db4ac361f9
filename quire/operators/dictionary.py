"""Dictionaries of substrings, of any number of entries: which occur in a text, and ordered replacement.

The entries are an automaton that reads a text once, however many they are, in Arrow batches. A worker makes it at first use and keeps it. A dictionary goes to the workers in parts of at most PART_CHARS characters,
in its order; texts pass them one after another, so a part is the most that a worker holds, and what the parts say is what the whole would.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_CHARS = 16 << 20
_made: dict[str, object] = {}


def parts(entries: DataFrame, columns: list[str], order: str, most: int = PART_CHARS) -> Iterator[list[tuple]]:
    """Rows of a dictionary in its order, in lists of about so many characters. Rows come to the driver a part at a time. Entries that are null or empty are left out."""
    kept = entries.filter(F.col(columns[0]).isNotNull() & (F.col(columns[0]) != "")).orderBy(order).select(*columns)
    some, size = [], 0
    for r in kept.toLocalIterator(prefetchPartitions=True):
        if some and size >= most:
            yield some
            some, size = [], 0
        some.append(tuple(r))
        size += sum(len(x or "") for x in r)
    if some:
        yield some


def automaton(key: str, words: list[str]):
    """The automaton of the words by their places; each word once, at its first place. Kept in this process, the last one made for each key."""
    import ahocorasick

    if key not in _made:
        _made.clear()  # of parts that are done with
        made = ahocorasick.Automaton()
        for i, w in enumerate(words):
            if w not in made:
                made.add_word(w, i)
        made.make_automaton()
        _made[key] = made
    return _made[key]


def found(machine, text: str) -> set[int]:
    """Places of all words that occur in a text, whatever they overlap."""
    return {i for _, i in machine.iter(text)} if len(machine) else set()


def replaced(machine, pairs: list[tuple[str, str]], text: str) -> str:
    """The text after all replacements in their order, as if each were made in turn: the next one that occurs is looked for again after each, as it may be made by it. A word that is listed twice is replaced once."""
    done = -1
    while due := [i for i in found(machine, text) if i > done]:
        done = min(due)
        text = text.replace(pairs[done][0], pairs[done][1] or "")
    return text


def _passed(df: DataFrame, text: str, key: str, words: list[str], kind: str, out: str, say) -> DataFrame:
    """df with a column out of what say(automaton, text) makes of each text; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            machine = automaton(key, words)
            said = pa.array([None if t is None else say(machine, t.as_py()) if t.is_valid else None for t in b.column(at)], pa.string() if kind == "string" else pa.int64())
            columns = [said if i == place else c for i, c in enumerate(b.columns)] if place is not None else [*b.columns, said]
            yield pa.RecordBatch.from_arrays(columns, names)

    at, place = df.columns.index(text), df.columns.index(out) if out in df.columns else None
    names = df.columns if place is not None else [*df.columns, out]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out or place is None]
    schema = ", ".join(fields + [f"`{out}` {kind}"]) if place is None else ", ".join(f"`{f.name}` {kind if f.name == out else f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, schema)


def hit_counts(df: DataFrame, entries: DataFrame, text: str = "text", word: str = "word", out: str = "hits", most: int = PART_CHARS) -> DataFrame:
    """df with out: how many different words of entries occur in the text, anywhere; 0 for an empty dictionary, null for a null text."""
    import uuid

    given, kept = df.columns, df.withColumn(out, F.when(F.col(text).isNotNull(), F.lit(0).cast("long")))
    for n, some in enumerate(parts(entries.select(word).distinct(), [word], word, most)):
        words = [w for (w,) in some]
        one = _passed(kept, text, f"{uuid.uuid4().hex}-{n}", words, "bigint", "_more", lambda m, t: len(found(m, t)))
        kept = one.withColumn(out, F.col(out) + F.col("_more")).drop("_more")
    return kept.select(*given, out)


def replace_all(df: DataFrame, entries: DataFrame, text: str = "text", wrong: str = "wrong", right: str = "right", order: str = "pos", most: int = PART_CHARS) -> DataFrame:
    """df with the text after all replacements of entries (wrong, right, and pos, which orders them), as a chain of them would make it; null rights are empty."""
    import uuid

    for n, some in enumerate(parts(entries, [wrong, right], order, most)):
        words = [w for w, _ in some]
        df = _passed(df, text, f"{uuid.uuid4().hex}-{n}", words, "string", text, lambda m, t, pairs=some: replaced(m, pairs, t))
    return df
