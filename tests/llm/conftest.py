from __future__ import annotations

import random

import pytest

#: Columns beside those of documents, with names that operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, t string, n int, fp long, row string, gone string, key string, label int"
LANGUAGES = {"aa": "ba ko mi tu lera sodi pan".split(), "bb": "xyl qwor zhun fyrk vlad gruz".split()}


def sentence(r: random.Random, lang: str, words: int) -> str:
    return " ".join("".join(r.choice(LANGUAGES[lang]) for _ in range(r.randint(1, 3))) for _ in range(words))


def make(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "aa", "s", len(r[1]) if r[1] else None, 7, "x", 1, 2, "r", "g", "k", 3) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, a very long one, ties, repeated rows and ids, null ids, characters beyond the basic plane."""
    r = random.Random(1)
    own = [sentence(r, "aa", 30) + "\n" + sentence(r, "aa", 12) for _ in range(6)]
    line = sentence(r, "bb", 20)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One two"), (6, own[0]), (7, own[0]), (8, own[0].replace(" ", "  ")), (9, own[1]), (9, own[1]), (10, own[2]), (10, own[3])]
    rows += [(None, own[4]), (None, None), (11, "12 34 -- !!"), (12, "\U0001d400 😀 é ﬁ ​ x\x00y"), (13, own[5] + "\n" + line), (14, line + "\n" + sentence(r, "aa", 15)), (15, "a\n\n\nb\n"), (16, "\n")]
    rows += [(17, " ".join(sentence(r, "bb", 50) for _ in range(400))), (18, own[0] + " tail"), (19, "x" * 5000)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return make(spark, odd_rows).cache()
