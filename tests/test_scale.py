"""Operators whose work must not grow faster than their input."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from quire.operators import blocks as B
from quire.operators import documents


def _rows(tops):
    out, anchor = [], None
    for i, y in enumerate(tops):
        if anchor is None or y - anchor >= B.ROW_HEIGHT:
            out.append(i)
            anchor = y
    return out


def test_row_fronts(spark):
    r = random.Random(1)
    lists = [[], [1.0], [1.0, 1.0], [0.0, 15.0, 29.9, 30.0], *[sorted(r.uniform(0, 20 * n) for _ in range(n)) for n in range(1, 60)], *[sorted(float(r.randint(0, 9)) * 7.5 for _ in range(40)) for _ in range(20)]]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, y array<double>").select("i", B.row_fronts(F.col("y")).alias("f")).collect()
    assert {x.i: x.f for x in got} == {i: _rows(x) for i, x in enumerate(lists)}


def test_a_page_of_many_detections(spark):
    def page(n):
        r = random.Random(n)
        return spark.createDataFrame([([(f"t{i}", [(r.uniform(0, 100), float(i // 3 * 20))]) for i in range(n)],)], "d array<struct<text:string,points:array<struct<x:double,y:double>>>>").cache()

    def seconds(df):
        best = 1e9
        for _ in range(3):
            began = time.perf_counter()
            rows = df.select(B.scanned_table("d").alias("t")).first().t
            best = min(best, time.perf_counter() - began)
        return best, rows

    (small, few), (large, many) = seconds(page(2_000)), seconds(page(16_000))
    assert len(few) == -(-2_000 // 3) and len(many) == -(-16_000 // 3) and all(len(x) == 3 for x in many[:-1])
    assert large < 24 * max(small, 0.15)  # eight times the detections; a quadratic fold takes 64 times as long


def test_missing_ranges_are_those_of_coverage(spark):
    r = random.Random(2)
    docs = [(f"d{i}", r.choice([None, 0, 1, 5, 12])) for i in range(60)]
    pages = [(r.choice(docs)[0], r.randint(-1, 14)) for _ in range(300)] + [("d1", None)]
    d, p = spark.createDataFrame(docs, "doc_id string, total_pages int"), spark.createDataFrame(pages, "doc_id string, page_number int")
    want = {x.doc_id: (x.expected_pages, x.missing) for x in documents.coverage(d, p).collect()}
    got = {x.doc_id: (x.expected_pages, [n for g in x.ranges for n in range(g.first, g.last + 1)]) for x in documents.missing_ranges(d, p).collect()}
    assert got == want
    big = documents.missing_ranges(spark.createDataFrame([("x", 1_000_000)], "doc_id string, total_pages int"), spark.createDataFrame([("x", 500_000)], "doc_id string, page_number int")).first()
    assert (big.present, big.missing, [tuple(g) for g in big.ranges]) == (1, 999_999, [(1, 499_999), (500_001, 1_000_000)])


def test_prefixes_by_an_equi_join(spark):
    names = spark.createDataFrame([("abc",), ("ab",), ("x",), ("",), (None,)], "name string")
    prefixes = spark.createDataFrame([("a", 1), ("abc", 2), ("abcd", 3), ("", 4), (None, 5)], "prefix string, k int")
    met = documents.by_prefix(names, prefixes)
    assert sorted((x.name, x.k) for x in met.collect()) == [("", 4), ("ab", 1), ("ab", 4), ("abc", 1), ("abc", 2), ("abc", 4), ("x", 4)]
    assert "NestedLoop" not in met._jdf.queryExecution().toString() and documents.by_prefix(names, prefixes.limit(0)).collect() == []


def test_dictionaries_of_any_size(spark):
    from quire.functions import correct as C
    from quire.operators import dictionary as D

    r = random.Random(4)
    word = lambda n: "".join(r.choice("abc") for _ in range(r.randint(1, n)))
    texts = [(i, "".join(r.choice("abcd") for _ in range(r.randint(0, 60)))) for i in range(150)] + [(500, None), (501, "")]
    df = spark.createDataFrame(texts, "id int, text string")
    pairs = [(word(5), word(4)) for _ in range(30)]
    pairs = list(dict(pairs).items()) + [("zz", None), (None, "x"), ("", "y")]
    table = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "pos int, wrong string, right string")

    def chain(t):
        for a, b in pairs:
            t = t.replace(a, b or "") if a else t
        return t

    words = {a for a, _ in pairs if a}
    for most in (1 << 20, 20):  # as one automaton, and in many parts
        assert {x.id: x.text for x in D.replace_all(df, table, most=most).collect()} == {i: None if t is None else chain(t) for i, t in texts}
        assert {x.id: x.hits for x in D.hit_counts(df, table, word="wrong", most=most).collect()} == {i: None if t is None else sum(w in t for w in words) for i, t in texts}
    many = spark.range(100_000).selectExpr("concat('w', id, 'x') as word")
    asked = spark.createDataFrame([(1, "w5x w99999x w100000x"), (2, " ".join(f"w{i}x" for i in range(0, 100_000, 10)))], "id int, text string")
    assert {x.id: x.hits for x in D.hit_counts(asked, many).collect()} == {1: 2, 2: 10_000}
    assert D.hit_counts(df, many.limit(0)).agg(F.sum("hits")).first()[0] == 0 and C.WORD_FIXES
