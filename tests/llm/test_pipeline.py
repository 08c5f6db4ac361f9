from __future__ import annotations

import random

import corpus_pipeline
from quire.llm.common import gapless

from .conftest import make, sentence


def test_stages_in_order(spark, tmp_path):
    r = random.Random(1)
    item = sentence(r, "aa", 40)
    line = sentence(r, "aa", 14)
    base = sentence(r, "bb", 400).split()
    rows = [(i, sentence(r, lang, 60), lang) for i in range(100) for lang in [("aa", "bb")[i % 2]]]
    rows += [(200, "12 -- 34", "aa"), (201, None, "aa"), (202, " ".join(base), "bb"), (203, " ".join([*base[:9], "novel", *base[10:]]), "bb")]
    rows += [(204, f"{sentence(r, 'aa', 20)} {item} {sentence(r, 'aa', 20)}", "aa"), (205, f"{line}\n{sentence(r, 'aa', 30)}", "aa"), (206, f"{sentence(r, 'aa', 30)}\n{line}", "aa"), (207, rows[0][1], "aa")]
    make(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, left = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "sentencepiece":
            assert docs.columns == columns and dict(docs.dtypes)["n_chars"] == "bigint"
            docs.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
        left.append({x.doc_id: x for x in docs.collect()})
    every = {i for i, *_ in rows}
    assert set(left[0]) == every - {200, 201}
    assert set(left[1]) == every - {200, 201, 207}
    assert left[1][206].text == left[1][206].text.split("\n")[0] and left[1][205].text.count("\n") == 1
    assert left[1][206].n_chars == len(left[1][206].text)
    assert set(left[2]) == every - {200, 201, 203, 207}
    assert set(left[3]) == set(left[2]) - {204}
    assert set(left[4]) == set(left[3]) and all(x.same for x in left[4].values())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {tuple(x) for x in got} == {tuple(x) for x in left[4].values()}


def test_gapless_numbers_are_in_order(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    got = gapless(df, ["k"], ["v"], (F.col("v") / 100).cast("int"), 10, "place").collect()
    assert all(x.place == x.v // 3 for x in got)


def test_odd_rows_go_through_all_stages(spark, odd, odd_rows, tmp_path):
    spark.createDataFrame([(1, "x " * 30), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd.withColumnsRenamed({"t": "_gone", "fp": "bucket"})  # names that steps might use themselves
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "sentencepiece":
            assert docs.columns == columns
            docs.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
    left = docs.collect()
    assert {x.doc_id for x in left} <= {i for i, _ in odd_rows} and all(x.same for x in left)
    assert not {1, 2, 3, 16} & {x.doc_id for x in left}  # no letters


def test_empty_tables_go_through_all_stages(spark, odd, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0
