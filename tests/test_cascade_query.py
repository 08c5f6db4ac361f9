from __future__ import annotations

from quire.plans.page_queries import recognition_cascade


def test_quick_engine_reads_whole_texts(spark, tmp_path):
    texts = {0: "ab " * 12 + "cd", 1: "ab " * 30 + "cd", 2: "word " * 30 + "end", 3: "word " * 100 + "end"}
    rows = [(1, turn, "assistant", t) for turn, t in texts.items()]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {x.page_number: x for x in recognition_cascade(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    # of the words of the quick engine each is a block
    assert [got[i].blocks for i in (0, 1)] == [len(texts[i].split()) for i in (0, 1)], got
    assert got[0].engine == got[1].engine, got
