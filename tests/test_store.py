"""Tables in which a run replaces its documents' rows."""

from __future__ import annotations

import pytest

from quire.sources import store

SCHEMA = "doc_id string, n int"


def rows(spark, *given):
    return spark.createDataFrame(list(given), SCHEMA)


def ids(spark, *given):
    return spark.createDataFrame([(i,) for i in given], "doc_id string")


def held(spark, root, form="parquet"):
    return sorted((r.doc_id, r.n) for r in store.current(spark, root, form=form).collect())


@pytest.mark.parametrize("form", ["parquet", "json"])
def test_a_run_replaces_its_documents(spark, tmp_path, form):
    at = f"{tmp_path}/t"
    put = lambda fresh, docs: store.replace(fresh, docs, at, form=form, buckets=4)
    put(rows(spark, ("a", 1), ("a", 2), ("b", 1), ("c", 1)), ids(spark, "a", "b", "c"))
    put(rows(spark, ("a", 9)), ids(spark, "a", "b"))
    for _ in range(2):  # a repeat changes nothing
        put(rows(spark, ("d", 1), ("not of the run", 1)), ids(spark, "d", None))
        assert held(spark, at, form) == [("a", 9), ("c", 1), ("d", 1)]
    store.remove(ids(spark, "a", "c", "d"), at, form=form)
    assert not list((tmp_path / "t" / "rows").glob("bucket=*"))  # no bucket keeps rows of emptied documents
    assert store.exists(spark, at) and store.current(spark, at, form=form, schema=rows(spark).schema).collect() == []


def test_other_buckets_are_not_touched(spark, tmp_path):
    at = f"{tmp_path}/t"
    store.replace(rows(spark, *[(str(i), i) for i in range(200)]), ids(spark, *map(str, range(200))), at, buckets=16)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "rows").glob("bucket=*/*.parquet")}
    assert len({p.parent for p in before}) == 16
    store.replace(rows(spark, ("7", 70)), ids(spark, "7"), at, buckets=99)  # it keeps the number that it has
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "rows").glob("bucket=*/*.parquet")}
    assert len({p.parent for p in before.keys() - after.keys()}) == 1
    assert held(spark, at) == sorted([(str(i), i) for i in range(200) if i != 7] + [("7", 70)])


def test_appended_runs_hide_and_are_folded(spark, tmp_path):
    at = f"{tmp_path}/t"
    store.replace(rows(spark, ("a", 1), ("b", 1)), ids(spark, "a", "b"), at)
    store.append(rows(spark, ("a", 2), ("c", 2)), ids(spark, "a", "c"), at, "1")
    store.append(rows(spark, ("c", 3)), ids(spark, "c", "b"), at, "2")
    store.append(rows(spark, ("c", 3)), ids(spark, "c", "b"), at, "2")  # the batch that is run again
    want = [("a", 2), ("c", 3)]
    assert held(spark, at) == want
    # a run whose list isn't written isn't there
    rows(spark, ("z", 1)).write.parquet(f"{at}/runs/run=r-3")
    assert held(spark, at) == want
    store.fold(spark, at)
    assert held(spark, at) == want and not store.exists(spark, f"{at}/lists/run=r-1") and not store.exists(spark, f"{at}/next")
    plan = store.current(spark, at)._jdf.queryExecution().toString()
    assert "Join" not in plan  # a read of what is folded touches rows alone
    store.fold(spark, at)
    assert held(spark, at) == want


def test_a_broken_overwrite_is_made_again(spark, tmp_path, monkeypatch):
    at = f"{tmp_path}/t"
    store.replace(rows(spark, ("a", 1), ("b", 1)), ids(spark, "a", "b"), at, buckets=2)
    whole = store._overwrite

    def dies(*args):
        store.drop(spark, *[str(p) for p in (tmp_path / "t" / "rows").glob("bucket=*")])  # as if it had got no further than the old buckets
        raise OSError("the driver is gone")

    monkeypatch.setattr(store, "_overwrite", dies)
    with pytest.raises(OSError):
        store.replace(rows(spark, ("a", 2)), ids(spark, "a"), at)
    monkeypatch.setattr(store, "_overwrite", whole)
    assert [x for x in held(spark, at) if x[0] == "a"] == [("a", 2)]
    # one that hadn't got as far as its last file is dropped
    rows(spark, ("a", 5)).write.parquet(f"{at}/next/rows")
    assert [x for x in held(spark, at) if x[0] == "a"] == [("a", 2)] and not store.exists(spark, f"{at}/next")


def test_new_columns_and_ids_of_other_types(spark, tmp_path):
    at = f"{tmp_path}/t"
    store.replace(rows(spark, ("a", 1)), ids(spark, "a"), at, buckets=4)
    store.replace(spark.createDataFrame([("b", 2, "x")], "doc_id string, n int, more string"), ids(spark, "b"), at)
    assert sorted((r.doc_id, r.n, r.more) for r in store.current(spark, at).collect()) == [("a", 1, None), ("b", 2, "x")]
    numbers = f"{tmp_path}/n"
    for n in (1, 2):
        store.replace(spark.createDataFrame([(1 << 60, n)], "doc_id long, n int"), spark.createDataFrame([(1 << 60,), (2,)], "doc_id long"), numbers)
    assert [tuple(r) for r in store.current(spark, numbers).collect()] == [(1 << 60, 2)]
    with pytest.raises(FileNotFoundError):
        store.current(spark, f"{tmp_path}/none")


def test_statistics_follow_verdicts(spark, tmp_path):
    """After many runs of verdicts the folded cells are those of a full rebuild, compacted or not; no page JSON is there to be read."""
    import random

    from pyspark.sql import functions as F

    from quire.operators import corpus
    from quire.sources import files, sinks

    r = random.Random(3)
    pages = [(f"d{i % 40}", i // 40 + 1, "w " * r.randint(0, 9), r.choice(["surya", "gemini"]), r.choice([0.5, 0.7, 0.9, 0.86005]), r.choice(["govt", "news"]), r.random() < 0.3) for i in range(200)]
    own = spark.createDataFrame(pages, "doc_id string, page_number int, full_text string, engine string, confidence_score double, domain string, verified boolean")
    corpus.corpus_records(own).write.parquet(f"{tmp_path}/corpus")
    records = spark.read.parquet(f"{tmp_path}/corpus")
    sinks.write_cells(records, f"{tmp_path}/stats")
    for run in range(6):
        some = [(*r.choice(pages)[:2], r.random() < 0.5, r.randint(1, 50)) for _ in range(170)] + [("nowhere", 1, True, 1)]
        verdicts = spark.createDataFrame(some, "doc_id string, page_number int, verified boolean, s int").select("doc_id", "page_number", "verified", F.timestamp_seconds("s").alias("at"))
        for _ in range(2 if run % 3 == 0 else 1):
            sinks.append_verdicts(records, verdicts, f"{tmp_path}/votes", f"{tmp_path}/stats", str(run))
    votes = files.read_verifications(spark, f"{tmp_path}/votes")
    assert votes.count() == 6 * 171
    want = corpus.corpus_stats(corpus.corpus_records(corpus.verify(own, votes))).first()
    assert sinks.read_stats(spark, f"{tmp_path}/stats").first() == want
    sinks.compact_cells(spark, f"{tmp_path}/stats", f"{tmp_path}/compact")
    assert sinks.read_stats(spark, f"{tmp_path}/compact").first() == want


def test_a_deleted_document_leaves_the_store(spark, tmp_path):
    from quire import api
    from quire.sources import files, sinks

    rows_ = [("D1", 1, "one", "surya", 0.9), ("D1", 2, "two", "surya", 0.9), ("D2", 1, "three", "gemini", 0.7)]
    pages = spark.createDataFrame(rows_, "doc_id string, page_number int, full_text string, engine string, confidence_score double")
    at = api.Store(*(f"{tmp_path}/{x}" for x in ("pages", "votes", "corpus", "stats")), cells=f"{tmp_path}/cells", page_rows=f"{tmp_path}/rows", merged=f"{tmp_path}/merged", texts=f"{tmp_path}/texts")
    docs = spark.createDataFrame([("1", "u", "D1"), ("2", "u", "D2")], "id string, user_id string, doc_id string")
    sinks.write_page_json(pages, at.pages)
    sinks.write_page_rows(pages, at.page_rows)
    sinks.write_texts(pages, at.texts)
    sinks.write_merged_json(docs.select("doc_id"), pages, at.merged)
    sinks.rebuild_corpus(spark, at.pages, at.corpus, at.stats, None, at.cells)
    empty = spark.createDataFrame([], files.PROGRESS_SCHEMA)
    jobs = spark.createDataFrame([("j", "1")], "id string, document_id string")
    t = api.Tables(docs, jobs, pages, empty, spark.createDataFrame([], files.VERIFICATION_SCHEMA))
    assert api.stats(t, at).first().total_records == 3
    left = api.delete(t, "D1", "u", at)
    assert left["pages"].count() == 1 and left["jobs"].count() == 0
    for path, form in ((at.page_rows, "parquet"), (at.texts, "json"), (at.merged, "json")):
        assert {r.doc_id for r in store.current(spark, path, form=form).collect()} == {"D2"}
    assert {r.doc_id for r in files.read_page_json(spark, at.pages).collect()} == {r.doc_id for r in spark.read.parquet(at.corpus).collect()} == {"D2"}
    assert api.stats(t, at).first().total_records == 1
    api.verify(t, "D2", 1, True, at, rebuild=False)
    assert dict(api.stats(t, at).first().by_tier) == {"silver": 1}


def test_scratch_tables_go_with_their_scope_and_old_ones_are_swept(spark, monkeypatch, tmp_path):
    import os

    from quire.sources import scratch

    with scratch.scoped(spark) as keep:
        gone, kept = scratch.written(rows(spark, ("a", 1)), "x"), keep(scratch.written(rows(spark, ("b", 2)), "y"))
        paths = [p for _, p in scratch._made[-2:]]
        assert gone.count() == 1
    assert [store.exists(spark, p) for p in paths] == [False, True] and kept.count() == 1
    monkeypatch.setattr(scratch, "shared_dir", lambda spark: f"file://{tmp_path}")
    for name, age in (("quire-old-1", 100), ("quire-new-2", 1), ("other", 100)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part").write_text("x")
        for p in (tmp_path / name / "part", tmp_path / name):
            os.utime(p, (p.stat().st_mtime - age * 3600,) * 2)
    assert scratch.sweep(spark) == 1 and {p.name for p in tmp_path.iterdir()} == {"quire-new-2", "other"}
