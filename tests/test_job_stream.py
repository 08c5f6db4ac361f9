"""The state machine of jobs in a stream."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quire.streaming import jobs

T0 = datetime(2024, 1, 1)


def at(minutes: float) -> datetime:
    return T0 + timedelta(minutes=minutes)


def event(doc, what, minutes, page=None, total=None, message=None, seq=0):
    return (doc, what, at(minutes), seq, page, total, message)


#: a ends well, b is canceled, c falls silent, d fails, e was never submitted, f goes on after it had ended.
EVENTS = [
    event("a", "submitted", 0, total=3), event("b", "submitted", 0), event("c", "submitted", 1), event("a", "started", 2), event("c", "started", 2), event("a", "page", 3, 1, 3), event("c", "page", 4, 1, 9),
    event("b", "canceled", 5), event("d", "submitted", 6), event("d", "started", 7), event("e", "page", 8, 1, 2), event("a", "page", 9, 2, 3), event("d", "failed", 10, message="broken"), event("a", "page", 11, 3, 3),
    event("a", "finished", 12, total=3), event("b", "started", 13), event("d", "canceled", 14), event("f", "submitted", 20), event("f", "started", 60), event("z", "submitted", 200),
]
WANT = {"a": ("done", 3, 3, None), "b": ("failed", 0, 0, jobs.CANCELED_BY), "c": ("failed", 1, 9, jobs.SILENT), "d": ("failed", 0, 0, "broken"), "f": ("failed", 0, 0, jobs.SILENT), "z": ("pending", 0, 0, None)}


@pytest.mark.parametrize("batches", [1, 4, len(EVENTS)])
def test_events_end_as_they_should(spark, tmp_path, batches):
    """However the events are cut into batches, with cancellations as a second input; a replay changes nothing."""
    jobs.with_state_store(spark)
    size = -(-len(EVENTS) // batches)
    read = lambda name: spark.readStream.schema(jobs.EVENTS).parquet(f"{tmp_path}/{name}")
    (tmp_path / "own").mkdir()
    (tmp_path / "cancel").mkdir()

    def run():
        states = jobs.job_states(read("own").unionByName(read("cancel")), "30 minutes", "1 minute", "365 days")
        jobs.write_states(states, f"{tmp_path}/states", f"{tmp_path}/check").awaitTermination()

    if batches > 5:  # a start of the stream is some seconds: several events of this many in each
        size = 5
    for k in range(0, len(EVENTS), size):
        some = spark.createDataFrame(EVENTS[k : k + size], jobs.EVENTS).coalesce(1)
        some.filter("event <> 'canceled'").write.mode("append").parquet(f"{tmp_path}/own")
        some.filter("event = 'canceled'").write.mode("append").parquet(f"{tmp_path}/cancel")
        if batches > 1:
            run()
    run()
    got = {r.doc_id: (r.status, r.current_page, r.total_pages, r.error_msg) for r in jobs.last_states(spark, f"{tmp_path}/states").collect()}
    assert got == WANT
    assert {r.doc_id: r.started_at for r in jobs.last_states(spark, f"{tmp_path}/states").collect()}["a"] == at(2)
    before = sorted(map(tuple, jobs.last_states(spark, f"{tmp_path}/states").collect()))
    run()
    assert sorted(map(tuple, jobs.last_states(spark, f"{tmp_path}/states").collect())) == before
    shots = {r.doc_id: (r.status, r.message) for r in jobs.progress(jobs.last_states(spark, f"{tmp_path}/states")).collect()}
    assert shots["c"] == ("failed", jobs.SILENT) and shots["a"] == ("done", "")


def test_steps():
    s = jobs.step(None, "page", T0, 1, 1, None)
    assert s is None and jobs.step(None, "submitted", T0, None, None, None) == ("pending", 0, 0, None, None)
    p = jobs.step(jobs.step(None, "submitted", T0, None, 4, None), "started", T0, None, None, None)
    assert p == ("processing", 0, 4, T0, None) and jobs.step(p, "submitted", T0, None, None, None) == p
    assert jobs.step(p, "page", T0, 3, None, None)[1] == 3 and jobs.step(jobs.step(p, "page", T0, 3, None, None), "page", T0, 2, None, None)[1] == 3


def test_ingest_says_what_becomes_of_documents(spark, tmp_path):
    from quire.sources import sinks
    from quire.streaming import ingest as stream

    jobs.with_state_store(spark)
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.pdf").write_bytes(b"1\n2\n3")
    (inbox / "b.pdf").write_bytes(b"\n")
    pages = lambda df: df.select("doc_id", F.posexplode(F.split(F.col("content").cast("string"), "\n"))).filter("col <> ''").select("doc_id", (F.col("pos") + 1).alias("page_number"), F.col("col").alias("text"))

    def run():
        stream.ingest(stream.inbox(spark, str(inbox)), pages, f"{tmp_path}/rows", f"{tmp_path}/check", log=f"{tmp_path}/log").awaitTermination()
        jobs.write_states(jobs.job_states(stream.read_log(spark, f"{tmp_path}/log")), f"{tmp_path}/states", f"{tmp_path}/states-check").awaitTermination()
        return {r.doc_id.split("_")[0]: (r.status, r.current_page, r.total_pages, r.error_msg) for r in jobs.last_states(spark, f"{tmp_path}/states").collect()}

    want = {"a": ("done", 3, 3, None), "b": ("failed", 0, 0, "No pages")}
    assert run() == want and sinks.read_page_rows(spark, f"{tmp_path}/rows").count() == 3
    (inbox / "c.pdf").write_bytes(b"1")
    assert run() == want | {"c": ("done", 1, 1, None)}
