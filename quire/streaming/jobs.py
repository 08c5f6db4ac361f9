"""Jobs as a state machine in a stream: their events in, every change of a job out.

A job is pending when its document is submitted, processing when it is started, and ends as done or failed. A canceled job has failed, and so has one of which nothing is heard for a while after its last event: a
timer in event time says so, when the stream's watermark has passed it. What a job's state doesn't allow changes nothing, but shows that somebody is at work. The state of an ended job is dropped after a time.

The fold of a job's events is the same however they are cut into batches: a gap that is too long is seen between two events of one batch as by the timer between two batches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

from ..operators.corpus import latest

#: An event: what became of a document, and when; seq orders those of one time, and page and total say how far it is.
EVENTS = "doc_id string, event string, at timestamp, seq long, page int, total int, message string"
STATES = "doc_id string, status string, current_page int, total_pages int, started_at timestamp, updated_at timestamp, error_msg string, version long"
SUBMITTED, STARTED, PAGE, FINISHED, FAILED, CANCELED = "submitted", "started", "page", "finished", "failed", "canceled"
CANCELED_BY, SILENT = "Canceled by user", "No progress"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Times in the machine are microseconds: workers and sessions needn't agree on a time zone.
_STATE = "status string, page int, total int, started long, at long, message string, version long"
_SHOWN = "doc_id string, status string, current_page int, total_pages int, started_at long, updated_at long, error_msg string, version long"


def step(state: tuple | None, event: str, at: int, page: int | None, total: int | None, message: str | None) -> tuple | None:
    """The state (status, page, total, started, message) after an event; the same one if the event isn't for it."""
    status, p, t, started, _ = state or (None, 0, 0, None, None)
    if status is None:
        return ("pending", 0, total or 0, None, None) if event == SUBMITTED else None
    if status == "pending" and event == STARTED:
        return ("processing", 0, total or t, at, None)
    if status in ("pending", "processing") and event == CANCELED:
        return ("failed", p, t, started, CANCELED_BY)
    if status == "processing" and event == PAGE:
        return (status, max(p, page or 0), total or t, started, None)
    if status == "processing" and event == FINISHED:
        return ("done", total or t, total or t, started, None)
    if status == "processing" and event == FAILED:
        return ("failed", p, t, started, message)
    return state


class Jobs(StatefulProcessor):
    """silence: milliseconds without an event after which an active job has failed; keep: for how long the state of an ended one is held."""

    def __init__(self, silence: int, keep: int) -> None:
        self.silence, self.keep = silence, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.job = handle, handle.getValueState("job", _STATE)

    def _shown(self, key: tuple, s: tuple, at: int, version: int) -> Row:
        return Row(doc_id=key[0], status=s[0], current_page=s[1], total_pages=s[2], started_at=s[3], updated_at=at, error_msg=s[4], version=version)

    def _due(self, status: str, at: int) -> int:
        return at // 1000 + (self.silence if status in ("pending", "processing") else self.keep) + 1

    def _put(self, s: tuple, at: int, version: int, timer: int | None) -> None:
        """A job's state and its one timer. What a worker asks of the store is a round trip each, so the timer that there is follows from the state and isn't asked for."""
        own = self._due(s[0], at)
        self.job.update((s[0], s[1], s[2], s[3], at, s[4], version))
        if timer != own:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(own)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        own = self.job.get()
        timer = None if own is None else self._due(own[0], own[4])
        s, at, version = (None, None, 0) if own is None else ((*own[:4], own[5]), own[4], own[6])
        for r in sorted(rows, key=lambda r: (r.us, r.seq or 0)):
            if s is not None and at is not None and s[0] in ("pending", "processing") and r.us - at > self.silence * 1000:
                s, at, version = ("failed", s[1], s[2], s[3], SILENT), at + self.silence * 1000, version + 1
                yield self._shown(key, s, at, version)
            after = step(s, r.event, r.us, r.page, r.total, r.message)
            if after is None:
                continue
            ended = s is not None and s[0] not in ("pending", "processing")
            if after != s:
                version += 1
                yield self._shown(key, after, r.us, version)
            s, at = after, at if ended else r.us
        if s is not None:
            self._put(s, at, version, timer)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        own = self.job.get()
        if own is None:
            return
        if own[0] not in ("pending", "processing"):
            self.job.clear()
            return
        s, at, version = ("failed", own[1], own[2], own[3], SILENT), own[4] + self.silence * 1000, own[6] + 1
        self._put(s, at, version, self._due(own[0], own[4]))
        yield self._shown(key, s, at, version)

    def close(self) -> None:
        pass


def job_states(events: DataFrame, silence: str = "30 minutes", late: str = "10 minutes", keep: str = "30 days") -> DataFrame:
    """A stream of STATES: every change of every job, of a stream of EVENTS; several inputs, such as events of workers and cancellations, are one by unionByName(). Late events are those that the watermark
    has passed. Needs the RocksDB state store (with_state_store())."""
    millis = lambda x: int(events.sparkSession.sql(f"select timestampdiff(MILLISECOND, timestamp'2000-01-01', timestamp'2000-01-01' + interval {x})").first()[0])
    keyed = events.withColumn("us", F.unix_micros("at")).withWatermark("at", late).groupBy("doc_id")
    out = keyed.transformWithState(Jobs(millis(silence), millis(keep)), outputStructType=_SHOWN, outputMode="Update", timeMode="EventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("started_at", "updated_at")})


def with_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def write_states(states: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the changes of each batch as a folder of its own, so one that is run again replaces itself. Stops when all is read; the next start goes on from there."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch=b{number:010d}")

    return states.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_states(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each job that write_states() has written: the one of the highest version."""
    return latest(spark.read.option("basePath", path).schema(STATES + ", batch string").parquet(path).drop("batch"), ["doc_id"], "version")


def progress(states: DataFrame) -> DataFrame:
    """Snapshots (sources.files.PROGRESS_SCHEMA) of states."""
    at = F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return states.select("doc_id", "current_page", "total_pages", "status", F.coalesce("error_msg", F.lit("")).alias("message"), at.alias("updated_at"))
