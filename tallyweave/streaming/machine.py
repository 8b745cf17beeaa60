"""The workflow's state machine on event time: events are judged in order of their time, whatever order they come in.

Each workflow keeps the events that wait, its place on the path and one timer, at the earliest event that waits. Once
the watermark has passed an event no earlier one can come, and it is judged. So state holds what came within the
allowed lateness only, and the result is that of the batch (`operators.workflow.judged`), as long as nothing comes later
than that. Rows behind the watermark are dropped by the engine, null times and ids are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.workflow import ENDS, HAPPY_PATH
from ..sources.paths import ship, work_path

OUT = "workflow_id long, seq long, state string, prior_state string, legal boolean"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State that a closing event has, which no workflow takes part in.
CLOSING = "(end of the log)"


def step(place: int, prior: str | None, name: str) -> tuple[bool, int, str | None]:
    """(legal, place, prior) after a state: it may follow its predecessor on the path, or end the run; nothing follows an end."""
    ended = prior in ENDS or prior == HAPPY_PATH[-1]
    place_of = HAPPY_PATH.index(name) if name in HAPPY_PATH else None
    legal = not ended and (name in ENDS or place_of == place + 1)
    return (True, place if place_of is None else place_of, name) if legal else (False, place, prior)


class Machine(StatefulProcessor):
    """Transitions of one workflow; `waiting` has its events by time in microseconds and id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "place int, seq long, prior string")
        self.waiting = handle.getMapState("waiting", "at long, event_id long", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        earliest = None
        for row in rows:
            if row.event_id is None:
                continue
            self.waiting.updateValue((row.micros, row.event_id), (row.state or "",))
            earliest = row.micros if earliest is None else min(earliest, row.micros)
        if earliest is not None:
            self._wake(earliest)
        return iter(())

    def _wake(self, micros: int) -> None:
        """One timer, at the first full millisecond from the event on."""
        at = -(-micros // 1000)
        timers = list(self.handle.listTimers())
        if not timers or at < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        due, later = [], None
        for k, v in self.waiting.iterator():
            if k[0] <= limit:
                due.append((k[0], k[1], v[0]))
            else:
                later = k[0] if later is None else min(later, k[0])
        place, seq, prior = self.at.get() if self.at.exists() else (-1, 0, None)
        for micros, event_id, name in sorted(due):
            before = prior
            legal, place, prior = step(place, prior, name)
            yield Row(workflow_id=key[0], seq=seq, state=name, prior_state=before, legal=legal)
            seq += 1
            self.waiting.removeKey((micros, event_id))
        self.at.update((place, seq, prior))
        if later is not None:
            self.handle.registerTimer(-(-later // 1000))

    def close(self) -> None:
        pass


def transitions(events: DataFrame, late: str) -> DataFrame:
    """(workflow_id, seq, state, prior_state, legal) of a stream of events (workflow_id, ts, event_id, state)."""
    ship(events.sparkSession)
    timed = events.filter("workflow_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    rows = timed.select("workflow_id", "ts", F.unix_micros("ts").alias("micros"), "event_id", "state")
    return rows.groupBy("workflow_id").transformWithState(statefulProcessor=Machine(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def run(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs a stream of transitions over all there is and returns what it wrote so far, without a closing event's."""
    spark = stream.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STORE)
    try:
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(stream.schema).parquet(out).filter(F.col("state") != CLOSING)


def run_to_end(events: DataFrame, late: timedelta, last: datetime) -> DataFrame:
    """All transitions of a stream of events that ends at `last`: once it is read, one more event moves the watermark beyond the end.

    The closing event comes from a folder that is empty until then, in a second run on the same checkpoint.
    """
    spark = events.sparkSession
    end, out, checkpoint = (work_path(spark, f"transitions{n}") for n in ("-closing", "", "-checkpoint"))
    schema = "workflow_id long, ts timestamp, event_id long, state string"
    columns = schema.replace(",", "").split()[::2]
    spark.createDataFrame([], schema).write.parquet(end)
    whole = events.select(*columns).unionByName(spark.readStream.schema(schema).parquet(end))
    stream = transitions(whole, f"{int(late.total_seconds())} seconds")
    run(stream, out, checkpoint)
    at = (last + late + timedelta(seconds=2)).replace(tzinfo=UTC)
    spark.createDataFrame([(-1, at, -1, CLOSING)], schema).coalesce(1).write.mode("append").parquet(end)
    return run(stream, out, checkpoint)
