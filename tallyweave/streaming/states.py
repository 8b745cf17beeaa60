"""The workflow's event log as a stream: state machine, checkpoints and sessions.

State per workflow is a few numbers, watermarks bound the sessions' state, and sinks are Parquet with a
checkpoint folder, so a restart goes on where it stopped and writes nothing twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.workflow import ENDS, HAPPY_PATH
from ..sources.paths import ship, work_path


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    path = f"{sf_dir}/events.parquet"
    batch = spark.read.parquet(path)
    single = batch.inputFiles()[0].rstrip("/").endswith("events.parquet")
    reader = spark.readStream.schema(batch.schema)
    found = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if single else reader.parquet(path)
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


def run(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is and returns what it wrote."""
    spark = stream.sparkSession
    out, state = work_path(spark, name), work_path(spark, f"{name}-checkpoint")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Bursts of a user's events: an addition of this library, close to waiting for a list to settle."""
    timed = events.withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


TRANSITIONS = "workflow_id long, seq long, state string, prior_state string, legal boolean"


def machine(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Transitions of one workflow: a state may follow its predecessor on the path, or end the run; nothing follows an end."""
    place, seq, prior = state.get if state.exists else (-1, 0, None)
    rows = []
    for batch in [pd.concat(list(batches)).sort_values(["ts", "event_id"])]:
        for name in batch["state"]:
            ended = prior in ENDS or prior == HAPPY_PATH[-1]
            nxt = HAPPY_PATH.index(name) if name in HAPPY_PATH else place
            legal = not ended and (name in ENDS or nxt == place + 1)
            rows.append((key[0], seq, name, prior, legal))
            seq += 1
            if legal:
                place, prior = nxt, name
    state.update((place, seq, prior))
    if rows:
        yield pd.DataFrame(rows, columns=["workflow_id", "seq", "state", "prior_state", "legal"])


def transitions(events: DataFrame) -> DataFrame:
    """State machine over events (workflow_id, ts, event_id, state), one small state per workflow."""
    ship(events.sparkSession)
    return events.groupBy("workflow_id").applyInPandasWithState(machine, TRANSITIONS, "place int, seq long, prior string", "append", "NoTimeout")
