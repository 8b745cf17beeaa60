"""Append-only logs, versioned snapshots and JSON payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_events(events: DataFrame, path: str) -> None:
    """Adds events (workflow_id, timestamp, event, details map) to a log of JSON lines."""
    events.select("workflow_id", "timestamp", "event", "details").write.mode("append").json(path)


def save_snapshot(rows: DataFrame, path: str, version: int) -> None:
    """Writes one version of a table to a folder of its own; Spark's commit makes it appear whole."""
    rows.write.mode("overwrite").parquet(f"{path}/version={version}")


def load_latest(spark: SparkSession, path: str, key: str, at: str) -> DataFrame:
    """The last row of each key over all versions."""
    rows = spark.read.parquet(path)
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(at, "version")).alias("x")).select(key, "x.*")


def payload(rows: DataFrame, key: str) -> DataFrame:
    """Each row as one JSON text; decimals and dates are written as text."""
    plain = [F.col(c).cast("string").alias(c) if t.startswith("decimal") or t in ("date", "timestamp") else F.col(c) for c, t in rows.dtypes]
    return rows.select(F.col(key), F.to_json(F.struct(*plain)).alias("payload"))
