"""Queries: event streams and record readers."""

from __future__ import annotations

from datetime import UTC, timedelta

from pyspark.sql import functions as F

from ..operators import rules
from ..operators.workflow import HAPPY_PATH, judged
from ..sources import documents as J
from ..sources import tables as S
from ..sources.paths import work_path
from ..streaming import latest, machine, states


def q_stream_sessions(spark, sf):
    """Sessions that the watermark has closed."""
    return states.run(states.sessions(states.read_events(spark, sf)), "sessions")


def q_batch_sessions(spark, sf):
    e = S.table(spark, sf, "events")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def q_stream_transitions(spark, sf):
    """State machine over all events; of each workflow's, in order, those of one trigger are taken together."""
    e = states.read_events(spark, sf)
    names = F.array(*map(F.lit, HAPPY_PATH))
    state = F.when(F.col("event_type") == "error", "MANUAL_REVIEW").otherwise(F.element_at(names, (F.col("event_id") / 150 + 1).cast("int") % 14 + 1))
    return states.run(states.transitions(e.select(F.col("user_id").alias("workflow_id"), "ts", "event_id", state.alias("state"))), "transitions")


def _workflow_events(e):
    """Events as states of a user's workflow: two days a state, some of them ends."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    on_path = F.element_at(F.array(*map(F.lit, HAPPY_PATH)), F.least(F.floor(day / 2), F.lit(len(HAPPY_PATH) - 1)).cast("int") + 1)
    state = F.when((F.col("event_type") == "error") & (F.col("event_id") % 25 == 0), "FAILED").when(F.col("event_id") % 97 == 5, "MANUAL_REVIEW").otherwise(on_path)
    return e.select(F.col("user_id").alias("workflow_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", state.alias("state"))


def q_judged_states(spark, sf):
    """Transitions of all workflows, legal or not, from the whole log at once."""
    return judged(_workflow_events(S.table(spark, sf, "events")))


def q_judged_stream(spark, sf):
    """The same from the log as a stream on event time."""
    last = S.table(spark, sf, "events").agg(F.max("ts")).first()[0]
    return machine.run_to_end(_workflow_events(states.read_events(spark, sf)), timedelta(days=40), last.replace(tzinfo=UTC))


def q_latest_once(spark, sf):
    """Last event and number of events of each user, from tables that a stream of several batches wrote; the last batch is played twice."""
    source, schema = work_path(spark, "events"), "user_id long, ts timestamp, event_id long, event_type string"
    S.table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type").repartition(6, "event_id").write.parquet(source)
    table = latest.LatestTable(spark, work_path(spark, "latest"), "user_id", ["ts", "event_id"], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source)
    latest.run(stream, table, work_path(spark, "latest-checkpoint"))
    again = max(table.versions().values())
    table.write(table.batch(again), again)
    counts = table.log().groupBy("user_id").agg(F.count(F.lit(1)).alias("n_logged"))
    return table.latest().join(counts, "user_id")


def q_order_json(spark, sf):
    """Orders written as record files and read again, with their totals."""
    own = S.lines(spark, sf)
    text = lambda c: F.col(c).cast("string")
    item = F.struct("sku", F.lit("x").alias("description"), text("quantity").alias("quantity"), text("price").alias("unit_net_price"), text("vat").alias("vat_percent"), text("discount").alias("discount_percent"), text("source_total").alias("source_total"))
    made = own.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("i")))), lambda x: x["i"]).alias("items"))
    out = work_path(spark, "orders-json")
    made.select(F.concat(F.lit("PO-"), text("doc_id")).alias("external_reference"), "items").write.json(out)
    orders = spark.read.schema(J.ORDER).json(out).withColumn("doc_id", F.regexp_extract("external_reference", "[0-9]+", 0).cast("long"))
    typed = orders.withColumn("items", F.transform("items", lambda x: F.struct(x["sku"].alias("sku"), *(J.decimal(x[n], t).alias(n) for n, t in (("quantity", "decimal(14,4)"), ("unit_net_price", "decimal(14,4)"), ("vat_percent", "decimal(7,4)"), ("discount_percent", "decimal(7,4)"), ("source_total", "decimal(14,4)"))))))
    return rules.totals(J.order_lines(typed))


def q_answer_object(spark, sf):
    e = S.table(spark, sf, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("so {x} "), "props", F.lit(" done"))).otherwise("none")
    return e.select("event_id", J.answer_object(text).alias("answer"), J.optional_bool(F.when(F.col("event_id") % 3 == 0, " Yes").when(F.col("event_id") % 3 == 1, "OFF")).alias("flag"))


QUERIES = {name: f for name, f in globals().items() if name.startswith("q_")}

_SESSIONS = """WITH c AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM c)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM i GROUP BY user_id, s"""

_NAMES = ", ".join(f"'{n}'" for n in HAPPY_PATH)


def _judged(state: str) -> str:
    """Transitions one event after the other; state is SQL over an event."""
    return f"""WITH RECURSIVE e AS MATERIALIZED (
  SELECT workflow_id, state, list_position([{_NAMES}], state) - 1 AS pos, state IN ('MANUAL_REVIEW', 'FAILED') AS ends, row_number() OVER (PARTITION BY workflow_id ORDER BY ts, event_id) - 1 AS seq
  FROM (SELECT user_id AS workflow_id, ts, event_id, {state} AS state FROM events)
), m AS (
  SELECT workflow_id, seq, state, CAST(NULL AS VARCHAR) AS prior_state, ends OR coalesce(pos = 0, false) AS legal, CASE WHEN pos = 0 THEN 0 ELSE -1 END AS place, CASE WHEN ends OR pos = 0 THEN state END AS prior FROM e WHERE seq = 0
  UNION ALL
  SELECT workflow_id, seq, state, before, ok, CASE WHEN ok AND NOT ends THEN pos ELSE place END, CASE WHEN ok THEN state ELSE before END FROM (
    SELECT e.*, m.prior AS before, m.place, coalesce(m.prior, '') NOT IN ('MANUAL_REVIEW', 'FAILED', 'FINAL_VERIFIED') AND (ends OR coalesce(pos = m.place + 1, false)) AS ok FROM m JOIN e ON e.workflow_id = m.workflow_id AND e.seq = m.seq + 1)
)
SELECT workflow_id, seq, state, prior_state, legal FROM m"""


_JUDGED = _judged(f"CASE WHEN event_type = 'error' AND event_id % 25 = 0 THEN 'FAILED' WHEN event_id % 97 = 5 THEN 'MANUAL_REVIEW' ELSE [{_NAMES}][least(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 2, 13) + 1] END")


ORACLES = {
    "q_batch_sessions": _SESSIONS,
    "q_stream_sessions": f"SELECT * FROM ({_SESSIONS}) WHERE \"end\" <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
    "q_stream_transitions": _judged(f"CASE WHEN event_type = 'error' THEN 'MANUAL_REVIEW' ELSE [{_NAMES}][(event_id // 150 + 1) % 14 + 1] END"),
    "q_judged_states": _JUDGED,
    "q_judged_stream": _JUDGED,
    "q_latest_once": "SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS n_logged FROM events GROUP BY user_id",
    "q_order_json": S.oracle("SELECT doc_id, CAST(sum(net) AS DECIMAL(18,2)) AS total_net, CAST(sum(line_vat) AS DECIMAL(18,2)) AS total_vat, CAST(sum(net) + sum(line_vat) AS DECIMAL(18,2)) AS total_gross, count(*) AS n_items FROM lines GROUP BY doc_id", "lines"),
    "q_answer_object": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN props END AS answer, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM events",
}
