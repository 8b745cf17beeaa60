"""Chat formatting by perspective rotation, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered once with that speaker as the
assistant and all others as named users; the mask lists the character spans that training should learn:
the speaker's own texts with their end marks. System turns stay system turns and have no perspective.

A rendering is cut into segments of SEGMENT turn numbers, so that no task holds a whole conversation,
however long; segments in order, joined, are the rendering, and `start` is a segment's first character
in it. Starts are prefix sums in two levels, within runs of RUN segments and over the runs' totals.

Turns are ordered by (turn, role, text), nulls first. A null role is the speaker "unknown", a null text
is empty, a null conversation id is a conversation of its own, a null turn counts as turn 0 for the
segment. Repeated rows are rendered as often as they occur. "<|" in texts and names becomes "< |", so
that they cannot forge marks. Only the four columns named are read. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SEGMENT = 64
RUN = 1_024
SYSTEM = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _clean(c: Column, otherwise: str) -> Column:
    return F.replace(F.coalesce(c.cast("string"), F.lit(otherwise)), F.lit("<|"), F.lit("< |"))


def rotated(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, perspective, segment, start, n_chars, n_turns, rendered, mask (spans within the rendering)."""
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        _clean(F.col(role_col), "unknown").alias("role"),
        _clean(F.col(text_col), "").alias("text"),
    ).withColumn("segment", F.floor(F.coalesce("turn", F.lit(0)) / SEGMENT))
    people = rows.filter(F.col("role") != SYSTEM).select("conv_id", F.col("role").alias("perspective")).distinct()
    segments = rows.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    both = segments.alias("s").join(people.alias("p"), F.col("s.conv_id").eqNullSafe(F.col("p.conv_id")))

    def head(t: Column) -> Column:
        name = F.when(t["role"] == F.col("perspective"), F.lit("assistant")).when(t["role"] == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), t["role"]))
        return F.concat(F.lit(OPEN), name, F.lit("\n"))

    pieces = both.select(
        F.col("s.conv_id").alias("conv_id"),
        "perspective",
        "segment",
        F.transform("turns", lambda t: F.struct(head(t).alias("head"), t["text"].alias("text"), (t["role"] == F.col("perspective")).alias("own"))).alias("turns"),
    )
    # one pass over the turns: where each own text begins and ends, counted from the segment's start
    long = F.lit(0).cast("long")
    span = "array<struct<s:bigint,e:bigint>>"

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["head"])
        end = begin + F.length(t["text"]) + F.lit(len(CLOSE))
        spans = F.when(t["own"], F.concat(acc["spans"], F.array(F.struct(begin.cast("long").alias("s"), end.cast("long").alias("e"))))).otherwise(acc["spans"])
        return F.struct((end + 1).cast("long").alias("at"), spans.alias("spans"))

    made = pieces.select(
        "conv_id",
        "perspective",
        "segment",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["text"], F.lit(CLOSE + "\n"))), "").alias("rendered"),
        F.aggregate("turns", F.struct(long.alias("at"), F.array().cast(span).alias("spans")), step).alias("walk"),
    ).withColumn("run", F.floor(F.col("segment") / RUN))
    within = Window.partitionBy("conv_id", "perspective", "run").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    over_runs = Window.partitionBy("conv_id", "perspective").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        made.groupBy("conv_id", "perspective", "run")
        .agg(F.sum("walk.at").alias("chars"))
        .select("conv_id", "perspective", "run", F.coalesce(F.sum("chars").over(over_runs), long).alias("base"))
    )
    local = made.withColumn("local", F.coalesce(F.sum("walk.at").over(within), long))
    same = [F.col("m.conv_id").eqNullSafe(F.col("b.conv_id")), F.col("m.perspective") == F.col("b.perspective"), F.col("m.run") == F.col("b.run")]
    placed = local.alias("m").join(bases.alias("b"), same[0] & same[1] & same[2])
    start = F.col("base") + F.col("local")
    return placed.select(
        F.col("m.conv_id").alias("conv_id"),
        F.col("m.perspective").alias("perspective"),
        "segment",
        start.alias("start"),
        F.col("walk.at").alias("n_chars"),
        "n_turns",
        "rendered",
        F.transform("walk.spans", lambda x: F.struct((x["s"] + start).alias("start"), (x["e"] + start).alias("end"))).alias("mask"),
    )


def op7_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every speaker's perspective; the mask as start:end, comma-joined."""
    made = rotated(common.table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return made.withColumn("mask", mask)


OP7_SQL = """
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn,
         replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text,
         CAST(floor(coalesce(turn, 0) / 64.0) AS BIGINT) AS segment
  FROM conversations
), p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
r AS (
  SELECT t.*, p.perspective, t.role = p.perspective AS own,
         '<|im_start|>' || CASE WHEN t.role = p.perspective THEN 'assistant' WHEN t.role = 'system' THEN 'system' ELSE 'user name=' || t.role END || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), o AS (
  SELECT *, length(head) + length(text) + 11 AS chars,
         coalesce(sum(length(head) + length(text) + 11) OVER (
           PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM r
)
SELECT conv_id, perspective, segment, CAST(min(pos) AS BIGINT) AS start, CAST(sum(chars) AS BIGINT) AS n_chars, count(*) AS n_turns,
       string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
       coalesce(string_agg(CASE WHEN own THEN CAST(pos + length(head) AS VARCHAR) || ':' || CAST(pos + length(head) + length(text) + 10 AS VARCHAR) END, ',' ORDER BY turn NULLS FIRST, role, text), '') AS mask
FROM o GROUP BY conv_id, perspective, segment
"""
