"""Timeline tables derived from the test tables, each as a DataFrame and as the same thing in SQL.

turns: conversations on a time axis. steps: transitions of step states, from events. spans: steps' starts with the completions
that follow. blocks: intervals, some of them points. frames: what was generated and referred to in each ten-minute frame of a user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.session import table

DERIVED_SQL = {
    "turns": """SELECT conv_id, turn, role, text,
      (sum(1500 + 50 * length(text)) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT / 1000.0::DOUBLE AS time FROM conversations""",
    "timed": """SELECT event_id, user_id, event_type, value,
      (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1000000.0::DOUBLE AS time FROM events""",
    "steps": """SELECT event_id, user_id, time, 'S' || (event_id % 8) AS step_id,
      CASE event_type WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'reset' END AS transition
      FROM timed WHERE event_type IN ('view', 'purchase', 'error')""",
    "spans": """SELECT user_id, step_id, event_id AS span_id, time AS start_ts, next_time AS end_ts FROM (
      SELECT *, lead(transition) OVER w AS next_transition, lead(time) OVER w AS next_time FROM steps
      WHERE transition <> 'reset' WINDOW w AS (PARTITION BY user_id, step_id ORDER BY time, event_id))
      WHERE transition = 'start' AND next_transition = 'complete'""",
    "blocks": """SELECT user_id, event_id, event_type AS text, time AS start_ts,
      CASE WHEN event_id % 5 <> 0 THEN time + (event_id % 7) * 7200 END AS end_ts FROM timed""",
    "frames": """SELECT user_id, floor(time / 600)::BIGINT AS frame, max(CASE WHEN event_type = 'click' THEN 'click' ELSE '' END) AS gen,
      max(CASE WHEN event_type = 'view' THEN 'view' ELSE '' END) AS ref FROM timed GROUP BY ALL""",
}


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    ms = F.sum(1500 + 50 * F.char_length("text")).over(order)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", (ms / F.lit(1000.0)).alias("time"))


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    first = F.min(us).over(Window.partitionBy("user_id"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", ((us - first) / F.lit(1000000.0)).alias("time"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    change = F.when(kind == "view", "start").when(kind == "purchase", "complete").when(kind == "error", "reset")
    return timed(spark, sf_dir).filter(kind.isin("view", "purchase", "error")).select("event_id", "user_id", "time", F.concat(F.lit("S"), (F.col("event_id") % 8).cast("string")).alias("step_id"), change.alias("transition"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id", "step_id").orderBy("time", "event_id")
    paired = steps(spark, sf_dir).filter("transition <> 'reset'").withColumns({"nt": F.lead("transition").over(w), "end_ts": F.lead("time").over(w)})
    return paired.filter("transition = 'start' AND nt = 'complete'").select("user_id", "step_id", F.col("event_id").alias("span_id"), F.col("time").alias("start_ts"), "end_ts")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(F.col("event_id") % 5 != 0, F.col("time") + (F.col("event_id") % 7) * 7200)
    return timed(spark, sf_dir).select("user_id", "event_id", F.col("event_type").alias("text"), F.col("time").alias("start_ts"), end.alias("end_ts"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = lambda kind: F.max(F.when(F.col("event_type") == kind, kind).otherwise(""))
    return timed(spark, sf_dir).groupBy("user_id", F.floor(F.col("time") / 600).alias("frame")).agg(said("click").alias("gen"), said("view").alias("ref"))
