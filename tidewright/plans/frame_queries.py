"""Queries over frame and state operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.operators import frames as R
from tidewright.operators import states as S
from tidewright.plans import derived as D
from tidewright.plans.registry import query

_T, _E = ("turns",), ("timed", "steps")
_CONTINUOUS = """SELECT *, coalesce(max(end_frame) OVER (PARTITION BY conv_id ORDER BY time, rr, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_frame FROM (
  SELECT *, greatest(max(least(floor(time * 2), 120)) OVER (PARTITION BY conv_id ORDER BY time, rr, turn ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS end_frame
  FROM (SELECT *, CASE WHEN role = 'assistant' THEN 1 ELSE 2 END AS rr FROM turns))"""


def _continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.frames_continuous(D.turns(spark, sf_dir), ["conv_id"], 2.0, F.lit(120).cast("long"))


@query("O122 O124 O256 O282", f"SELECT conv_id, turn, start_frame, end_frame FROM ({_CONTINUOUS})", _T)
def frames_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _continuous(spark, sf_dir).select("conv_id", "turn", "start_frame", "end_frame")


@query("O123", """
SELECT conv_id, turn, least(greatest(e - 3, 0), 119, least(e, 119))::BIGINT AS start_frame, least(e, 119)::BIGINT AS end_frame FROM (SELECT *, floor(time * 2)::BIGINT AS e FROM turns)""", _T)  # fmt: skip
def frames_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.frames_windowed(D.turns(spark, sf_dir), 2.0, 4, F.lit(120).cast("long")).select("conv_id", "turn", "start_frame", "end_frame")


@query("O121", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, floor(time / 8)::BIGINT AS x FROM turns),
e AS (SELECT *, greatest(max(x - r) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 0) + r AS end_frame FROM r)
SELECT conv_id, turn, coalesce(lag(end_frame) OVER (PARTITION BY conv_id ORDER BY turn), 0)::BIGINT AS start_frame, end_frame::BIGINT AS end_frame FROM e WHERE end_frame <= 12""", _T)  # fmt: skip
def frames_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.frames_alternating(D.turns(spark, sf_dir), ["conv_id"], 0.125, F.lit(12), ["turn"]).select("conv_id", "turn", F.col("start_frame").cast("long"), F.col("end_frame").cast("long"))


@query("O35 O46", f"SELECT conv_id, turn, start_frame, least(end_frame, 60) AS end_frame FROM ({_CONTINUOUS}) WHERE start_frame < 60", _T)
def clip_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.clip_to(_continuous(spark, sf_dir), F.lit(60).cast("long")).select("conv_id", "turn", "start_frame", "end_frame")


@query("O126", """
SELECT conv_id, turn, trunc((time - 0.75) * 2)::BIGINT AS s, greatest(trunc((time + 0.75) * 2)::BIGINT, trunc((time - 0.75) * 2)::BIGINT + 1) AS e FROM turns""", _T)  # fmt: skip
def timestamp_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e = R.timestamp_window(F.col("time"), 0.75, 2.0)
    return D.turns(spark, sf_dir).select("conv_id", "turn", s.alias("s"), e.alias("e"))


@query("O125 O93 O136", f"""SELECT conv_id, sum(end_frame - start_frame)::BIGINT AS total, round(avg(end_frame - start_frame), 6) AS mean, min(end_frame - start_frame) AS least, max(end_frame - start_frame) AS most,
  round(coalesce(sum(end_frame - start_frame) / nullif(max(end_frame) - min(start_frame), 0), 0), 6) AS coverage FROM ({_CONTINUOUS}) GROUP BY conv_id""", _T)  # fmt: skip
def frame_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.frame_statistics(_continuous(spark, sf_dir), ["conv_id"])
    return found.withColumns({"mean": F.round("mean", 6), "coverage": F.round("coverage", 6)})


@query("O159 O160", f"""
SELECT conv_id, start_frame AS frame, max((role = 'assistant')::INT) AS speaking, max((role = 'user')::INT) AS asked,
  coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'assistant'), '') AS response, count(*) AS n_turns FROM ({_CONTINUOUS}) GROUP BY conv_id, start_frame""", _T)  # fmt: skip
def sparse_event_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.event_grid(_continuous(spark, sf_dir), ["conv_id"], "turn")


@query("O161 O31 O299", f"""
WITH c AS ({_CONTINUOUS}), b AS (SELECT conv_id, min(start_frame) AS a, max(end_frame) AS z FROM c GROUP BY conv_id),
g AS (SELECT conv_id, unnest(range(a, z)) AS frame FROM b), e AS (SELECT DISTINCT conv_id, start_frame AS frame FROM c WHERE role = 'assistant')
SELECT g.conv_id, g.frame, CASE WHEN e.frame IS NULL THEN 0 ELSE 1 END AS label FROM g LEFT JOIN e ON g.conv_id = e.conv_id AND g.frame = e.frame""", _T)  # fmt: skip
def frame_grid_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _continuous(spark, sf_dir)
    events = turns.filter("role = 'assistant'").select("conv_id", F.col("start_frame").alias("frame"), F.lit(1).alias("label")).distinct()
    bounds = R.clip_range(turns, ["conv_id"]).filter("clip_end > clip_start")
    return R.frame_labels(bounds, events, ["conv_id"], "label")


@query("O85 O116", f"SELECT conv_id, count(*) AS talk, sum(end_frame - start_frame - 1)::BIGINT AS no_talk FROM ({_CONTINUOUS}) WHERE end_frame > start_frame GROUP BY conv_id", _T)
def talk_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.talk_ratio(_continuous(spark, sf_dir), ["conv_id"])


@query("O86", """
SELECT conv_id, round(avg(gap), 6) AS mean_interval, count(*) AS n FROM (SELECT conv_id, time - coalesce(lag(time) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS gap FROM turns WHERE role = 'assistant') GROUP BY conv_id""", _T)  # fmt: skip
def reply_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reply_interval(D.turns(spark, sf_dir), ["conv_id"], ["turn"]).withColumn("mean_interval", F.round("mean_interval", 6))


_MOVES = """moves AS (SELECT *, CASE transition WHEN 'start' THEN 'in_progress' ELSE 'completed' END AS state FROM steps WHERE transition <> 'reset')"""


@query("O129 O204", f"""
WITH {_MOVES}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY time, event_id) AS rn FROM steps),
m AS (SELECT r.user_id, r.step_id, r.rn, moves.state, lead(r.rn) OVER (PARTITION BY r.user_id, r.step_id ORDER BY r.rn) AS until FROM r JOIN moves ON moves.event_id = r.event_id)
SELECT r.user_id, r.time, r.event_id, r.step_id, r.transition, coalesce(string_agg(m.step_id || ':' || m.state, ',' ORDER BY m.step_id), '') AS state
FROM r LEFT JOIN m ON m.user_id = r.user_id AND m.rn <= r.rn AND (m.until IS NULL OR r.rn < m.until) GROUP BY r.user_id, r.time, r.event_id, r.step_id, r.transition""", _E)  # fmt: skip
def state_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.state_history(D.steps(spark, sf_dir), ["user_id"], ["time", "event_id"])


@query("O68 O64 O242", f"""
WITH {_MOVES}, p AS (SELECT user_id, event_id AS probe_id, time AS probe_time FROM timed WHERE event_type = 'click')
SELECT p.*, m.step_id, max_by(m.state, (m.time, m.event_id)) AS state FROM p JOIN moves m ON m.user_id = p.user_id AND m.time <= p.probe_time GROUP BY ALL""", _E)  # fmt: skip
def asof_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = D.timed(spark, sf_dir).filter("event_type = 'click'").select("user_id", F.col("event_id").alias("probe_id"), F.col("time").alias("probe_time"))
    return S.state_as_of(probes, D.steps(spark, sf_dir), ["user_id"], "probe_time", ["time", "event_id"])


@query("O69", """
SELECT user_id, event_id, step_id, coalesce(lag(state) OVER (PARTITION BY user_id, step_id ORDER BY time, event_id), 'not_started') AS before
FROM (SELECT *, CASE transition WHEN 'start' THEN 'in_progress' WHEN 'complete' THEN 'completed' ELSE 'not_started' END AS state FROM steps)""", _E)  # fmt: skip
def state_before_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id", "step_id").orderBy("time", "event_id")
    state = S.state_after(F.col("transition"), S.EXTENDED_RESULT)
    return D.steps(spark, sf_dir).select("user_id", "event_id", "step_id", F.coalesce(F.lag(state).over(w), F.lit("not_started")).alias("before"))


@query("O130", f"""
WITH {_MOVES} SELECT user_id, event_id, step_id, transition, before, before = CASE transition WHEN 'start' THEN 'not_started' ELSE 'in_progress' END AS valid
FROM (SELECT *, coalesce(lag(state) OVER (PARTITION BY user_id, step_id ORDER BY time, event_id), 'not_started') AS before FROM moves)""", _E)  # fmt: skip
def transition_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.transition_validity(D.steps(spark, sf_dir), ["user_id"], ["time", "event_id"]).select("user_id", "event_id", "step_id", "transition", "before", "valid")


@query("O131 O132", """
SELECT user_id, step_id, coalesce(max_by(state, rn) FILTER (rn < n // 2 AND state IS NOT NULL), 'not_started') AS state FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY time, event_id) - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS n,
  CASE transition WHEN 'start' THEN 'in_progress' WHEN 'complete' THEN 'completed' END AS state FROM steps) GROUP BY user_id, step_id""", _E)  # fmt: skip
def state_at_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.state_at_rank(D.steps(spark, sf_dir), ["user_id"], ["time", "event_id"], F.floor(F.col("_n") / 2))


@query("O117 O174 O288", """
WITH l AS (SELECT user_id, step_id, count(*) AS n, max_by(state, (time, event_id)) FILTER (state IS NOT NULL) AS s FROM (
  SELECT *, CASE transition WHEN 'start' THEN 'in_progress' WHEN 'complete' THEN 'completed' END AS state FROM steps) GROUP BY user_id, step_id)
SELECT user_id, sum(n)::BIGINT AS transitions, count(*) AS steps, coalesce(string_agg(step_id || ':' || s, ',' ORDER BY step_id) FILTER (s IS NOT NULL), '') AS final_state FROM l GROUP BY user_id""", _E)  # fmt: skip
def state_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.state_summary(D.steps(spark, sf_dir), ["user_id"], ["time", "event_id"])


@query("O127 O128", """
WITH e AS (SELECT DISTINCT user_id, step_id, 'start' AS transition, start_ts AS time FROM spans UNION SELECT user_id, step_id, 'complete', end_ts FROM spans WHERE end_ts > start_ts)
SELECT e.* FROM e WHERE NOT EXISTS (SELECT 1 FROM steps s WHERE s.transition = 'start' AND s.user_id = e.user_id AND s.step_id = e.step_id AND s.transition = e.transition AND s.time = e.time)""", ("timed", "steps", "spans"))  # fmt: skip
def spans_to_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.spans_to_events(D.spans(spark, sf_dir), ["user_id"], D.steps(spark, sf_dir).filter("transition = 'start'"))


@query("O266 O145", """
SELECT user_id, event_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY time, event_id ROWS UNBOUNDED PRECEDING) AS step_event FROM timed""", ("timed",))  # fmt: skip
def event_step_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = D.timed(spark, sf_dir).withColumn("m", F.when(F.col("event_type") == "view", F.col("event_id")))
    return S.last_value_forward(marked, ["user_id"], ["time", "event_id"], "m", "step_event").select("user_id", "event_id", "step_event")
