"""Queries over interval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.operators import intervals as I
from tidewright.plans import derived as D
from tidewright.plans.registry import query

_B, _S = ("timed", "blocks"), ("timed", "steps", "spans")
_ISLANDS = """islands AS (SELECT user_id, island, min(start_ts) AS start_ts, max(end_ts) AS end_ts, count(*) AS n FROM (
  SELECT *, sum(CASE WHEN b IS NULL OR start_ts > b THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start_ts, end_ts ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, max(end_ts) OVER (PARTITION BY user_id ORDER BY start_ts, end_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM blocks WHERE end_ts IS NOT NULL))
  GROUP BY user_id, island)"""


def _solid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.blocks(spark, sf_dir).filter("end_ts IS NOT NULL")


@query("O106", f"WITH {_ISLANDS} SELECT user_id, start_ts, end_ts, n FROM islands", _B)
def gap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.interval_union(_solid(spark, sf_dir), ["user_id"])


@query("O104 O150", f"""WITH {_ISLANDS} SELECT user_id, round(sum(end_ts - start_ts), 4) AS covered, round(sum(end_ts - start_ts) / (max(end_ts) - min(start_ts)), 6) AS coverage,
  count(*) AS islands FROM islands GROUP BY user_id""", _B)  # fmt: skip
def interval_union_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.covered_length(_solid(spark, sf_dir), ["user_id"]).select("user_id", F.round("covered", 4).alias("covered"), F.round("coverage", 6).alias("coverage"), "islands")


@query("O106", f"""WITH {_ISLANDS} SELECT user_id, end_ts AS start_ts, nx AS end_ts FROM (SELECT *, lead(start_ts) OVER (PARTITION BY user_id ORDER BY start_ts) AS nx FROM islands) WHERE nx IS NOT NULL""", _B)
def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.gaps(_solid(spark, sf_dir), ["user_id"])


@query("O106", """
SELECT user_id, f + 1 AS gap_start, nx - 1 AS gap_end, nx - f - 1 AS frames FROM (
  SELECT user_id, f, lead(f) OVER (PARTITION BY user_id ORDER BY f) AS nx FROM (SELECT DISTINCT user_id, unnest(range(s, s + 3)) AS f FROM (
    SELECT user_id, floor(time / 600)::BIGINT AS s FROM timed WHERE event_type = 'click'))) WHERE nx > f + 1""", ("timed",))  # fmt: skip
def silence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.floor(F.col("time") / 600)
    turns = D.timed(spark, sf_dir).filter("event_type = 'click'").select("user_id", s.alias("start_frame"), (s + 2).alias("end_frame"))
    return I.silence_gaps(turns, ["user_id"], F.min("start_frame"), F.max("end_frame"))


@query("O146", """
SELECT user_id, event_id, CASE WHEN pe > start_ts THEN (pe + start_ts) / 2 ELSE start_ts END AS start_ts, CASE WHEN end_ts > ns THEN (end_ts + ns) / 2 ELSE end_ts END AS end_ts
FROM (SELECT *, lag(end_ts) OVER w AS pe, lead(start_ts) OVER w AS ns FROM blocks WHERE end_ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY start_ts, event_id))""", _B)  # fmt: skip
def midpoint_overlap_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.fix_overlaps(_solid(spark, sf_dir), ["user_id"], ["start_ts", "event_id"]).select("user_id", "event_id", "start_ts", "end_ts")


_VIOLATIONS = """SELECT user_id, event_id AS span_id, nid AS next_id, CASE WHEN end_ts - ns > 0 THEN 'overlap' ELSE 'gap' END AS kind,
  CASE WHEN end_ts - ns > 0 THEN 'error' ELSE 'warning' END AS severity, round(abs(end_ts - ns), 6) AS amount
FROM (SELECT *, lead(start_ts) OVER w AS ns, lead(event_id) OVER w AS nid FROM blocks WHERE end_ts >= start_ts WINDOW w AS (PARTITION BY user_id ORDER BY start_ts, event_id))
WHERE nid IS NOT NULL AND (end_ts - ns > 0 OR ns - end_ts > 300)"""


@query("O155", _VIOLATIONS, _B)
def temporal_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.temporal_violations(_solid(spark, sf_dir), ["user_id"], "event_id").withColumn("amount", F.round("amount", 6))


@query("O97", f"SELECT kind || '_' || severity AS kind_severity, count(*) AS n FROM ({_VIOLATIONS}) GROUP BY ALL", _B)
def violation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.temporal_violations(_solid(spark, sf_dir), ["user_id"], "event_id")
    return found.groupBy(F.concat_ws("_", "kind", "severity").alias("kind_severity")).agg(F.count(F.lit(1)).alias("n"))


@query("O156 O235", """
SELECT user_id, event_id, start_ts, start_ts + least(greatest(end_ts - start_ts, 1.0), 300.0) AS end_ts, row_number() OVER (PARTITION BY user_id ORDER BY start_ts, event_id)::INT AS number
FROM blocks WHERE end_ts IS NOT NULL""", _B)  # fmt: skip
def clamp_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.clamp_durations(_solid(spark, sf_dir), ["user_id"], "event_id").select("user_id", "event_id", "start_ts", "end_ts", "number")


@query("O98 O100", """
SELECT user_id, text, min(start_ts) AS start_ts, max(end_ts) AS end_ts, count(*) AS n_blocks FROM blocks WHERE start_ts < end_ts GROUP BY user_id, text""", _B)  # fmt: skip
def span_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.span_envelopes(_solid(spark, sf_dir), ["user_id", "text"])


@query("O99", """
SELECT user_id, text, min(start_ts) AS start_ts, max_by(end_ts, (start_ts, event_id)) AS end_ts FROM blocks WHERE end_ts IS NOT NULL GROUP BY user_id, text""", _B)  # fmt: skip
def span_envelope_latest_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.span_envelopes_latest_start(_solid(spark, sf_dir), ["user_id", "text"], "event_id")


@query("O101", """
SELECT user_id, count(*) AS n, round(avg(end_ts - start_ts), 4) AS mean_duration, round(min(end_ts - start_ts), 4) AS min_duration, round(max(end_ts - start_ts), 4) AS max_duration,
  min(start_ts) AS first_start, max(end_ts) AS last_end FROM spans GROUP BY user_id""", _S)  # fmt: skip
def span_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.span_statistics(D.spans(spark, sf_dir), ["user_id"])
    return found.withColumns({c: F.round(c, 4) for c in ("mean_duration", "min_duration", "max_duration")})


@query("O77", """
SELECT a.user_id, a.span_id, b.span_id AS other_span_id, round(greatest(least(a.end_ts, b.end_ts) - greatest(a.start_ts, b.start_ts), 0) /
  (greatest(a.end_ts, b.end_ts) - least(a.start_ts, b.start_ts)), 6) AS iou
FROM spans a JOIN spans b ON a.user_id = b.user_id AND a.step_id < b.step_id AND a.start_ts <= b.end_ts AND b.start_ts <= a.end_ts""", _S)  # fmt: skip
def temporal_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = D.spans(spark, sf_dir)
    found = I.temporal_iou(spans, spans, ["user_id"]).filter("step_id < other_step_id")
    return found.select("user_id", "span_id", "other_span_id", F.round("iou", 6).alias("iou"))


@query("O76", """
WITH RECURSIVE x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM blocks),
w AS (SELECT user_id, event_id, rn, NULL::BIGINT AS outer_id, [{'i': event_id, 's': start_ts, 'e': end_ts}] AS kept FROM x WHERE rn = 1 UNION ALL
  SELECT x.user_id, x.event_id, x.rn, t.o, CASE WHEN t.o IS NULL THEN list_append(w.kept, {'i': x.event_id, 's': x.start_ts, 'e': x.end_ts}) ELSE w.kept END
  FROM w JOIN x ON x.user_id = w.user_id AND x.rn = w.rn + 1, LATERAL (SELECT list_filter(w.kept, lambda k: k.e IS NOT NULL AND k.s <= x.start_ts AND coalesce(x.end_ts, x.start_ts) <= k.e)[1].i AS o) t)
SELECT b.user_id, b.event_id, b.start_ts, b.end_ts, (SELECT count(*) FROM w a WHERE a.user_id = b.user_id AND a.outer_id = b.event_id) AS absorbed FROM blocks b JOIN w ON w.user_id = b.user_id AND w.event_id = b.event_id AND w.outer_id IS NULL""", ("timed", "blocks"))  # fmt: skip
def absorb_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.absorb_contained(D.blocks(spark, sf_dir), "user_id", "event_id")


@query("O147", """
WITH RECURSIVE x AS (SELECT user_id, event_id, text, start_ts, end_ts, row_number() OVER (PARTITION BY user_id ORDER BY start_ts, event_id) AS rn, list_distinct(string_split(lower(text), ' ')) AS w FROM blocks WHERE end_ts IS NOT NULL),
r AS (SELECT user_id, rn, event_id AS head, text AS head_text, start_ts AS head_start, w AS head_w, end_ts, 1 AS merged FROM x WHERE rn = 1 UNION ALL
  SELECT x.user_id, x.rn, CASE WHEN t.joins THEN r.head ELSE x.event_id END, CASE WHEN t.joins THEN r.head_text ELSE x.text END, CASE WHEN t.joins THEN r.head_start ELSE x.start_ts END, CASE WHEN t.joins THEN r.head_w ELSE x.w END, x.end_ts, CASE WHEN t.joins THEN r.merged + 1 ELSE 1 END
  FROM r JOIN x ON x.user_id = r.user_id AND x.rn = r.rn + 1, LATERAL (SELECT x.start_ts - r.end_ts < 2 AND len(list_intersect(r.head_w, x.w)) / len(list_distinct(list_concat(r.head_w, x.w))) > 0.6 AS joins) t)
SELECT user_id, head AS event_id, any_value(head_text) AS text, any_value(head_start) AS start_ts, arg_max(end_ts, merged) AS end_ts, max(merged) AS merged FROM r GROUP BY user_id, head""", ("timed", "blocks"))  # fmt: skip
def merge_micro_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.merge_micro_gaps(_solid(spark, sf_dir), "user_id", "event_id")


@query("O157", """
WITH o AS (SELECT *, end_ts - start_ts AS len, row_number() OVER (PARTITION BY user_id ORDER BY start_ts, event_id) AS rn FROM blocks WHERE end_ts IS NOT NULL),
c AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o),
m AS (SELECT *, max(start_ts - before) OVER (PARTITION BY user_id ORDER BY rn ROWS UNBOUNDED PRECEDING) + before AS s FROM c)
SELECT user_id, event_id, round(s, 3) AS start_ts, round(s + len, 3) AS end_ts FROM m""", _B)  # fmt: skip
def push_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    pushed = I.push_overlaps(_solid(spark, sf_dir), ["user_id"], "event_id")
    return pushed.select("user_id", "event_id", F.round("start_ts", 3).alias("start_ts"), F.round("end_ts", 3).alias("end_ts"))


@query("O149 O141", """
SELECT user_id, event_type, min(time) AS start_ts, max(time) AS end_ts, count(*) AS n, run::BIGINT AS run FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY time, event_id ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY time, event_id) = event_type THEN 0 ELSE 1 END AS c FROM timed)) GROUP BY user_id, run, event_type""", ("timed",))  # fmt: skip
def adjacent_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.timed(spark, sf_dir).withColumns({"start_ts": F.col("time"), "end_ts": F.col("time")})
    return I.run_merge(t, ["user_id"], ["time", "event_id"], "event_type")


@query("O142 O243", """
SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY time, event_id) AS before FROM timed) WHERE before IS DISTINCT FROM event_type""", ("timed",))  # fmt: skip
def consecutive_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("time", "event_id"))
    return D.timed(spark, sf_dir).withColumn("b", before).filter(~F.col("b").eqNullSafe(F.col("event_type"))).select("user_id", "event_id", "event_type")
