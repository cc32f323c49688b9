"""Queries that run as streams; their SQL is that of the batch equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import text as T
from tidewright.plans import derived as D
from tidewright.plans.registry import SQL, query
from tidewright.session import table
from tidewright.streaming import processors as X
from tidewright.streaming import stateful as S
from tidewright.streaming.runs import run_to_table, stream_in_parts, stream_of


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_of(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _stream_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    change = F.when(kind == "view", "start").when(kind == "purchase", "complete").when(kind == "error", "reset")
    return _events(spark, sf_dir).filter(kind.isin("view", "purchase", "error")).select("event_id", "user_id", F.concat(F.lit("S"), (F.col("event_id") % 8).cast("string")).alias("step_id"), change.alias("transition"))


@query("O242 O129", "WITH h AS (" + SQL["state_history"].strip() + ") SELECT user_id, event_id, step_id, transition, state FROM h")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_to_table(S.replay_states(_stream_steps(spark, sf_dir), "user_id", ["event_id"]))


@query("O142", "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type")
def stream_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_to_table(S.changes(_events(spark, sf_dir).select("user_id", "event_id", "event_type"), "user_id", ["event_id"], "event_type"))


@query("O92", "SELECT date_trunc('day', ts) AS begins, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = S.window_counts(_events(spark, sf_dir), "ts", "1 day", by=("event_type",))
    return run_to_table(counted, "complete").select(F.col("begins").cast("timestamp_ntz").alias("begins"), "event_type", "n", F.round("total", 4).alias("total"))


@query("O106", """
SELECT user_id, min(ts) AS begins, max(ts) + INTERVAL 2 HOURS AS ends, count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
  FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS c FROM events)) GROUP BY user_id, s""")  # fmt: skip
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run_to_table(S.session_counts(_events(spark, sf_dir), "ts", "2 hours", "user_id"), "complete")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("begins", "ends")})


_GATED = """
x AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, (event_id * 37 % 100) / 100.0::DOUBLE > 0.6 AS updating, (event_id * 61 % 100) / 100.0::DOUBLE > 0.5 AS speaking,
  CASE event_type WHEN 'view' THEN 'S' || event_id % 8 || '->start' WHEN 'purchase' THEN 'S' || event_id % 8 || '->complete' WHEN 'error' THEN 'no no no no' ELSE 'S1->pause' END AS moved,
  CASE event_type WHEN 'click' THEN 'so so so so so so' ELSE 'now ' || event_type END AS said FROM events),
t AS (SELECT user_id, n, split_part(moved, '->', 1) AS step, CASE WHEN moved LIKE '%->start' THEN 'in_progress' ELSE 'completed' END AS state FROM x WHERE updating AND (moved LIKE '%->start' OR moved LIKE '%->complete')),
l AS (SELECT x.user_id, x.n, t.step, arg_max(t.state, t.n) AS state, min(t.n) AS since FROM x JOIN t ON x.user_id = t.user_id AND t.n <= x.n GROUP BY ALL),
h AS (SELECT user_id, n, string_agg(step || ':' || state, ',' ORDER BY step) AS states, count(*) FILTER (since < n) AS before FROM l GROUP BY ALL),
y AS (SELECT x.*, coalesce(h.states, '') AS states, coalesce(h.before, 0) AS before,
  1 + CASE WHEN updating THEN len(string_split(moved, ' ')) ELSE 0 END + CASE WHEN speaking THEN len(string_split(said, ' ')) ELSE 0 END AS cost FROM x LEFT JOIN h ON x.user_id = h.user_id AND x.n = h.n),
r AS (SELECT user_id, n, 20 + 2 * before + cost AS tokens FROM y WHERE n = 1 UNION ALL
  SELECT y.user_id, y.n, CASE WHEN r.tokens >= 60 THEN 20 + 2 * y.before ELSE r.tokens END + y.cost FROM r JOIN y ON y.user_id = r.user_id AND y.n = r.n + 1)
"""


@query("O241 O242 O245", "WITH RECURSIVE " + _GATED.strip() + """
SELECT y.user_id, y.event_id, CASE WHEN speaking AND said NOT LIKE 'so so%' THEN said ELSE '' END AS said, CASE WHEN updating THEN CASE WHEN moved LIKE 'no no%' THEN '' ELSE moved END END AS moved,
  states, speaking::INT AS speaking, updating::INT AS updating, r.tokens::BIGINT AS tokens, r.tokens >= 60 AS rebuilt FROM y JOIN r ON y.user_id = r.user_id AND y.n = r.n""")  # fmt: skip
def stream_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, k = F.col("event_type"), F.col("event_id")
    step = F.concat(F.lit("S"), (k % 8).cast("string"))
    moved = F.when(kind == "view", F.concat(step, F.lit("->start"))).when(kind == "purchase", F.concat(step, F.lit("->complete"))).when(kind == "error", "no no no no").otherwise("S1->pause")
    said = F.when(kind == "click", "so so so so so so").otherwise(F.concat(F.lit("now "), kind))
    share = lambda c: (c % 100) / F.lit(100.0)
    frames = table(spark, sf_dir, "events").select("user_id", "event_id", share(k * 61).alias("speak_prob"), said.alias("speak_text"), share(k * 37).alias("update_prob"), moved.alias("update_text"))
    return run_to_table(X.gated_frames(stream_in_parts(frames, "user_id", "event_id"), "user_id", "event_id", most=70, reserve=10))


@query("O243", """
SELECT user_id, event_id, before, kind FROM (SELECT *, lag(kind) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM
  (SELECT user_id, event_id, nullif(event_type, 'error') AS kind FROM events)) WHERE before <> kind""")
def stream_change_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.nullif("event_type", F.lit("error")).alias("kind"))
    return run_to_table(X.changes_within(stream_in_parts(rows, "user_id", "event_id", 4), "user_id", "event_id", "kind"))


@query("O244", """
SELECT user_id, event_id, coalesce(before - p > 0.3, false) OR p <= 0.5 AS speaks FROM (SELECT *, lag(p) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM
  (SELECT user_id, event_id, (event_id * 61 % 100) / 100.0::DOUBLE AS p FROM events))""")
def stream_talk_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", ((F.col("event_id") * 61 % 100) / F.lit(100.0)).alias("p"))
    return run_to_table(X.talk_gate(stream_in_parts(rows, "user_id", "event_id"), "user_id", "event_id", "p", "diff0.3"))


@query("O239 O240", """
WITH RECURSIVE x AS (SELECT conv_id, turn, length(text) // 4 AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
w AS (SELECT conv_id, turn, rn, [cost] AS held, 0::BIGINT AS dropped FROM x WHERE rn = 1 UNION ALL
  SELECT x.conv_id, x.turn, x.rn, CASE WHEN t.full_ THEN list_concat(t.f[1:1], t.f[-2:]) ELSE t.f END, CASE WHEN t.full_ THEN list_sum(t.f) - list_sum(list_concat(t.f[1:1], t.f[-2:])) ELSE 0 END::BIGINT
  FROM w JOIN x ON x.conv_id = w.conv_id AND x.rn = w.rn + 1, LATERAL (SELECT list_append(w.held, x.cost) AS f, list_sum(list_append(w.held, x.cost)) >= 300 AND len(w.held) + 1 > 3 AS full_) t)
SELECT conv_id, turn, list_sum(held)::BIGINT AS size, dropped FROM w""")  # fmt: skip
def stream_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stream_of(spark, sf_dir, "conversations").select("conv_id", "turn", T.approximate_tokens(F.col("text")).alias("cost"))
    return run_to_table(S.context_sizes(turns, "conv_id", "turn", "cost", "drop_middle", 300))


@query("O244", """
SELECT user_id, event_id, value > 50 AND (before IS NULL OR value - before > 10) AS speaks FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)""")
def talk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    e = table(spark, sf_dir, "events").withColumn("b", before)
    return e.select("user_id", "event_id", ((F.col("value") > 50) & (F.col("b").isNull() | (F.col("value") - F.col("b") > 10))).alias("speaks"))


@query("O237", """
WITH x AS (SELECT user_id, event_id AS n, epoch_ms(ts) AS ms, event_type || event_id AS text, CASE event_type WHEN 'view' THEN 'frame' WHEN 'purchase' THEN 'frame' WHEN 'error' THEN 'reply' ELSE 'user' END AS kind FROM events),
g AS (SELECT *, row_number() OVER w AS rn, count(*) FILTER (kind = 'frame') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS slot FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ms, kind = 'frame', n)),
p AS (SELECT user_id, slot, string_agg(text, chr(10) ORDER BY rn) AS prompt FROM g WHERE kind = 'user' GROUP BY ALL),
f AS (SELECT *, lead(kind) OVER w AS next_kind, lead(ms) OVER w AS next_ms, lead(text) OVER w AS next_text FROM g WHERE kind <> 'user' WINDOW w AS (PARTITION BY user_id ORDER BY rn))
SELECT f.user_id, f.n, coalesce(prompt, '') AS prompt, CASE WHEN next_kind = 'reply' AND next_ms <= f.ms + 86400000 THEN next_text ELSE '' END AS ref FROM f LEFT JOIN p ON p.user_id = f.user_id AND p.slot = f.slot WHERE kind = 'frame'""")  # fmt: skip
def stream_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("time"), F.col("event_id").alias("n"), "event_type")
    is_frame = F.col("event_type").isin("view", "purchase")

    def part(rows: DataFrame, parts: int) -> DataFrame:
        """A stream of *rows*, ended by a row of key -1 without kind or n, two days after them: it moves the watermark past all."""
        tick = rows.agg(F.lit(-1).cast("long").alias("user_id"), (F.max("time") + F.expr("INTERVAL 2 DAYS")).alias("time"))
        ended = rows.unionByName(tick, allowMissingColumns=True).withColumn("at", F.unix_millis("time"))
        return stream_in_parts(ended, "user_id", "at", parts).drop("at")

    said = F.when(F.col("event_type") == "error", "assistant").otherwise("user")
    messages = e.filter(~is_frame).select("user_id", "time", "n", said.alias("kind"), F.concat("event_type", F.col("n").cast("string")).alias("text"))
    return run_to_table(X.attach_messages(part(e.filter(is_frame).drop("event_type"), 3), part(messages, 2), "user_id", patience=86_400_000))


@query("O237 O67 O300", """
WITH t AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS s FROM (SELECT *, floor(time / 4)::BIGINT AS e FROM turns)),
f AS (SELECT conv_id, turn, role, text, e, unnest(range(s, e)) AS frame FROM t WHERE e > s)
SELECT conv_id, frame, (frame + 1) / 2.0::DOUBLE AS time, CASE WHEN role = 'assistant' AND frame = e - 1 THEN text ELSE '' END AS ref, turn FROM f""", ("turns",))  # fmt: skip
def frame_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.floor(F.col("time") / 4)
    t = D.turns(spark, sf_dir).withColumn("e", end).withColumn("s", F.coalesce(F.lag("e").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(0)))
    f = t.filter("e > s").withColumn("frame", F.explode(F.sequence("s", F.col("e") - 1)))
    said = F.when((F.col("role") == "assistant") & (F.col("frame") == F.col("e") - 1), F.col("text")).otherwise("")
    return f.select("conv_id", "frame", ((F.col("frame") + 1) / F.lit(2.0)).alias("time"), said.alias("ref"), "turn")
