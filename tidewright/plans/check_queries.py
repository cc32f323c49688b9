"""Queries over packing and validators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import frames as R
from tidewright.operators import metrics as X
from tidewright.operators import packing as P
from tidewright.operators import validators as V
from tidewright.plans import derived as D
from tidewright.plans.registry import query
from tidewright.session import table


def _costed(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = R.frames_continuous(D.turns(spark, sf_dir), ["conv_id"], 2.0)
    return turns.withColumn("cost", P.turn_cost(F.col("end_frame") - F.col("start_frame"), F.col("text"), 1).cast("long"))


@query("O284 O105 O203", """
SELECT conv_id, turn, (end_frame - coalesce(lag(end_frame) OVER (PARTITION BY conv_id ORDER BY turn), 0) + greatest(length(text) // 4, 1) + 10)::BIGINT AS cost
FROM (SELECT *, floor(time * 2)::BIGINT AS end_frame FROM turns)""", ("turns",))  # fmt: skip
def turn_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _costed(spark, sf_dir).select("conv_id", "turn", "cost")


_COSTED = """f AS (SELECT *, coalesce(max(e) OVER (PARTITION BY conv_id ORDER BY time, rr, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (
  SELECT *, greatest(max(floor(time * 2)) OVER (PARTITION BY conv_id ORDER BY time, rr, turn ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS e FROM (SELECT *, CASE WHEN role = 'assistant' THEN 1 ELSE 2 END AS rr FROM turns))),
c AS (SELECT conv_id, turn, role, time, (e - s + greatest(length(text) // 4, 1) + 10)::BIGINT AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM f)"""
# one row a step of the loop: b is where the open part begins, i the row looked at, u what is used; a cut part is lo to hi
_SPLIT = f"""{_COSTED}, l AS (SELECT conv_id, list(cost ORDER BY rn) AS p, list(role ORDER BY rn) AS ro, count(*) AS n FROM c GROUP BY conv_id),
w AS (SELECT conv_id, p, ro, n, 1::BIGINT AS b, 1::BIGINT AS i, 0::BIGINT AS u, NULL::BIGINT AS lo, NULL::BIGINT AS hi FROM l UNION ALL
  SELECT conv_id, p, ro, n, CASE WHEN NOT cut THEN b WHEN reply IS NOT NULL THEN reply + 1 ELSE least(i, coalesce(drop_to, i)) END,
    CASE WHEN cut AND reply IS NOT NULL THEN reply + 1 ELSE i + 1 END,
    CASE WHEN NOT cut THEN v WHEN reply IS NOT NULL THEN 0 ELSE v - coalesce(list_sum(p[b : least(i, coalesce(drop_to, i)) - 1]), 0) END::BIGINT,
    CASE WHEN cut AND reply IS NOT NULL THEN b END, CASE WHEN cut THEN reply END
  FROM (SELECT *, u + p[i] AS v, u + p[i] > 600 AND i > b AS cut, list_max(list_filter(range(b, i), lambda x: ro[x] = 'assistant')) AS reply,
    list_min(list_filter(range(b, i + 1), lambda x: u + p[i] - coalesce(list_sum(p[b : x - 1]), 0) <= 600)) AS drop_to FROM w WHERE i <= n)),
parts AS (SELECT conv_id, lo, hi FROM w WHERE hi IS NOT NULL UNION ALL SELECT conv_id, b, n FROM (SELECT *, list_contains(ro[b : n], 'assistant') AS said FROM w WHERE i > n) WHERE said),
split AS (SELECT c.conv_id, c.turn, c.role, c.time, (dense_rank() OVER (PARTITION BY c.conv_id ORDER BY lo) - 1)::INT AS segment FROM c JOIN parts ON c.conv_id = parts.conv_id AND c.rn BETWEEN lo AND hi)"""


@query("O133", f"WITH RECURSIVE {_SPLIT} SELECT conv_id, turn, segment FROM split", ("turns",))
def budget_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.split_by_budget(_costed(spark, sf_dir), "conv_id", "turn", "cost", 600)


@query("O134 O135 O283", f"""
WITH RECURSIVE {_COSTED}, x AS (SELECT c.*, (SELECT coalesce(sum(o.cost), 0) FROM c o WHERE o.conv_id = c.conv_id AND o.rn < c.rn AND o.time >= c.time - 60)::BIGINT AS before FROM c),
w AS (SELECT conv_id, turn, rn, time, 0 AS segment, cost AS u, 1 AS held, FALSE AS cut FROM x WHERE rn = 1 UNION ALL
  SELECT x.conv_id, x.turn, x.rn, x.time, w.segment + t.cut::INT, CASE WHEN t.cut THEN x.before ELSE w.u END + x.cost, CASE WHEN t.cut THEN 1 ELSE w.held + 1 END, t.cut
  FROM w JOIN x ON x.conv_id = w.conv_id AND x.rn = w.rn + 1, LATERAL (SELECT w.held >= 2 AND w.u + x.cost > 540 AS cut) t)
SELECT conv_id, turn, segment::INT AS segment, FALSE AS is_context FROM w UNION ALL
SELECT w.conv_id, c.turn, w.segment::INT, TRUE FROM w JOIN c ON w.cut AND c.conv_id = w.conv_id AND c.rn < w.rn AND c.time >= w.time - 60""", ("turns",))  # fmt: skip
def budget_split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.split_with_overlap(_costed(spark, sf_dir), "conv_id", "turn", "cost", 600, context=60.0)


@query("O285 O231 O136", f"""
WITH RECURSIVE {_SPLIT} SELECT conv_id, segment, count(*) AS turns, count(*) FILTER (role = 'assistant') AS replies, min(time) AS begins, max(time) AS ends FROM split GROUP BY conv_id, segment""", ("turns",))  # fmt: skip
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    costed = _costed(spark, sf_dir)
    return P.segment_summary(P.split_by_budget(costed, "conv_id", "turn", "cost", 600).join(costed, ["conv_id", "turn"]), ["conv_id"])


@query("O137", """
WITH RECURSIVE x AS (SELECT l_orderkey, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS line FROM lineitem),
w AS (SELECT l_orderkey, line, 0 AS bin, q AS u FROM x WHERE line = 1 UNION ALL
  SELECT x.l_orderkey, x.line, w.bin + CASE WHEN w.u <> 0 AND w.u + x.q >= 80 THEN 1 ELSE 0 END, x.q + CASE WHEN w.u <> 0 AND w.u + x.q >= 80 THEN 0 ELSE w.u END FROM w JOIN x ON x.l_orderkey = w.l_orderkey AND x.line = w.line + 1)
SELECT l_orderkey, line, bin::INT AS bin FROM w""")  # fmt: skip
def caption_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pack(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "l_quantity", 80, place="line")


@query("O140")
def adjust_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = D.turns(spark, sf_dir).withColumn("time", F.floor(F.col("time") / 20) * 20.0)
    return P.adjust_times(turns, "conv_id", "turn")


@query("O143", """
WITH RECURSIVE x AS (SELECT conv_id, turn, len(string_split(text, chr(10))) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
w AS (SELECT conv_id, turn, rn, 0 AS chunk, n AS u FROM x WHERE rn = 1 UNION ALL
  SELECT x.conv_id, x.turn, x.rn, w.chunk + (w.u > 5)::INT, x.n + CASE WHEN w.u > 5 THEN 0 ELSE w.u END FROM w JOIN x ON x.conv_id = w.conv_id AND x.rn = w.rn + 1)
SELECT conv_id, turn, chunk::INT AS chunk FROM w""")  # fmt: skip
def chunk_by_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("lines", F.size(F.split("text", "\n")))
    return P.chunk_by_weight(turns, "conv_id", "turn", "lines", 5)


_ERR = """CASE WHEN e > 40 THEN 'end past the last frame' WHEN s >= e THEN 'empty clip' END"""


@query("O36 O79 O257", f"""
SELECT o_orderkey, {_ERR} IS NULL AS valid, coalesce({_ERR}, '') AS message FROM (SELECT o_orderkey, o_orderkey % 45 AS s, o_orderkey % 45 + o_custkey % 6 AS e FROM orders)""")  # fmt: skip
def clip_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderkey") % 45
    r = V.as_result(V.clip_error(s, s + F.col("o_custkey") % 6, F.lit(40)))
    return table(spark, sf_dir, "orders").select("o_orderkey", r.alias("r")).select("o_orderkey", "r.valid", "r.message")


@query("O229 O230 O276", """
SELECT conv_id, turn, CASE WHEN turn % 7 = 3 THEN 'missing content' WHEN role || CASE WHEN turn % 5 = 4 THEN 'x' ELSE '' END NOT IN ('system', 'user', 'assistant', 'DST_UPDATE')
  THEN 'invalid role ' || role || CASE WHEN turn % 5 = 4 THEN 'x' ELSE '' END END AS error FROM conversations""")  # fmt: skip
def turn_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.concat("role", F.when(F.col("turn") % 5 == 4, "x").otherwise(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", V.turn_error(role, F.when(F.col("turn") % 7 != 3, F.col("text"))).alias("error"))


_SAMPLES = """SELECT conv_id, CASE WHEN sum(length(text)) // 4 > 400 THEN 'length ' || (sum(length(text)) // 4)::BIGINT || ' exceeds 400' WHEN min_by(role, turn) <> 'system' THEN 'no system prompt' END AS error FROM conversations GROUP BY conv_id"""


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.floor(F.sum(F.char_length("text")) / 4).alias("len"), F.min_by("role", "turn").alias("first"), F.count(F.lit(1)).alias("n"))
    return c.select("conv_id", V.sample_error(F.col("len"), F.lit(400), F.lit(2.0), F.col("first"), F.col("n")).alias("error"))


@query("O229", _SAMPLES)
def sample_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir)


@query("O96", f"""
WITH s AS ({_SAMPLES}) SELECT count(*) FILTER (error IS NULL) AS valid, count(*) FILTER (error IS NOT NULL) AS invalid, round(count(*) FILTER (error IS NULL) / count(*), 6) AS rate,
  (SELECT array_to_string(list(e ORDER BY e)[1:3], '; ') FROM (SELECT DISTINCT error AS e FROM s WHERE error IS NOT NULL)) AS errors FROM s""")  # fmt: skip
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _samples(spark, sf_dir).withColumn("ok", F.col("error").isNull())
    return X.validation_summary(s, "ok", "error").withColumn("rate", F.round("rate", 6))


@query("O228", """
SELECT user_id, event_id, CASE WHEN start_ts > end_ts + 1e-6 THEN 'ends before it starts' END AS error, coalesce(start_ts < max(start_ts) OVER (PARTITION BY user_id ORDER BY text, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 10, false) AS warning
FROM blocks WHERE end_ts IS NOT NULL""", ("timed", "blocks"))  # fmt: skip
def flat_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = D.blocks(spark, sf_dir).filter("end_ts IS NOT NULL")
    return V.flat_time_checks(b, ["user_id"], ["text", "event_id"]).select("user_id", "event_id", "error", "warning")


_NODES = """nodes AS (SELECT user_id, 'step' AS level, step_id AS node_id, NULL AS parent_id, min(start_ts) AS start_ts, max(end_ts) - 3600 AS end_ts FROM spans WHERE step_id <> 'S0' GROUP BY user_id, step_id
  UNION ALL SELECT user_id, 'substep', step_id || '.' || (span_id % 5), step_id, start_ts, end_ts FROM spans WHERE step_id <> 'S0')"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.spans(spark, sf_dir).filter("step_id <> 'S0'")
    top = s.groupBy("user_id", "step_id").agg(F.min("start_ts").alias("start_ts"), (F.max("end_ts") - 3600).alias("end_ts"))
    top = top.select("user_id", F.lit("step").alias("level"), F.col("step_id").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), "start_ts", "end_ts")
    return top.unionByName(s.select("user_id", F.lit("substep").alias("level"), F.concat("step_id", F.lit("."), (F.col("span_id") % 5).cast("string")).alias("node_id"), F.col("step_id").alias("parent_id"), "start_ts", "end_ts"))


_N = ("timed", "steps", "spans")


@query("O226 O225", f"""
WITH {_NODES}, s AS (SELECT *, lag(end_ts) OVER (PARTITION BY user_id, parent_id ORDER BY start_ts, node_id) AS b FROM nodes)
SELECT user_id, node_id, 'inverted' AS kind FROM nodes WHERE start_ts > end_ts + 1e-6 UNION ALL
SELECT n.user_id, n.node_id, 'outside parent' FROM nodes n JOIN nodes p ON n.user_id = p.user_id AND n.parent_id = p.node_id WHERE n.start_ts < p.start_ts - 1e-6 OR n.end_ts > p.end_ts + 1e-6 UNION ALL
SELECT user_id, node_id, 'overlaps sibling' FROM s WHERE start_ts < b - 1e-6""", _N)  # fmt: skip
def tree_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.tree_time_violations(nodes(spark, sf_dir), ["user_id"])


@query("O227 O78", f"""
WITH {_NODES}, n AS (SELECT *, regexp_extract(node_id, '(\\d+)$', 1)::INT AS n FROM nodes), m AS (SELECT *, max(n) OVER (PARTITION BY user_id, parent_id ORDER BY start_ts, node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM n)
SELECT user_id, node_id, 'form' AS kind FROM nodes WHERE level = 'substep' AND node_id LIKE '%.0' UNION ALL
SELECT user_id, node_id, 'repeated' FROM nodes GROUP BY user_id, node_id HAVING count(*) > 1 UNION ALL SELECT user_id, node_id, 'order' FROM m WHERE n <= m""", _N)  # fmt: skip
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.id_violations(nodes(spark, sf_dir), ["user_id"])


@query("O234", """
SELECT user_id, 5 - count(DISTINCT step) AS missing_steps, sum(again)::BIGINT AS repeated_segments, coalesce(sum(back), 0)::BIGINT AS backward FROM (
  SELECT user_id, step, (row_number() OVER (PARTITION BY user_id, seg ORDER BY step) > 1)::INT AS again, (step < lag(step) OVER (PARTITION BY user_id ORDER BY seg))::INT AS back
  FROM (SELECT user_id, event_id AS seg, event_id % 5 AS step FROM events)) GROUP BY user_id""")  # fmt: skip
def mapping_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seg"), (F.col("event_id") % 5).alias("step"))
    return V.mapping_errors(m, ["user_id"], "seg", 5)


@query("O232", """
SELECT conv_id, turn, CASE WHEN abs((s + e) / 2 - time * 2) > 2 THEN 'off centre' END AS issue FROM (SELECT *, e - (e - lag(e, 1, 0) OVER (PARTITION BY conv_id ORDER BY turn)) AS s FROM (SELECT *, floor(time * 2) AS e FROM turns))
WHERE abs((s + e) / 2 - time * 2) > 2""", ("turns",))  # fmt: skip
def frame_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = R.frames_continuous(D.turns(spark, sf_dir), ["conv_id"], 2.0)
    return V.alignment_issues(turns, ["conv_id"], ["turn"]).select("conv_id", "turn", "issue")


@query("O233", """
SELECT doc_id, CASE WHEN n_chars <= 2000 THEN 'ok' WHEN n_chars <= 2400 THEN 'shorten by ' || (n_chars - 2000) ELSE 'split into ' || ceil(n_chars / 2000)::BIGINT END AS advice FROM documents""")
def length_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", V.length_advice(F.col("n_chars"), 2000).alias("advice"))


@query("O236", """
SELECT d.doc_id, concat_ws(',', CASE WHEN quality IS NULL THEN 'quality' END, CASE WHEN toxic IS NULL THEN 'toxic' END, 'split') AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def metadata_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return met.select("doc_id", V.missing_fields(met, ("source", "quality", "toxic", "split")).alias("missing"))
