"""Queries over preparation loops, capped and checked scans, and model-backed steps with validated answers."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import text as T
from tidewright.operators import frames as R
from tidewright.operators import generation as N
from tidewright.operators import packing as P
from tidewright.operators import relations as J
from tidewright.operators import validators as V
from tidewright.plans import derived as D
from tidewright.plans.registry import query
from tidewright.session import table
from tidewright.sources import arrow_frames as A
from tidewright.sources import files as S
from tidewright.sources.scratch import scratch_path
from tidewright.streaming import stateful as W
from tidewright.streaming.runs import run_to_table, stream_of

PROMPTS = ("You help with the task.", "You watch and speak up when it helps.", "You guide the user step by step.")


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with frames, costs, and for each reply a summary of what was said so far (the first words of its text)."""
    turns = R.frames_continuous(D.turns(spark, sf_dir), ["conv_id"], 2.0)
    words = F.array_join(F.slice(T.words_of(F.col("text")), 1, 12), " ")
    cost = P.turn_cost(F.col("end_frame") - F.col("start_frame"), F.col("text"), 1).cast("long")
    last = F.max("end_frame").over(Window.partitionBy("conv_id"))
    return turns.withColumns({"cost": cost, "progress": F.when(F.col("role") == "assistant", words), "knowledge": F.concat(F.lit("k"), F.col("conv_id").cast("string")), "n_frames": last + 2})


@query("O138")
def prepared_dialogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.prepare_clips(_clips(spark, sf_dir), "conv_id", "turn", "cost", 600, PROMPTS)


@query("O139")
def prepared_narrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.prepare_clips(_clips(spark, sf_dir), "conv_id", "turn", "cost", 600, PROMPTS, summaries=False, context=(1, 3))
    return found.withColumn("split", F.when(J.md5_rank(F.col("conv_id")) < 0.8, "train").otherwise("val"))


@query("O1 O4 O5", "SELECT conv_id, n FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) ORDER BY conv_id % 4, conv_id LIMIT 50")
def capped_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "folder")
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    S.write_json_arrays(c.withColumn("part", F.col("conv_id") % 4), path, F.floor(F.col("conv_id") / 40_000), ("part",))
    return S.read_json_folder(spark, path, "conv_id long, n long", 50, ("conv_id",)).select("conv_id", "n")


@query("O2 O5", """
SELECT _dataset_name, count(*) AS n FROM (SELECT * FROM (SELECT 'orders' AS _dataset_name, o_orderkey AS k FROM orders UNION ALL SELECT 'parts', p_partkey FROM part) ORDER BY k, _dataset_name LIMIT 100) GROUP BY _dataset_name""")
def capped_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "capped")
    S.write_json_arrays(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), f"{path}/orders", F.floor(F.col("k") / 10_000))
    S.write_json_arrays(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), f"{path}/parts", F.floor(F.col("k") / 10_000))
    found = S.read_datasets(spark, {"orders": f"{path}/orders", "parts": f"{path}/parts"}, "val", "k long", 100, ["k", "_dataset_name"])
    return found.groupBy("_dataset_name").agg(F.count(F.lit(1)).alias("n"))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of each user's events: images as base64 text, every third one as a feature."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("video_uid"), k.cast("long").alias("frame_idx"), "event_type")
    return e.select("video_uid", "frame_idx", F.base64(F.col("event_type").cast("binary")).alias("image"), F.when(F.col("frame_idx") % 3 == 0, F.encode(F.upper("event_type"), "UTF-8")).alias("feature"))


@query("O10 O12 O32", """
SELECT video_uid, frame_idx, frame_idx / 2.0::DOUBLE AS time, CASE WHEN frame_idx % 3 = 0 THEN upper(event_type) ELSE event_type END AS data
FROM (SELECT user_id AS video_uid, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_idx, event_type FROM events)""")
def frame_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "frames")
    _stored(spark, sf_dir).write.parquet(path)
    return S.decoded_frames(spark.read.parquet(path), 2.0).withColumn("data", F.decode("data", "UTF-8"))


@query("O10 O12 O9", """
SELECT user_id::VARCHAR AS video_uid, frame_idx, frame_idx / 2.0::DOUBLE AS time, CASE WHEN frame_idx % 3 = 0 THEN upper(event_type) ELSE event_type END AS data
FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_idx, event_type FROM events) WHERE frame_idx >= user_id % 7 AND frame_idx < user_id % 7 + 12""")
def arrow_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, uid = scratch_path(spark, "archive"), F.col("video_uid")
    stored = _stored(spark, sf_dir)
    for part in (F.col("frame_idx") < 20, F.col("frame_idx") >= 20):  # the second goes on where the first ends
        A.write_frames(stored.filter(part), path, batch_rows=8)
    clips = stored.select("video_uid").distinct().select("video_uid", uid.alias("clip"), (uid % 7).alias("clip_start"), (uid % 7 + 12).alias("clip_end"))
    return S.decoded_frames(A.read_clips(clips, path, strict=False), 2.0).withColumn("data", F.decode("data", "UTF-8"))


@query("O10 O12 O11", """
SELECT user_id::VARCHAR AS video_uid, count(*) AS n, max(k) AS last FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events) GROUP BY 1""")
def arrow_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archive")
    A.write_frames(_stored(spark, sf_dir), path)
    return A.read_frames(spark, path).groupBy("video_uid").agg(F.count(F.lit(1)).alias("n"), F.max("frame_idx").alias("last"))


@query("O9 O32", """
SELECT n_nationkey AS video_uid, n, CASE WHEN n_nationkey * 4 > n THEN 'clip ends at ' || n_nationkey * 4 || ' of ' || n WHEN n_nationkey * 4 <= 2 THEN 'clip is empty' END AS error
FROM (SELECT n_nationkey, coalesce(n, 0) AS n FROM nation LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ON user_id = n_nationkey)""")
def clip_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    clips = table(spark, sf_dir, "nation").select(k.alias("video_uid"), F.lit(2).alias("clip_start"), (k * 4).alias("clip_end"))
    return S.checked_clips(_stored(spark, sf_dir), clips).select("video_uid", F.col("n_frames").alias("n"), "error")


@query("O20", """
SELECT user_id, event_id, (CASE WHEN event_type = 'click' THEN event_id * 50000000 + 15000000 ELSE event_id * 50000000 END) / 10000000.0::DOUBLE AS time,
  CASE WHEN user_id IN (SELECT DISTINCT user_id FROM events ORDER BY user_id LIMIT 40) THEN 'train' ELSE 'val' END AS split FROM events""")
def tick_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, k = scratch_path(spark, "ticks"), F.col("event_id")
    S.write_tsv(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (k * 50_000_000).alias("start"), (k * 50_000_000 + 30_000_000).alias("end")), path)
    rows = S.read_table_text(spark, path, "user_id long, event_id long, event_type string, start long, end long")
    return S.first_ids_split(S.speech_points(rows, "event_type", "click"), "user_id").select("user_id", "event_id", "time", "split")


@query("O23", """
SELECT c_custkey, min('/ann/' || p_partkey || '_' || p_partkey % 50 || '.tsv') AS path FROM customer LEFT JOIN part ON c_custkey = p_partkey OR c_custkey = p_partkey % 50 GROUP BY c_custkey""")
def annotation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("/ann/"), k.cast("string"), F.lit("_"), (k % 50).cast("string"), F.lit(".tsv")).alias("path"))
    return S.file_of_each(files, table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


@query("O27", "SELECT CASE WHEN value > 50 THEN 'done' ELSE 'failed' END AS folder, count(*) AS n FROM events GROUP BY 1")
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "outputs")
    S.write_split(table(spark, sf_dir, "events").select("event_id", "value"), path, F.col("value") > 50)
    side = lambda name: spark.read.schema("event_id long, value double").json(f"{path}/{name}").select(F.lit(name).alias("folder"))
    return side("done").unionByName(side("failed")).groupBy("folder").agg(F.count(F.lit(1)).alias("n"))


@query("O29", "SELECT n_nationkey AS sample_idx, n_name FROM nation")
def prediction_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, n = scratch_path(spark, "predictions"), table(spark, sf_dir, "nation")
    n.select("n_name", F.col("n_nationkey").alias("sample")).repartition("sample").write.partitionBy("sample").json(path)
    return S.read_predictions(spark, path, "n_name string, sample int", n.count()).select("sample_idx", "n_name")


@query("O240", """
WITH RECURSIVE x AS (SELECT conv_id, turn, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(length(text) // 4, 1) END AS cost, turn * 2 AS states, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
p AS (SELECT unnest(['none', 'drop_all', 'drop_middle', 'summarize', 'summarize_with_dst']) AS policy),
w AS (SELECT p.policy, conv_id, 0::BIGINT AS turn, 0::BIGINT AS rn, []::BIGINT[] AS held, 0::BIGINT AS dropped FROM (SELECT DISTINCT conv_id FROM x), p UNION ALL
  SELECT w.policy, x.conv_id, x.turn, x.rn, u.h, coalesce(list_sum(t.f), 0)::BIGINT - coalesce(list_sum(u.h), 0)::BIGINT
  FROM w JOIN x ON x.conv_id = w.conv_id AND x.rn = w.rn + 1, LATERAL (SELECT list_append(w.held, x.cost::BIGINT) AS f) t,
  LATERAL (SELECT CASE WHEN w.policy = 'none' OR list_sum(t.f) < 300 THEN t.f WHEN w.policy = 'drop_all' THEN []::BIGINT[] WHEN w.policy = 'drop_middle' THEN CASE WHEN len(t.f) <= 3 THEN t.f ELSE list_concat(t.f[1:1], t.f[-2:]) END
    WHEN w.policy = 'summarize' THEN [20::BIGINT] ELSE [20 + x.states::BIGINT] END AS h) u)
SELECT policy, conv_id, turn, coalesce(list_sum(held), 0)::BIGINT AS size, dropped FROM w WHERE rn > 0""")  # fmt: skip
def context_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every policy over every conversation, each as a stream; the states' cost is two for each turn before."""
    cost = T.approximate_tokens(F.col("text"))
    out = None
    for policy in W.POLICIES:
        turns = stream_of(spark, sf_dir, "conversations").select("conv_id", "turn", cost.alias("cost"), (F.col("turn") * 2).alias("states"))
        one = run_to_table(W.context_sizes(turns, "conv_id", "turn", "cost", policy, 300, "states")).withColumn("policy", F.lit(policy))
        out = one if out is None else out.unionByName(one)
    return out


@query("O238", """
WITH f AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0::DOUBLE - 1704067200 AS time, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE '' END AS said FROM events),
s AS (SELECT *, last_value(nullif(said, '') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last,
  max(time) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f)
SELECT user_id, event_id, time, CASE WHEN said = coalesce(last, '') THEN '' ELSE said END AS gen FROM s WHERE coalesce(before, 0) < 1500000""")  # fmt: skip
def stream_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    time = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000.0) - 1_704_067_200
    frames = stream_of(spark, sf_dir, "events").select("user_id", "event_id", time.alias("time"), F.lit("Task knowledge: none").alias("system"), F.when(kind.isin("click", "view"), kind).otherwise("").alias("said"), F.lit(None).cast("string").alias("ref"))
    return run_to_table(W.frame_loop(frames, "user_id", ["event_id"], max_time=1_500_000)).select("user_id", "event_id", "time", "gen")


def _mapper(prompts: list[str]) -> list[str | None]:
    """A model that maps one block in three wrongly until it is guided."""
    out: list[str | None] = []
    for p in prompts:
        blocks, steps, key = map(int, re.search(r"map (\d+) blocks to (\d+) steps of (\d+)", p).groups())
        if key % 3 == 0 and "backward" not in p:
            out.append("not JSON" if key % 2 else json.dumps([1] * (blocks + 1)))
        else:
            out.append(json.dumps([-(-i * steps // blocks) for i in range(1, blocks + 1)]))
    return out


@query("O253", """
SELECT o_orderkey, array_to_string(list_transform(range(1, b + 1), lambda i: ceil(i * s / b)::INT), ',') AS mapping, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS tries
FROM (SELECT o_orderkey, (o_custkey % 5 + 2)::INT AS b, (o_custkey % 2 + 1)::INT AS s FROM orders)""")
def span_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey")
    items = table(spark, sf_dir, "orders").select("o_orderkey", (c % 5 + 2).cast("int").alias("blocks"), (c % 2 + 1).cast("int").alias("steps"))
    found = N.map_spans(items, "o_orderkey", _mapper)
    return found.select("o_orderkey", F.array_join(F.transform("mapping", lambda x: x.cast("string")), ",").alias("mapping"), "tries")


@query("O289", """
SELECT event_id, 1 AS line, length(props) AS "column", props[greatest(length(props) - 51, 0) + 1 : length(props) - 1] AS context FROM events""")
def parse_error_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.expr("substring(props, 1, char_length(props) - 1)")  # without the closing bracket, so that parsing stops at the end
    found = V.parse_errors(table(spark, sf_dir, "events").select("event_id", cut.alias("t")), "event_id", "t")
    return found.select("event_id", "line", "column", "context")
