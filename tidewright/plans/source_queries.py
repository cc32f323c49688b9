"""Queries that write files to the shared folder and read them back, and model-backed steps with the stub."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import generation as N
from tidewright.operators import intervals as I
from tidewright.plans import derived as D
from tidewright.plans.check_queries import nodes
from tidewright.plans.registry import query
from tidewright.session import table
from tidewright.sources import files as S
from tidewright.sources.scratch import scratch_path

_CONV = "conv_id long, turns array<struct<turn:long,role:string,text:string>>"


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns"))


@query("O7 O8 O26 O28", "SELECT conv_id, turn, role, text FROM conversations")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, S.prepared_name("dialog", "train", 4096, 1, "none"))
    _conversations(spark, sf_dir).write.json(path)
    back = S.read_json_lines(spark, path, _CONV).filter(f"{S.CORRUPT} IS NULL")
    return back.select("conv_id", F.explode("turns").alias("t")).select("conv_id", "t.*")


@query("O1 O2 O3 O4 O5", "SELECT 'conversations' AS dataset, 'val' AS split, count(*) AS rows, 1::BIGINT AS files FROM (SELECT DISTINCT conv_id FROM conversations)")
def dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "sets")
    c = _conversations(spark, sf_dir)
    S.write_json_arrays(c, f"{path}/raw", F.floor(F.col("conv_id") / 1000))
    rows = S.read_datasets(spark, {"conversations": f"{path}/raw"}, "val", _CONV)
    return S.write_with_manifest(rows, path, "conversations", "val")


@query("O30 O27 O29", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def resume_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "resume")
    docs = table(spark, sf_dir, "documents").select("doc_id")
    good = docs.filter("doc_id % 3 = 0").select(F.to_json(F.struct("doc_id")).alias("value"))
    bad = docs.filter("doc_id % 3 = 1").select(F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string")).alias("value"))  # cut off
    good.unionByName(bad).write.text(path)
    return S.still_to_do(docs, S.read_json_lines(spark, path, "doc_id long"), "doc_id")


@query("O17 O18 O19 O20 O23", """
SELECT 'v' || user_id AS video_id, event_id, event_type AS name, event_id * 10 / 2.0::DOUBLE AS start, event_id * 10 / 2.0 + 3.0::DOUBLE AS end_ts FROM events WHERE event_id % 2 = 0""")
def tsv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tsv")
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("video_id"), F.when(k % 2 == 0, "ego").otherwise("exo").alias("view"), F.lit("train").alias("subset"), (k * 50_000_000).alias("a"), (k * 50_000_000 + 30_000_000).alias("b"), F.col("event_type").alias("n"), k.alias("event_id"))
    S.write_tsv(rows, path)
    read = S.read_table_text(spark, path, "video_id string, view string, subset string, a long, b long, n string, event_id long")
    actions = read.select("video_id", "view", "subset", S.ticks_to_seconds(F.col("a")).alias("start"), S.ticks_to_seconds(F.col("b")).alias("end"), F.concat_ws("#", "n", F.col("event_id").cast("string")).alias("name"))
    flat = S.ego_actions(actions).select("video_id", F.explode("steps").alias("s"))
    part = F.split("s.name", "#")
    return flat.select("video_id", part[1].cast("long").alias("event_id"), part[0].alias("name"), "s.start", F.col("s.end").alias("end_ts"))


_FRAMES = """SELECT l_orderkey AS video_uid, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1)::BIGINT AS frame_idx FROM lineitem"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("video_uid"), k.cast("long").alias("frame_idx"))


@query("O9 O10 O12 O300 O32", f"WITH f AS ({_FRAMES}) SELECT video_uid, frame_idx, frame_idx - 1 AS k, frame_idx / 2.0::DOUBLE AS time FROM f JOIN orders ON o_orderkey = video_uid WHERE frame_idx >= 1 AND frame_idx < o_custkey % 6 AND frame_idx % 2 = 0")
def frame_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video_uid"), F.lit(1).alias("clip_start"), (F.col("o_custkey") % 6).alias("clip_end"))
    found = S.frame_range(S.sampled_frames(_frames(spark, sf_dir), 2.0, 1.0), clips)
    return found.select("video_uid", "frame_idx", "k", "time")


@query("O11", "SELECT o_orderkey AS video_uid, n_frames FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n_frames FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def frame_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("video_uid"))
    videos = table(spark, sf_dir, "orders").select(F.concat(F.when(F.col("o_orderkey") % 2 == 0, "grp-").otherwise(""), F.col("o_orderkey").cast("string")).alias("video_uid"))
    return S.frame_counts(frames, videos).select(F.regexp_replace("video_uid", "^grp-", "").cast("long").alias("video_uid"), "n_frames")


@query("O13 O14", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def grouped_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "groups")
    S.write_groups(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), path, "source", 1000)
    return spark.read.schema("doc_id long, n_chars long, source string").parquet(path).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("O6", "SELECT conv_id, 'k' || conv_id AS knowledge, string_agg('[' || turn || '.0] ' || role, chr(10) ORDER BY turn) FILTER (role = 'user') AS steps FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'user') > 0 AND conv_id % 2 = 0")
def polymorphic_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "videos")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    said = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["turn"].cast("double").alias("time"), t["role"].alias("content")))
    known = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("k"), F.col("conv_id").cast("string")))
    c.select(F.concat(F.lit("["), F.to_json(F.struct(known.alias("inferred_knowledge"), said.alias("conversation"))), F.lit("]")).alias("value")).repartition(4).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)
    found = S.read_videos(spark, path)
    return found.select(F.substring("knowledge", 2, 20).cast("long").alias("conv_id"), "knowledge", "steps")


@query("O33", "SELECT doc_id::VARCHAR AS custom_id, doc_id % 4 <> 3 AS ok, CASE WHEN doc_id % 4 <> 3 THEN 'text ' || doc_id END AS text FROM documents")
def batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    asked = S.batch_requests(table(spark, sf_dir, "documents"), "doc_id", "lang")
    key = F.from_json("request", "custom_id string")["custom_id"]
    body = F.concat(F.lit('{"custom_id": "'), key, F.lit('", "response": {"status_code": 200, "body": {"choices": [{"message": {"content": "text '), key, F.lit('"}}]}}}'))
    failed = F.concat(F.lit('{"custom_id": "'), key, F.lit('", "response": {"status_code": 500}}'))
    return S.batch_results(asked.select(F.when(key.cast("long") % 4 != 3, body).otherwise(failed).alias("value"))).select("custom_id", "ok", "text")


@query("O24", "SELECT DISTINCT user_id, time, event_type AS text FROM timed WHERE (user_id % 2 = 0 AND event_type = 'view') OR (user_id % 2 = 1 AND event_type = 'click')", ("timed",))
def dialogue_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.timed(spark, sf_dir)
    turns = lambda kind, *names: F.collect_list(F.when(F.col("event_type") == kind, F.struct(F.lit("assistant").alias(names[0]), F.col("time").alias(names[1]), F.col("event_type").alias(names[2]))))
    one = t.filter("user_id % 2 = 0").groupBy(F.col("user_id").alias("video_id")).agg(F.array(F.struct(turns("view", "role", "time", "content").alias("conversation"))).alias("conversations"))
    two = t.groupBy(F.col("user_id").alias("video_id")).agg(turns("click", "from", "timestamp", "value").alias("turns"))
    return S.dialogue_turns(one, two).select(F.col("video_id").alias("user_id"), "time", "text").distinct()


@query("O25", """
WITH s AS (SELECT user_id, step_id, dense_rank() OVER (PARTITION BY user_id ORDER BY step_id) AS i, row_number() OVER (PARTITION BY user_id, step_id ORDER BY start_ts, span_id) AS j, start_ts, end_ts FROM spans)
SELECT user_id, 'STEP' AS type, i::VARCHAR AS id, min(start_ts) AS start_ts, max(end_ts) AS end_ts, step_id AS name FROM s GROUP BY user_id, step_id, i
UNION ALL SELECT user_id, 'SUBSTEP', i || '.' || j, start_ts, end_ts, 'part' FROM s UNION ALL SELECT user_id, 'ACTION', i || '.' || j || '.1', start_ts, start_ts, 'act' FROM s""", ("timed", "steps", "spans"))  # fmt: skip
def tree_to_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    act = F.array(F.struct("start_ts", F.col("start_ts").alias("end_ts"), F.lit("act").alias("name")))
    subs = F.array_sort(F.collect_list(F.struct("start_ts", "span_id", "end_ts", F.lit("part").alias("name"), act.alias("actions"))))
    per = D.spans(spark, sf_dir).groupBy("user_id", "step_id").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), subs.alias("substeps"))
    trees = per.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("step_id", "start_ts", "end_ts", F.col("step_id").alias("name"), "substeps"))).alias("steps"))
    path = scratch_path(spark, "tree")
    S.write_tsv(S.tree_rows(trees, "user_id"), path)
    return S.read_table_text(spark, path, "user_id long, type string, id string, start_ts double, end_ts double, name string")


@query("O158")
def tree_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.repair_tree(nodes(spark, sf_dir), "user_id")


@query("O246", "SELECT event_type AS kind, floor(event_id / 1000)::BIGINT AS part, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY ALL")
def trace_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "trace")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), "event_id")
    for half in ("event_id % 2 = 0", "event_id % 2 = 1"):  # a log is appended to
        e.filter(half).write.mode("append").parquet(path)
    back = spark.read.schema("kind string, event_id long").parquet(path)
    return back.groupBy("kind", F.floor(F.col("event_id") / 1000).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


def _answer(text: str) -> str:
    return f"CASE WHEN substr(md5({text}), 1, 1) IN ('0', '1') THEN 'answer ' || substr(md5({text} || ' (again)'), 1, 8) ELSE 'answer ' || substr(md5({text}), 1, 8) END"


@query("O249 O250 O251 O253 O259", f"SELECT conv_id, turn, true AS ok, {_answer('text')} AS text, CASE WHEN substr(md5(text), 1, 1) IN ('0', '1') THEN 2 ELSE 1 END AS tries FROM conversations")
def generate_with_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    return N.generate_with_retries(c, "prompt").select("conv_id", "turn", "ok", "text", "tries")


@query("O252", "SELECT user_id, event_type, max_by(step, (v, -step)) AS step FROM (SELECT user_id, event_type, event_id % 5 AS step, max(value) AS v FROM events GROUP BY ALL) GROUP BY ALL")
def tie_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type", (F.col("event_id") % 5).alias("step")).agg(F.max("value").alias("confidence"))
    return N.break_ties(e, ["user_id", "event_type"])


@query("O263 O265", f"""
SELECT video_id, user_type, clip, clip * 10.0::DOUBLE AS time, {_answer("video_id || '|' || user_type || '|' || clip || '|' || description")} AS text
FROM (SELECT source AS video_id, doc_id AS clip, lang AS description, u AS user_type FROM documents, (VALUES ('no_talk'), ('talk_more')) t(u))""")  # fmt: skip
def clip_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = table(spark, sf_dir, "documents").select(F.col("source").alias("video_id"), F.col("doc_id").alias("clip"), (F.col("doc_id") * F.lit(10.0)).alias("end_ts"), F.col("lang").alias("description"))
    return N.dialogue_by_clip(clips, ["no_talk@2", "talk_more"])
