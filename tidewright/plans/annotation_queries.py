"""Queries over annotation sources and sequence bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import text as T
from tidewright.operators import annotations as A
from tidewright.operators import matching as M
from tidewright.plans import derived as D
from tidewright.plans.frame_queries import _CONTINUOUS, _continuous
from tidewright.plans.registry import query
from tidewright.session import table
from tidewright.sources import listing as L
from tidewright.sources.scratch import written


@query("O16", """
SELECT vid AS video_id, count(*) AS files FROM (SELECT CASE doc_id % 3 WHEN 0 THEN 'v' || doc_id % 50 || '__HMC_21110305_mono10bit' WHEN 1 THEN 'v' || doc_id % 50 || '__HMC_84358933_mono10bit' END AS vid FROM documents) WHERE vid IS NOT NULL GROUP BY vid HAVING count(*) > 1""")  # fmt: skip
def video_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    camera = F.when(k % 3 == 0, L.CAMERAS[0]).when(k % 3 == 1, L.CAMERAS[3]).otherwise("C10095")
    path = F.concat(F.lit("/videos/v"), (k % 50).cast("string"), F.lit("/"), camera, F.lit(".mp4"))
    found = L.list_videos(table(spark, sf_dir, "documents").select(path.alias("path")), "assembly101", skip_single=True)
    return found.select("video_id", F.size("paths").cast("long").alias("files"))


@query("O16", """
SELECT n_regionkey::VARCHAR AS video_id, string_agg('/v/' || n_nationkey || '.mp4', ',' ORDER BY n_nationkey) AS paths FROM nation GROUP BY n_regionkey HAVING min(n_nationkey) = n_regionkey AND count(*) > 1""")  # fmt: skip
def video_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    files = n.select(F.concat(F.lit("/v/"), F.col("n_nationkey").cast("string"), F.lit(".mp4")).alias("path"))
    place = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    groups = n.select(F.col("n_regionkey").alias("video"), F.col("n_nationkey").cast("string").alias("part"), place.alias("pos"))
    found = L.list_videos(files, "ego4d", groups, skip_single=True)
    low = n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("m")).filter("m = n_regionkey").select(F.col("m").cast("string").alias("video_id"))
    return found.join(low, "video_id", "left_semi").select("video_id", F.array_join("paths", ",").alias("paths"))


@query("O202", "SELECT user_id, sum(CASE WHEN event_id % 8 = 0 THEN 1 ELSE 2 END)::BIGINT AS tokens FROM steps GROUP BY user_id", ("timed", "steps"))
def update_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when(F.col("step_id") != "S0", F.col("step_id")).otherwise("")
    u = D.steps(spark, sf_dir).groupBy("user_id").agg(F.collect_list(F.struct(named.alias("step_id"), "transition")).alias("u"))
    return u.select("user_id", A.update_cost(F.col("u")).cast("long").alias("tokens"))


@query("O200", "SELECT p_partkey, CASE WHEN contains(u, 'assembly') THEN 'Assembly task' WHEN contains(u, 'cooking') THEN 'Cooking task' ELSE 'Task completion' END AS goal FROM (SELECT p_partkey, lower(p_name || CASE p_partkey % 3 WHEN 0 THEN 'Assembly' WHEN 1 THEN 'COOKING' ELSE '' END) AS u FROM part)")
def goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    return table(spark, sf_dir, "part").select("p_partkey", A.goal_by_name(F.concat("p_name", F.when(k == 0, "Assembly").when(k == 1, "COOKING").otherwise(""))).alias("goal"))


_SOURCES = """c AS (SELECT l_orderkey AS k, l_linenumber * 10 AS start, l_linenumber * 10 + 10 AS "end", 'step ' || l_linenumber AS name FROM lineitem),
f AS (SELECT l_orderkey AS k, l_linenumber * 10 + l_suppkey % 11 AS start, CASE WHEN l_suppkey % 3 = 0 THEN 'look' ELSE 'attach it' END AS name FROM lineitem WHERE l_discount > 0.02),
m AS (SELECT l_orderkey AS k, l_linenumber * 10 AS start, CASE WHEN l_suppkey % 2 = 0 THEN 'attach' ELSE 'detach' END AS verb, 'a' AS this, 'b' AS that, CASE l_suppkey % 3 WHEN 0 THEN 'mistake' WHEN 1 THEN 'correction' ELSE 'correct' END AS kind FROM lineitem WHERE l_tax > 0.03 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey) = 1)"""


@query("O19 O58 O59 O60", f"""
WITH {_SOURCES} SELECT c.k, c.start / 2.0::DOUBLE AS start_ts, c."end" / 2.0::DOUBLE AS end_ts, CASE verb WHEN 'attach' THEN 'attach a to b' WHEN 'detach' THEN 'detach a from b' ELSE c.name END AS narration,
  CASE kind WHEN 'mistake' THEN 'mistake: wrong' WHEN 'correction' THEN CASE verb WHEN 'attach' THEN 'correction of "detach a from b"' ELSE 'correction of "attach a to b"' END ELSE '' END AS mistake,
  (SELECT count(*) FROM f WHERE f.k = c.k AND f.name LIKE 'attach%' AND f.start BETWEEN c.start AND c."end") AS substeps
FROM c LEFT JOIN m ON m.k = c.k AND m.start = c.start WHERE c.k IN (SELECT k FROM f) AND c.k IN (SELECT k FROM m)""")  # fmt: skip
def steps_with_mistakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 10).alias("start"), "l_linenumber", "l_suppkey", "l_discount", "l_tax")
    s = F.col("l_suppkey")
    coarse = li.select("k", "start", (F.col("start") + 10).alias("end"), F.concat(F.lit("step "), F.col("l_linenumber").cast("string")).alias("name"))
    fine = li.filter("l_discount > 0.02").select("k", (F.col("start") + s % 11).alias("start"), F.when(s % 3 == 0, "look").otherwise("attach it").alias("name"))
    kind = F.when(s % 3 == 0, "mistake").when(s % 3 == 1, "correction").otherwise("correct")
    mistakes = li.filter("l_tax > 0.03").select("k", "start", s.alias("pos"), F.when(s % 2 == 0, "attach").otherwise("detach").alias("verb"), F.lit("a").alias("this"), F.lit("b").alias("that"), kind.alias("kind"), F.lit("wrong").alias("remark"))
    return A.steps_with_mistakes(coarse, fine, mistakes, "k", ("attach", "screw"), 2.0)


@query("O64", """
SELECT p.user_id, p.event_id, p.time, max_by(span_id, (start_ts, span_id)) FILTER (p.time BETWEEN start_ts AND end_ts) AS active, count(*) FILTER (end_ts < p.time) AS completed, min_by(span_id, (start_ts, span_id)) FILTER (start_ts > p.time) AS upcoming
FROM (SELECT user_id, event_id, time FROM timed WHERE event_type = 'signup') p JOIN spans USING (user_id) GROUP BY ALL""", ("timed", "steps", "spans"))  # fmt: skip
def annotation_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = D.timed(spark, sf_dir).filter("event_type = 'signup'").select("user_id", "event_id", "time")
    return A.annotation_state(probes, D.spans(spark, sf_dir).withColumnRenamed("span_id", "node_id"), ["user_id"], "time")


@query("O79 O306", """
SELECT k, clip, kind, CASE WHEN kind = 'turn' THEN f END AS first_bad FROM (SELECT o_orderkey AS k, o_orderkey % 3 AS clip, len(list_filter([o_custkey % 9, o_custkey % 12], lambda e: e <= n)) AS f,
  CASE WHEN n IS NULL THEN 'missing' WHEN o_custkey % 7 >= n THEN 'clip start' WHEN o_custkey % 8 > n THEN 'clip end' WHEN o_custkey % 9 > n OR o_custkey % 12 > n THEN 'turn' END AS kind
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey) WHERE kind IS NOT NULL""")  # fmt: skip
def bound_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey")
    samples = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 3).alias("clip"), (c % 7).alias("clip_start"), (c % 8).alias("clip_end"), F.array(c % 9, c % 12).alias("turn_ends"))
    frames = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n_frames"))
    return A.bound_mismatches(samples, frames, "k").withColumn("first_bad", F.col("first_bad").cast("long"))


@query("O105", f"""
SELECT conv_id, sum(end_frame - start_frame)::BIGINT AS image_tokens, sum(greatest(length(text) // 4, 1) + 3)::BIGINT AS text_tokens,
  (sum(end_frame - start_frame) + sum(greatest(length(text) // 4, 1) + 3) + 60)::BIGINT AS total, sum(end_frame - start_frame) + sum(greatest(length(text) // 4, 1) + 3) + 60 <= 800 AS fits FROM ({_CONTINUOUS}) GROUP BY conv_id""", ("turns",))  # fmt: skip
def sequence_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sequence_length(_continuous(spark, sf_dir), ["conv_id"], 1, 10, 800)


@query("O163 O162", """
SELECT o_orderkey, array_to_string(list_concat(list_transform(range(1, 6), lambda i: CASE WHEN (o_custkey + i) % 2 = 1 THEN o_orderkey + i ELSE -100 END), [-100]), ',') AS labels FROM orders""")
def shifted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    made = table(spark, sf_dir, "orders").select("o_orderkey", F.array(*[k + i for i in range(6)]).alias("t"), F.array(*[(c + i) % 2 for i in range(6)]).alias("l"))
    return made.select("o_orderkey", F.array_join(F.transform(A.shifted_labels(F.col("t"), F.col("l")), lambda x: x.cast("string")), ",").alias("labels"))


@query("O299", "SELECT user_id, frame, CASE WHEN gen <> '' THEN 1 WHEN ref <> '' THEN -100 ELSE 0 END AS label FROM frames", ("timed", "frames"))
def decision_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.frames(spark, sf_dir).select("user_id", "frame", (F.col("gen") != "").cast("int").alias("a"), (F.col("ref") != "").cast("int").alias("b"))
    return A.decision_labels(f, "a", "b").select("user_id", "frame", "label")


@query("O111", "SELECT l_returnflag, round(avg(l_quantity), 4) AS ppl, round(avg(abs(l_linenumber - 3) / 2.0), 4) AS time_diff, round(avg(l_discount), 6) AS token_acc, round(avg((l_tax > 0.05)::INT), 6) AS overflow_ratio FROM lineitem GROUP BY l_returnflag")
def offline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("ppl"), (F.col("l_linenumber") - 3).alias("frame_diff"), F.col("l_discount").alias("token_acc"), (F.col("l_tax") > 0.05).alias("overflow"))
    found = A.offline_summary(t, ["l_returnflag"], 2.0)
    return found.select("l_returnflag", F.round("ppl", 4).alias("ppl"), F.round("time_diff", 4).alias("time_diff"), F.round("token_acc", 6).alias("token_acc"), F.round("overflow_ratio", 6).alias("overflow_ratio"))


@query("O62 O118", """
SELECT doc_id AS video, CASE WHEN doc_id % 3 = 0 AND doc_id % 5 = 0 THEN 'test,val' WHEN doc_id % 3 = 0 THEN 'val' WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS splits FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0""")
def split_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    wide = table(spark, sf_dir, "documents").select(k.alias("video"), (k % 2 == 0).alias("a"), (k % 3 == 0).alias("b"), (k % 5 == 0).alias("c"))
    return A.split_lists(wide, {"a": "train", "b": "val", "c": "test"})


@query("O119", """
SELECT user_id, string_agg(n || ' ' || event_type || CASE WHEN n > 1 THEN 's' ELSE '' END, ', ' ORDER BY f) AS text FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) GROUP BY user_id""")  # fmt: skip
def count_narration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.count_narration(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("O108")
def turn_taking_all_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.frames(spark, sf_dir)
    return M.turn_taking(f, written(M.match_assign(M.match_candidates(f, ["user_id"], (-5, 5)), "user_id", (-5, 5)), "matches"), ["user_id"], 2.0, -1.0)


@query("O135", """
SELECT c.conv_id, c.turn AS split_turn, d.turn AS context_turn FROM turns c JOIN turns d ON c.conv_id = d.conv_id AND d.turn < c.turn AND d.time >= c.time - 60""", ("turns",))  # fmt: skip
def overlap_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.operators.relations import band_join

    t = D.turns(spark, sf_dir)
    cut = t.select("conv_id", F.col("turn").alias("split_turn"), F.col("time").alias("ct"))
    other = t.select("conv_id", F.col("turn").alias("context_turn"), F.col("time").alias("dt"))
    return band_join(cut, other, ["conv_id"], "ct", "dt", -60, 0).filter("context_turn < split_turn").select("conv_id", "split_turn", "context_turn")


@query("O201", "SELECT event_type, CASE event_type WHEN 'error' THEN 3 ELSE 0 END AS code, count(*) AS n FROM events GROUP BY ALL")
def second_code_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = {"no_change": 0, "start": 1, "complete": 2, "error": 3}  # fixed values: the other, incompatible code table
    e = table(spark, sf_dir, "events").select("event_type", T.code_of(F.col("event_type"), codes, 0).alias("code"))
    return e.groupBy("event_type", "code").agg(F.count(F.lit(1)).alias("n"))


@query("O300", """
SELECT o_orderkey, s::BIGINT AS s, e::BIGINT AS e, list_sum(list_transform(range(s, e), lambda i: i * i))::BIGINT AS total FROM (SELECT o_orderkey, o_orderkey % 7 AS s, o_orderkey % 7 + 1 + o_custkey % 4 AS e FROM orders) WHERE e <= 9""")
def embedding_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderkey") % 7
    e = s + 1 + F.col("o_custkey") % 4
    clips = table(spark, sf_dir, "orders").select("o_orderkey", s.alias("s"), e.alias("e")).filter("e <= 9")
    vectors = F.array(*[F.lit(i * i).cast("long") for i in range(9)])
    taken = F.slice(vectors, (F.col("s") + 1).cast("int"), (F.col("e") - F.col("s")).cast("int"))
    return clips.select("o_orderkey", "s", "e", F.aggregate(taken, F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))
