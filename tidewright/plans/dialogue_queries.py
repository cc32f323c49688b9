"""Queries over dialogue functions and small composites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import dialogue as G
from tidewright.functions import text as T
from tidewright.operators import relations as R
from tidewright.plans import derived as D
from tidewright.plans.registry import query
from tidewright.session import table


@query("O187 O223", "SELECT event_id, round_even(value, 1) AS value, to_base64(encode(event_type)) AS packed FROM events")
def rounded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", G.round_time(F.col("value")).alias("value"), F.base64(F.col("event_type").cast("binary")).alias("packed"))


@query("O188 O193", """
SELECT p_partkey, replace(replace(replace(trim(t), '_', ' '), 'student', 'user'), '*unintelligible*', '') AS text, CASE WHEN contains(lower(t), 'coffee') THEN 'Make pour-over coffee' WHEN contains(lower(t), 'tortilla') THEN 'Make pinwheels' ELSE 'Make mug cake' END AS task
FROM (SELECT p_partkey, ' student_' || p_name || CASE p_partkey % 3 WHEN 0 THEN ' Coffee' WHEN 1 THEN ' tortilla *unintelligible*' ELSE '' END AS t FROM part)""")  # fmt: skip
def clean_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    t = F.concat(F.lit(" student_"), F.col("p_name"), F.when(k == 0, " Coffee").when(k == 1, " tortilla *unintelligible*").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", G.clean_annotation(t).alias("text"), G.task_of(t).alias("task"))


@query("O189", """
WITH i AS (SELECT user_id, day, event_type, r FROM (SELECT user_id, floor(time / 86400)::BIGINT AS day, event_type, row_number() OVER (PARTITION BY user_id, floor(time / 86400) ORDER BY time, event_id) AS r FROM timed) WHERE r <= 2)
SELECT user_id, day, coalesce(string_agg(CASE WHEN event_type = 'error' THEN NULL WHEN r = 1 THEN 'C does ' || event_type ELSE 'and does ' || event_type END, ' ' ORDER BY r) || '.', '') AS narration FROM i GROUP BY user_id, day""", ("timed",))  # fmt: skip
def merge_narrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    text = F.when(kind == "error", F.concat(F.lit("#C C does "), kind, F.lit(" #Unsure"))).otherwise(F.concat(F.lit("#C C does "), kind, F.when(F.col("event_id") % 2 == 0, " #C C again").otherwise("")))
    grouped = D.timed(spark, sf_dir).groupBy("user_id", F.floor(F.col("time") / 86400).alias("day")).agg(F.transform(F.array_sort(F.collect_list(F.struct("time", "event_id", text.alias("t")))), lambda x: x["t"]).alias("items"))
    return grouped.select("user_id", "day", G.merge_narrations(F.col("items")).alias("narration"))


@query("O207", """
SELECT user_id, string_agg('Step ' || step_id || CASE transition WHEN 'start' THEN ' has been started.' WHEN 'complete' THEN ' has been completed.' ELSE ' state changed to reset.' END, ' ' ORDER BY time, event_id) AS description FROM steps GROUP BY user_id""", ("timed", "steps"))  # fmt: skip
def describe_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.array_sort(F.collect_list(F.struct("time", "event_id", "step_id", "transition")))
    return D.steps(spark, sf_dir).groupBy("user_id").agg(u.alias("u")).select("user_id", G.describe_updates(F.col("u")).alias("description"))


@query("O206 O287", f"""
WITH l AS (SELECT user_id, step_id, max_by(CASE transition WHEN 'start' THEN 'in_progress' ELSE 'completed' END, (time, event_id)) FILTER (transition <> 'reset') AS s FROM steps GROUP BY ALL)
SELECT user_id, '{G.OVERVIEW}' || chr(10) || string_agg(step_id || ': name of ' || step_id, chr(10) ORDER BY step_id) || chr(10) || chr(10) || '{G.PERSONA.replace("'", "''")}' || chr(10) || chr(10) || '{G.STATE_TITLE}' || chr(10) || 'Current step states - ' ||
  string_agg('Step ' || step_id || ': ' || coalesce(s, 'not_started'), ', ' ORDER BY step_id) AS prompt FROM l GROUP BY user_id""", ("timed", "steps"))  # fmt: skip
def system_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("transition") == "start", "in_progress").when(F.col("transition") == "complete", "completed")
    last = D.steps(spark, sf_dir).groupBy("user_id", "step_id").agg(F.max_by(state, F.when(state.isNotNull(), F.struct("time", "event_id"))).alias("s"))
    per = last.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("step_id", F.concat(F.lit("name of "), F.col("step_id")).alias("name")))).alias("steps"), F.map_from_entries(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("step_id", "s")))).alias("states"))
    return per.select("user_id", G.system_prompt(F.col("steps"), F.col("states")).alias("prompt"))


@query("O208 O219", """
SELECT conv_id, '<|begin_of_text|>' || string_agg('<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || trim(text) || '<|eot_id|>', '' ORDER BY turn) AS chat,
  string_agg('[' || turn || 's] ' || role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id""")  # fmt: skip
def chat_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = G.chat_message(F.col("role"), F.col("text"))
    line = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("s] "), F.col("role"), F.lit(": "), F.col("text"))
    joined = lambda c, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", c.alias("x")))), lambda x: x["x"]), sep)
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.concat(F.lit(G.BEGIN), joined(said, "")).alias("chat"), joined(line, "\n").alias("transcript"))


@query("O209", "SELECT conv_id, turn, trim(text) AS text, role FROM conversations WHERE NOT contains(text, ':')")
def clean_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter(~F.col("text").contains(":"))
    raw = F.concat(F.lit(G.BEGIN), G.chat_message(F.col("role"), F.col("text")), F.lit("rest"))
    return c.select("conv_id", "turn", G.clean_generated(raw).alias("g")).select("conv_id", "turn", "g.text", "g.role")


@query("O210 O220 O264", "SELECT doc_id, source || ' in ' || lang AS summary FROM documents")
def clean_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = G.fill_template("Sum up. User: x Assistant: Sum up. {source} in {lang}{failure}", source=F.col("source"), lang=F.col("lang"), failure=F.lit(None).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", G.clean_summary(made, "Sum up.").alias("summary"))


@query("O214 O215 O270", """
SELECT user_id, d AS dataset, 'stream' AS runner, 4096 AS max_len, 0.3::DOUBLE AS threshold, 'drop_all' AS context, l AS left_s, r AS right_s, d || '_t0.3_len4096' AS name
FROM (SELECT DISTINCT user_id, user_id % 4 AS k FROM events) JOIN (VALUES (0, 'wtag', -3.0::DOUBLE, 6.0::DOUBLE), (1, 'ego4d-narration', -2.5, 2.5), (2, 'ego4d', -4.0, 8.5), (3, 'other', -2.5, 2.5)) t(k, d, l, r) USING (k)""")  # fmt: skip
def setups(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("user_id") % 4
    d = F.when(k == 0, "wtag").when(k == 1, "ego4d-narration").when(k == 2, "ego4d").otherwise("other")
    u = table(spark, sf_dir, "events").select("user_id").distinct().withColumn("s", F.explode(G.parse_setups(F.concat(d, F.lit("|stream|4k|0.3|drop_all")))))
    w = G.match_window(F.col("s.dataset"))
    return u.select("user_id", "s.dataset", "s.runner", "s.max_len", "s.threshold", "s.context", w["left"].alias("left_s"), w["right"].alias("right_s"), G.run_name(F.col("s.dataset"), F.col("s.threshold"), F.col("s.max_len")).alias("name"))


@query("O34 O16 O302", """
SELECT doc_id, '/data/' || source AS folder, '/data/' || source || '/prepared/' || lang || '_val_x.jsonl' AS file, doc_id % 5 AS repeat, source || '/' || lang || '_val' AS short, 'P' || doc_id % 100 AS vid FROM documents""")
def dataset_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    name = F.concat("source", F.lit("/"), "lang", F.lit("_val_x@"), (k % 5).cast("string"))
    stem = F.concat(F.lit("kitchen_"), F.concat(F.lit("P"), (k % 100).cast("string")), F.lit("_x-y"))
    return table(spark, sf_dir, "documents").select("doc_id", G.resolve_dataset(name, "/data").alias("r"), G.video_id(stem).alias("vid")).select("doc_id", "r.folder", "r.file", F.col("r.repeat").cast("long").alias("repeat"), "r.short", "vid")


@query("O216 O301", r"""
SELECT item_id, len(t) AS tokens, array_to_string(t[1:5], ' ') AS head FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:''[\p{L}]+)?') AS t FROM benchmark)""")
def simple_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = G.simple_tokens(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(t).cast("long").alias("tokens"), F.array_join(F.slice(t, 1, 5), " ").alias("head"))


@query("O301 O163", """
SELECT o_orderkey, CASE WHEN s <= max_o THEN first END AS first, CASE WHEN s <= max_o THEN last END AS last FROM (SELECT o_orderkey, o_custkey % 40 AS s, len(list_filter([0, 5, 10, 15, 20, 25, 30], lambda o: o < o_custkey % 40)) AS first,
  len(list_filter([0, 5, 10, 15, 20, 25, 30], lambda o: o < o_custkey % 40 + 7)) AS last, 30 AS max_o FROM orders)""")  # fmt: skip
def token_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    offsets = F.array(*[F.lit(i) for i in range(0, 31, 5)])
    s = F.col("o_custkey") % 40
    r = G.token_range(offsets, s, s + 7)
    return table(spark, sf_dir, "orders").select("o_orderkey", r.alias("r")).select("o_orderkey", F.col("r.first").cast("long").alias("first"), F.col("r.last").cast("long").alias("last"))


@query("O303", """
SELECT o_orderkey, repeat('.', a) || repeat('#', least(n, 20 - a)) || repeat('.', greatest(20 - a - n, 0)) AS grid FROM (SELECT o_orderkey, (o_orderkey % 20)::INT AS a, (o_custkey % 6 + 1)::INT AS n FROM orders)""")
def timeline_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("o_orderkey") % 20
    return table(spark, sf_dir, "orders").select("o_orderkey", G.marker_grid(a, a + F.col("o_custkey") % 6).alias("grid"))


@query("O41 O48", "SELECT user_id, count(*) FILTER (event_type NOT IN ('click', 'view')) AS silent, count(*) AS n FROM events GROUP BY user_id HAVING count(*) FILTER (event_type IN ('click', 'view')) / count(*) >= 0.4")
def annotation_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = F.col("event_type").isin("click", "view")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(~talks).alias("silent"), F.count(F.lit(1)).alias("n")).filter((F.col("n") - F.col("silent")) / F.col("n") >= 0.4)


@query("O88", "SELECT conv_id, sum(length(text) - length(replace(text, ' ', '')))::BIGINT AS blanks, sum(length(text))::BIGINT AS chars, round(sum(length(text) - length(replace(text, ' ', ''))) / sum(length(text)), 6) AS ratio FROM conversations GROUP BY conv_id")
def token_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    blanks, chars = F.sum(F.regexp_count("text", F.lit(" "))), F.sum(F.char_length("text"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(blanks.alias("blanks"), chars.alias("chars"), F.round(blanks / chars, 6).alias("ratio"))


@query("O273 O281", "SELECT conv_id, turn - min(turn) OVER (PARTITION BY conv_id) AS idx, count(*) OVER (PARTITION BY conv_id) AS turns, 'conv_' || conv_id AS uid, length(text) AS len FROM conversations")
def conversation_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    flat = c.select("conv_id", F.size("t").cast("long").alias("turns"), F.posexplode("t").alias("pos", "x"))
    meta = F.struct(F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("uid"), F.char_length("x.text").cast("long").alias("len"))
    return flat.withColumn("m", meta).select("conv_id", F.col("pos").cast("long").alias("idx"), "turns", "m.uid", "m.len")


@query("O286", "SELECT c.conv_id, min(d.turn) AS at FROM conversations c JOIN conversations d ON c.conv_id = d.conv_id AND c.role = d.role AND c.text = d.text GROUP BY c.conv_id, c.turn")
def segment_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    probe = c.select(F.col("conv_id").alias("i"), F.col("turn").alias("p"), F.col("role").alias("r"), F.col("text").alias("t"))
    met = probe.join(c, (F.col("i") == c["conv_id"]) & F.col("r").eqNullSafe(c["role"]) & F.col("t").eqNullSafe(c["text"]))
    return met.groupBy("conv_id", "p").agg(F.min("turn").alias("at")).select("conv_id", "at")


@query("O290 O252", """
SELECT event_id, CASE WHEN value > 60 THEN 'clear' WHEN b.v IS NOT NULL AND b.v > value THEN 'other' ELSE 'own' END AS decision FROM events e LEFT JOIN (SELECT event_id - 1 AS k, value AS v FROM events) b ON b.k = e.event_id""")
def two_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "value")
    clear = e.filter("value > 60").select("event_id", F.lit("clear").alias("decision"))
    other = e.select((F.col("event_id") - 1).alias("event_id"), F.col("value").alias("v"))
    rest = e.filter("value <= 60").join(other, "event_id", "left").select("event_id", F.when(F.col("v") > F.col("value"), "other").otherwise("own").alias("decision"))
    return clear.unionByName(rest)


@query("O296", """
SELECT a.user_id, a.k, a.event_id AS block, b.event_id AS step, a.time AS start_ts, a.time + CASE WHEN a.event_id % 2 = 0 THEN 5.0 ELSE 9.0 END AS end_ts
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM timed WHERE event_type = 'click') a JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM timed WHERE event_type = 'view') b USING (user_id, k)""", ("timed",))  # fmt: skip
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    t = D.timed(spark, sf_dir)
    end = F.coalesce(F.when(F.col("event_id") % 2 == 1, F.col("time") + 9.0), F.col("time") + 5.0)
    blocks = t.filter("event_type = 'click'").select("user_id", k.alias("k"), F.col("event_id").alias("block"), F.col("time").alias("start_ts"), end.alias("end_ts"))
    steps = t.filter("event_type = 'view'").select("user_id", k.alias("k"), F.col("event_id").alias("step"))
    return blocks.filter("end_ts > start_ts").join(steps, ["user_id", "k"])


@query("O298", "SELECT user_id, event_id * 2 + 1 AS pos, 'assistant' AS role FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, event_id * 2, 'DST_UPDATE' FROM events WHERE event_type IN ('click', 'view')")
def grid_to_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, kind = F.col("event_id") * 2, F.col("event_type")
    update = F.when(kind.isin("click", "view"), F.struct(k.alias("pos"), F.lit("DST_UPDATE").alias("role")))
    said = F.when(kind == "click", F.struct((k + 1).alias("pos"), F.lit("assistant").alias("role")))
    return table(spark, sf_dir, "events").select("user_id", F.explode(F.filter(F.array(update, said), lambda x: x.isNotNull())).alias("x")).select("user_id", "x.pos", "x.role")


@query("O75", """
WITH c AS (SELECT event_id, user_id, time FROM timed WHERE event_type = 'click'), v AS (SELECT event_id AS vid, user_id, time AS vt FROM timed WHERE event_type = 'view'),
m AS (SELECT c.event_id, v.vid, CASE WHEN floor(time) = floor(vt) THEN 1 WHEN floor(time / 60) = floor(vt / 60) THEN 2 ELSE 3 END AS tier FROM c JOIN v ON c.user_id = v.user_id AND floor(c.time / 3600) = floor(v.vt / 3600))
SELECT event_id, vid, tier FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY tier, vid) AS r FROM m) WHERE r = 1""", ("timed",))  # fmt: skip
def fallback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.timed(spark, sf_dir).withColumn("h", F.floor(F.col("time") / 3600))
    c = t.filter("event_type = 'click'").select("user_id", "h", "event_id", "time")
    v = t.filter("event_type = 'view'").select("user_id", "h", F.col("event_id").alias("vid"), F.col("time").alias("vt"))
    near = lambda w: F.floor(F.col("time") / w) == F.floor(F.col("vt") / w)
    met = c.join(v, ["user_id", "h"]).withColumn("tier", F.when(near(1), 1).when(near(60), 2).otherwise(3))
    return R.top_per_group(met, ["event_id"], ["tier", "vid"]).select("event_id", "vid", "tier")


@query("O61 O268", "SELECT DISTINCT n_nationkey, s.camera FROM nation, (VALUES ('e1'), ('e2'), ('e3')) s(camera) WHERE (n_nationkey, s.camera) IN (SELECT s_nationkey, 'e' || (s_suppkey % 4) FROM supplier)")
def camera_replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, ("e1", "e2", "e3")))).alias("camera"))
    files = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.concat(F.lit("e"), (F.col("s_suppkey") % 4).cast("string")).alias("camera"))
    return tasks.join(files, ["n_nationkey", "camera"], "left_semi")


@query("O95", "SELECT user_id, count(DISTINCT step_id) AS steps, count(*) AS substeps, max(n) AS largest FROM (SELECT *, count(*) OVER (PARTITION BY user_id, step_id) AS n FROM spans) GROUP BY user_id", ("timed", "steps", "spans"))
def tree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = D.spans(spark, sf_dir).groupBy("user_id", "step_id").agg(F.collect_list("span_id").alias("s")).groupBy("user_id").agg(F.collect_list("s").alias("t"))
    sizes = F.transform("t", lambda s: F.size(s))
    return tree.select("user_id", F.size("t").cast("long").alias("steps"), F.aggregate(sizes, F.lit(0), lambda a, b: a + b).cast("long").alias("substeps"), F.array_max(sizes).cast("long").alias("largest"))


@query("O279 O306", "SELECT user_id, span_id, 'S' || row_number() OVER (PARTITION BY user_id ORDER BY start_ts, span_id) AS id, start_ts, end_ts FROM spans", ("timed", "steps", "spans"))
def structure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("start_ts", "span_id"))
    return D.spans(spark, sf_dir).select("user_id", "span_id", F.concat(F.lit("S"), n.cast("string")).alias("id"), "start_ts", "end_ts")


@query("O254", "SELECT a.vec_id, round(0.6 * list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 0.4 * (a.label = b.label)::INT, 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 2")
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    o = v.select((F.col("vec_id") - 2).alias("vec_id"), F.col("embedding").alias("e2"), F.col("label").alias("l2"))
    score = 0.6 * T.cosine(F.col("embedding"), F.col("e2")) + 0.4 * (F.col("label") == F.col("l2")).cast("int")
    return v.join(o, "vec_id").select("vec_id", F.round(score, 6).alias("score"))
