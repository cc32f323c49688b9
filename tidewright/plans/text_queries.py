"""Queries over the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import text as T
from tidewright.plans import derived as D
from tidewright.plans.registry import query
from tidewright.session import table

_CONTAINS = lambda words: "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"
_CASE = lambda rows, default: "CASE " + " ".join(f"WHEN {_CONTAINS(words)} THEN {v!r}" for v, words in rows) + (f" ELSE {default!r}" if default is not None else "") + " END"
_BLANKS = r"[ \t\n\r\f\v]+"
_WORDS = f"list_filter(string_split_regex(coalesce(%s, ''), '{_BLANKS}'), lambda w: w <> '')"


@query("O197 O199", f"""
SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN concat_ws(',', 'initiative|instruction', {_CASE(T.SPEAK_LABELS, None)})
  WHEN role = 'user' THEN concat_ws(',', 'user|input', {_CASE(T.USER_LABELS, None)}) ELSE lower(role) || '|generic' END AS labels
FROM (SELECT *, lower(text) AS low FROM conversations)""")  # fmt: skip
def turn_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.turn_labels(F.col("role"), F.col("text")).alias("labels"))


@query("O180", f"""
SELECT p_partkey, {_CASE(T.DURATIONS, T.DEFAULT_DURATION)}::DOUBLE AS seconds FROM (SELECT p_partkey, lower(p_name) AS low FROM part)""")  # fmt: skip
def inferred_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.infer_duration(F.col("p_name")).alias("seconds"))


@query("O198", """
SELECT user_id, bucket, CASE WHEN s AND c THEN 'initiative|dst_update,dst_multiple' WHEN s THEN 'initiative|dst_update,dst_start'
  WHEN c THEN 'initiative|dst_update,dst_complete' ELSE 'initiative|dst_update,dst_state_change' END || ',steps_' || n AS labels
FROM (SELECT user_id, floor(time / 3600)::BIGINT AS bucket, bool_or(transition = 'start') AS s, bool_or(transition = 'complete') AS c,
  count(DISTINCT step_id) AS n FROM steps GROUP BY ALL)""", ("timed", "steps"))  # fmt: skip
def update_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = D.steps(spark, sf_dir).groupBy("user_id", F.floor(F.col("time") / 3600).alias("bucket")).agg(F.collect_set("transition").alias("t"), F.collect_set("step_id").alias("s"))
    return grouped.select("user_id", "bucket", T.update_labels(F.col("t"), F.col("s")).alias("labels"))


@query("O177", """
SELECT conv_id, turn, CASE WHEN contains(low, 'initiative') THEN 'initiative' WHEN contains(low, 'responsive') THEN 'responsive' END AS initiativity,
  coalesce(nullif(concat_ws(',', CASE WHEN contains(low, 'instruction') THEN 'instruction' END, CASE WHEN contains(low, 'correction') THEN 'correction' END,
  CASE WHEN contains(low, 'info') THEN 'info_sharing' END, CASE WHEN contains(low, 'feedback') THEN 'feedback' END), ''), 'other') AS intention
FROM (SELECT conv_id, turn, lower(text || CASE turn % 3 WHEN 0 THEN ' Initiative Info' WHEN 1 THEN ' responsive feedback correction' ELSE '' END) AS low FROM conversations)""")  # fmt: skip
def intentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("turn") % 3
    text = F.concat("text", F.when(k == 0, " Initiative Info").when(k == 1, " responsive feedback correction").otherwise(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.initiativity(text).alias("initiativity"), T.intention(text).alias("intention"))


@query("O201 O202", """
SELECT event_type, CASE transition WHEN 'start' THEN 0 WHEN 'complete' THEN 1 WHEN 'reset' THEN 5 ELSE 0 END AS code,
  CASE event_type WHEN 'view' THEN 0 ELSE 0 END AS state_code, count(*) AS n FROM (SELECT event_type,
  CASE event_type WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'reset' ELSE event_type END AS transition FROM events) GROUP BY ALL""")  # fmt: skip
def transition_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    name = F.when(kind == "view", "start").when(kind == "purchase", "complete").when(kind == "error", "reset").otherwise(kind)
    coded = table(spark, sf_dir, "events").select("event_type", T.code_of(name, T.TRANSITION_CODES, 0).alias("code"), T.code_of(kind, T.STATE_CODES, 0).alias("state_code"))
    return coded.groupBy("event_type", "code", "state_code").agg(F.count(F.lit(1)).alias("n"))


@query("O203 O275", "SELECT conv_id, turn, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(length(text) // 4, 1) END::INT AS tokens FROM conversations")
def approximate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.approximate_tokens(F.col("text")).alias("tokens"))


@query("O192 O190", """
SELECT p_partkey, upper(substr(d, 1, 1)) || lower(substr(d, 2)) AS caption, p_name || ', ' || lower(substr(p_type, 1, 1)) || substr(p_type, 2) AS joined
FROM (SELECT p_partkey, p_name, p_type, CASE WHEN right(trim(p_name), 1) IN ('.', '?', '!') THEN trim(p_name) ELSE trim(p_name) || '.' END AS d FROM part)""")  # fmt: skip
def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", T.caption(F.col("p_name")).alias("caption"), T.case_connect(F.concat("p_name", F.lit(",")), F.col("p_type")).alias("joined"))


@query("O191", """
SELECT o_orderkey, CASE WHEN n < 1000 THEN n::VARCHAR WHEN n < 1000000 THEN round_even(n / 1e3, 1)::DECIMAL(20,1)::VARCHAR || 'K'
  ELSE round_even(n / 1e6, 1)::DECIMAL(20,1)::VARCHAR || 'M' END AS size FROM (SELECT o_orderkey, o_orderkey * 37 AS n FROM orders)""")  # fmt: skip
def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", T.format_size(F.col("o_orderkey") * 37).alias("size"))


@query("O186 O183 O184 O185", """
SELECT event_id, hour(ts) * 3600 + minute(ts) * 60 + second(ts)::DOUBLE AS seconds, round_even((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) * 2.5, 0)::BIGINT AS frame,
  printf('%02d:%02d:%02d', f // 90000, f % 90000 // 1500, f % 1500 // 25 + CASE WHEN f % 25 > 0 THEN 1 ELSE 0 END) AS stamp,
  'f' || lpad(event_id::VARCHAR, 8, '0') || '.png' AS file FROM (SELECT *, event_id * 7 AS f FROM events)""")  # fmt: skip
def time_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("clock", F.date_format("ts", "HH:mm:ss"))
    seconds = T.seconds_of(F.col("clock"))
    return events.select("event_id", seconds.alias("seconds"), T.frame_of(seconds, 2.5).alias("frame"), T.stamp_of_frame(F.col("event_id") * 7, 25).alias("stamp"), T.frame_file(F.col("event_id"), "f", 8, "png").alias("file"))


_LINES = """SELECT user_id, event_id, CASE event_id % 4 WHEN 0 THEN '[' || s || 's-' || e || 's] - ' || event_type WHEN 1 THEN '[' || s || 's] ' || event_type
  WHEN 2 THEN '[' || s || '-' || e || 's] ' || event_type ELSE event_type || ' without time' END AS line
  FROM (SELECT *, (event_id % 97)::VARCHAR || '.5' AS s, (event_id % 97 + event_id % 5)::VARCHAR AS e FROM events)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s, e = F.col("event_id") % 4, F.concat((F.col("event_id") % 97).cast("string"), F.lit(".5")), (F.col("event_id") % 97 + F.col("event_id") % 5).cast("string")
    both = F.concat(F.lit("["), s, F.lit("s-"), e, F.lit("s] - "), F.col("event_type"))
    one = F.concat(F.lit("["), s, F.lit("s] "), F.col("event_type"))
    trailing = F.concat(F.lit("["), s, F.lit("-"), e, F.lit("s] "), F.col("event_type"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.when(k == 0, both).when(k == 1, one).when(k == 2, trailing).otherwise(F.concat("event_type", F.lit(" without time"))).alias("line"))


@query("O178 O60", rf"""
SELECT event_id, trim(regexp_replace(trim(regexp_extract(line, p, 3)), '^[-•]\s*', '')) AS text, regexp_extract(line, p, 1)::DOUBLE AS start_ts,
  nullif(regexp_extract(line, p, 2), '')::DOUBLE AS end_ts FROM (SELECT *, '\[(\d+\.?\d*)s?(?:-(\d+\.?\d*)s?)?\](.*)$' AS p FROM ({_LINES}))
WHERE regexp_extract(line, p, 1) <> ''""")  # fmt: skip
def parse_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).withColumn("b", T.parse_block(F.col("line"))).filter("b IS NOT NULL").select("event_id", "b.text", "b.start_ts", "b.end_ts")


@query("O179", rf"""
SELECT event_id, text, s AS start_ts, coalesce(e, s + 8.0) AS end_ts FROM (SELECT event_id, regexp_extract(line, p, 3) AS text, regexp_extract(line, p, 1) AS m,
  nullif(regexp_extract(line, p, 1), '')::DOUBLE AS s, nullif(regexp_extract(line, p, 2), '')::DOUBLE AS e
  FROM (SELECT *, '^\s*(?:[-•]\s*)?\[(\d+\.?\d*)(?:-(\d+\.?\d*))?s\]\s*(.+)$' AS p FROM ({_LINES}))) WHERE m <> ''""")  # fmt: skip
def parse_blocks_trailing_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).withColumn("b", T.parse_block_trailing_unit(F.col("line"))).filter("b IS NOT NULL").select("event_id", "b.text", "b.start_ts", "b.end_ts")


@query("O181 O182 O194", r"""
SELECT o_custkey, 'S' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS id, name FROM (
  SELECT o_custkey, o_orderkey, trim(regexp_extract(line, '^\d+\.\s+(.+)$', 1)) AS name
  FROM (SELECT *, o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN ') ' ELSE '.  ' END || o_orderpriority AS line FROM orders)) WHERE name <> ''""")  # fmt: skip
def extract_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    key = F.col("o_orderkey")
    line = F.concat(key.cast("string"), F.when(key % 3 == 0, ") ").otherwise(".  "), F.col("o_orderpriority"))
    named = table(spark, sf_dir, "orders").withColumn("name", T.step_name(line)).filter("name IS NOT NULL")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return named.select("o_custkey", F.concat(F.lit("S"), n.cast("string")).alias("id"), "name")


@query("O176 O195", r"""
SELECT conv_id, turn, round(time, 3) AS time, role, content, CASE WHEN role = 'user' THEN '' WHEN turn % 2 = 0 THEN 'initiative|instruction,feedback' ELSE 'initiative|other' END AS labels
FROM (SELECT *, trim(regexp_replace(trim(text), '\[.*?\|.*?\]', '', 'g')) AS content FROM turns) WHERE role IN ('user', 'assistant') AND NOT starts_with(trim(text), '(')""", ("turns",))  # fmt: skip
def parse_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.when((F.col("turn") % 2 == 0) & (F.col("role") == "assistant"), " [Initiative|instruction, feedback]").otherwise("")
    line = F.concat(F.lit("["), F.col("time").cast("string"), F.lit("s] "), F.initcap("role"), F.lit(": "), F.trim("text"), tag)
    said = D.turns(spark, sf_dir).withColumn("t", T.parse_turn(line)).filter("t IS NOT NULL")
    return said.select("conv_id", "turn", F.round("t.time", 3).alias("time"), "t.role", "t.content", "t.labels")


@query("O205 O204", """
SELECT event_id, step_id, transition FROM steps""", ("timed", "steps"))
def parse_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.col("step_id"), F.lit(" -> "), F.col("transition"))
    return D.steps(spark, sf_dir).select("event_id", T.parse_update(line).alias("u")).select("event_id", "u.step_id", "u.transition")


@query("O54", f"""
SELECT doc_id, CASE WHEN len(w) > 3 AND len(list_distinct(w)) = 1 THEN '' ELSE text END AS text
FROM (SELECT doc_id, text, {_WORDS % 'text'} AS w FROM documents)""")  # fmt: skip
def garbage_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.when(T.is_garbage(F.col("text"), 3), "").otherwise(F.col("text")).alias("text"))


@query("O173", f"""
SELECT a.conv_id, a.turn, round(coalesce(len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0), 0), 6) AS jaccard
FROM (SELECT conv_id, turn, list_distinct({_WORDS % 'lower(text)'}) AS w FROM conversations) a
JOIN (SELECT conv_id, turn, list_distinct({_WORDS % 'lower(text)'}) AS w FROM conversations) b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")  # fmt: skip
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.jaccard(F.col("text"), F.col("next")), 6).alias("jaccard"))


@query("O217", """
SELECT user_id, event_id, CASE WHEN k % 4 = 0 THEN -1 ELSE 26 * (k % 26 + 1) + (k % 7 + 1) END::BIGINT AS number
FROM (SELECT user_id, event_id, event_id AS k FROM events)""")  # fmt: skip
def letter_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    letter = lambda n: F.char((F.lit(97) + n).cast("int"))
    word = F.concat(letter(k % 26), F.when(k % 4 == 0, "7").otherwise(letter(k % 7)))
    return table(spark, sf_dir, "events").select("user_id", "event_id", T.letters_to_number(word).alias("number"))


@query("O218", """
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
  substr('89ab', 1 + ((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) & 3)::INT, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uid
FROM (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(source || '_' || doc_id)) AS h FROM documents)""")  # fmt: skip
def uuid5_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.uuid5_dns(F.concat_ws("_", "source", F.col("doc_id").cast("string"))).alias("uid"))


@query("O211 O212 O213", """
SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat(F.lit("Here it is:\n```json\n"), F.regexp_replace("props", r"\}$", ",}"), F.lit("\n```\n"))
    parsed = F.from_json(T.json_object_text(fenced), "k long")
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"))


@query("O221", """
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return v.join(after, "vec_id").select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"))
