"""Queries over joins, selections, samples and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import text as T
from tidewright.operators import relations as R
from tidewright.plans import derived as D
from tidewright.plans.registry import query
from tidewright.session import table

_NW = r"len(list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda w: w <> ''))"


@query("O82 O94 O200", f"""
SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, count(*) FILTER (role = 'assistant') AS assistant_turns, bool_or(role = 'system') AS has_system,
  round(avg({_NW}), 4) AS mean_words, CASE WHEN count(*) FILTER (role = 'user') = 0 THEN 'no_talk' WHEN count(*) FILTER (role = 'user') <= count(*) * 0.2 THEN 'talk_some' ELSE 'talk_more' END AS user_type,
  round(least(2.0 + (count(*) FILTER (role = 'user') > 0)::INT + (count(*) FILTER (role = 'assistant') > 0)::INT + least(count(*) / 10.0, 1.0), 5.0), 4) AS quality
FROM conversations GROUP BY conv_id""")  # fmt: skip
def turn_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, user, assistant = F.count(F.lit(1)), F.count_if(F.col("role") == "user"), F.count_if(F.col("role") == "assistant")
    kind = F.when(user == 0, "no_talk").when(user <= n * 0.2, "talk_some").otherwise("talk_more")
    quality = F.least(F.lit(2.0) + (user > 0).cast("int") + (assistant > 0).cast("int") + F.least(n / 10.0, F.lit(1.0)), F.lit(5.0))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        n.alias("turns"), user.alias("user_turns"), assistant.alias("assistant_turns"), F.bool_or(F.col("role") == "system").alias("has_system"), F.round(F.avg(F.size(T.words_of(F.col("text")))), 4).alias("mean_words"), kind.alias("user_type"), F.round(quality, 4).alias("quality")
    )


@query("O82 O92", f"SELECT role, count(*) AS n, sum({_NW})::BIGINT AS words FROM conversations GROUP BY role")
def role_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(T.words_of(F.col("text")))).alias("words"))


@query("O84", "SELECT conv_id, count(*) FILTER (role = 'system') AS system, count(*) FILTER (role = 'user') AS user, count(*) FILTER (role = 'assistant') AS assistant FROM conversations GROUP BY conv_id")
def role_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").pivot("role", ["system", "user", "assistant"]).agg(F.count(F.lit(1))).na.fill(0)


@query("O83 O89", "SELECT least(n // 2, 100) AS bin, count(*) AS conversations FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) GROUP BY ALL")
def turn_length_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").count()
    return n.groupBy(F.least(F.floor(F.col("count") / 2), F.lit(100)).alias("bin")).agg(F.count(F.lit(1)).alias("conversations"))


@query("O80", "SELECT lang, source, grouping(lang, source)::INT AS level, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def corpus_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").rollup("lang", "source")
    return docs.agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))


@query("O83", "SELECT lang, toxic, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY CUBE (lang, toxic)")
def lang_label_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id").cube("lang", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("O81", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS weight FROM orders GROUP BY o_orderpriority")
def domain_weighted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("weight"))


@query("O166", "SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 10")
def topk_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_per_group(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.col("n_chars").desc(), "doc_id"], 10)


@query("O167", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def longest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.col("n_chars").desc(), "doc_id").limit(25)


@query("O38", """
SELECT user_id, event_type, event_id, value FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS r FROM events WHERE value >= 40 AND event_type IN ('view', 'click', 'purchase')) WHERE r = 1) WHERE n = 3""")  # fmt: skip
def eval_filter_all_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "click", "purchase")).select("user_id", "event_type", "event_id", "value")
    return R.best_of_every_type(events, ["user_id"], "event_type", "value", "event_id", 40, 3)


@query("O39", """
SELECT user_id, event_type, event_id, 1 AS copy FROM (SELECT *, row_number() OVER w AS r, ceil(count(*) OVER (PARTITION BY user_id, event_type) * 0.3) AS n
  FROM events WHERE value >= 10 WINDOW w AS (PARTITION BY user_id, event_type ORDER BY value, event_id)) WHERE r <= n""")  # fmt: skip
def train_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return R.train_share(events, ["user_id", "event_type"], "value", "event_id", 10, 0.3).select("user_id", "event_type", "event_id", "copy")


@query("O55 O39 O265", "SELECT l.doc_id, c.copy::INT AS copy FROM labels l, unnest([1, 2, 3]) AS c(copy) WHERE quality >= 1")
def repeated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.train_share(table(spark, sf_dir, "labels"), ["doc_id"], "quality", "doc_id", 1, 3).select("doc_id", "copy")


@query("O40 O49", "SELECT doc_id, CASE WHEN ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.5 THEN 'val' ELSE 'test' END AS split FROM documents")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.when(R.md5_rank(F.col("doc_id")) < 0.5, "val").otherwise("test").alias("split"))


@query("O50 O51 O52 O224 O305", """
SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5(event_id::VARCHAR), event_id) AS r, greatest(floor(count(*) OVER (PARTITION BY user_id) * 0.1), 1) AS k
  FROM events WHERE event_type <> 'click') WHERE r <= k""")  # fmt: skip
def negative_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sample_share(table(spark, sf_dir, "events").filter("event_type <> 'click'").select("user_id", "event_id"), ["user_id"], "event_id", 0.1)


@query("O30 O304", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("O45 O37 O21", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def feature_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    return R.semi_unless_empty(table(spark, sf_dir, "documents").select("doc_id", "source"), keys, ["doc_id"])


@query("O22 O62 O118", """
SELECT doc_id, CASE WHEN source IN ('src0', 'src1') THEN 'train' WHEN quality = 1 THEN 'val' ELSE 'test' END AS split FROM documents JOIN labels USING (doc_id)
WHERE source IN ('src0', 'src1') OR toxic = 0""")  # fmt: skip
def split_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.col("source").isin("src0", "src1")
    met = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    routed = F.when(known, "train").when((F.col("toxic") == 0) & (F.col("quality") == 1), "val").when(F.col("toxic") == 0, "test")
    return met.select("doc_id", routed.alias("split")).filter("split IS NOT NULL")


@query("O175", "SELECT n_nationkey, ((row_number() OVER (ORDER BY n_name) - 1) % 4)::INT AS part FROM nation")
def roundrobin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.round_robin(table(spark, sf_dir, "nation"), ["n_name"], 4).select("n_nationkey", "part")


@query("O56 O17", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def nation_region_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select("n_name", "r_name")  # five regions at any scale


@query("O57 O119", """
SELECT o_orderkey, count(*) AS n, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_quantity DESC, l_linenumber) AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY o_orderkey""")  # fmt: skip
def one_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    met = o.filter("o_orderpriority = '1-URGENT'").select("o_orderkey").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    items = F.array_sort(F.collect_list(F.struct((-F.col("l_quantity")).alias("q"), "l_linenumber")))
    return met.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(items, lambda x: x["l_linenumber"].cast("string")), ",").alias("lines"))


@query("O58", "SELECT d.doc_id, l.toxic, b.item_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id JOIN benchmark b ON b.item_id = d.doc_id % 97")
def three_way_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 97).alias("item_id"))
    return d.join(table(spark, sf_dir, "labels"), "doc_id").join(table(spark, sf_dir, "benchmark").select("item_id"), "item_id").select("doc_id", "toxic", "item_id")


@query("O59 O67", """
SELECT o_orderkey, l_linenumber FROM (SELECT o_orderkey, l_linenumber, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber) AS r
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R') WHERE r = 1""")  # fmt: skip
def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber")
    return R.first_match_join(o, li, [F.col("o_orderkey") == F.col("l_orderkey")], ["o_orderkey"], ["l_linenumber"]).select("o_orderkey", "l_linenumber")


@query("O60", """
SELECT e.user_id, e.event_id, s.span_id FROM timed e JOIN spans s ON e.user_id = s.user_id AND e.time BETWEEN s.start_ts AND s.end_ts WHERE e.event_type = 'click'""", ("timed", "steps", "spans"))  # fmt: skip
def point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = D.timed(spark, sf_dir).filter("event_type = 'click'").select("user_id", "event_id", "time")
    return R.point_in_interval(points, D.spans(spark, sf_dir), ["user_id"], "time", 86400.0).select("user_id", "event_id", "span_id")


@query("O72", """
SELECT a.user_id, a.event_id AS click_id, b.event_id AS view_id FROM timed a JOIN timed b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' AND b.time - a.time BETWEEN -1800 AND 1800""", ("timed",))  # fmt: skip
def near_time_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.timed(spark, sf_dir)
    a = t.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("time").alias("ta"))
    b = t.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("time").alias("tb"))
    return R.band_join(a, b, ["user_id"], "ta", "tb", -1800, 1800).select("user_id", "click_id", "view_id")


@query("O63", """
SELECT p.user_id, p.event_id, min(s.span_id) AS span_id FROM timed p JOIN spans s ON p.event_type = 'click' AND s.user_id = p.user_id AND p.time BETWEEN s.start_ts AND s.end_ts GROUP BY p.user_id, p.event_id""", ("timed", "steps", "spans"))  # fmt: skip
def point_in_interval_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with the first span, by source order, that holds it."""
    points = D.timed(spark, sf_dir).filter("event_type = 'click'").select("user_id", "event_id", "time")
    met = R.point_in_interval(points, D.spans(spark, sf_dir), ["user_id"], "time", 86400.0)
    return R.top_per_group(met, ["event_id"], ["span_id"]).select("user_id", "event_id", "span_id")


@query("O65 O66", """
SELECT a.user_id, a.event_id AS click_id, min(b.event_id) AS view_id FROM timed a JOIN timed b ON a.event_type = 'click' AND b.event_type = 'view' AND a.user_id = b.user_id AND abs(b.time - a.time) < 1800 GROUP BY a.user_id, a.event_id""", ("timed",))  # fmt: skip
def near_time_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with the first view, by source order, less than 1800 seconds off; a view may meet several clicks."""
    t = D.timed(spark, sf_dir)
    a = t.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("time").alias("ta"))
    b = t.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("time").alias("tb"))
    met = R.band_join(a, b, ["user_id"], "ta", "tb", -1800, 1800).filter("abs(tb - ta) < 1800")
    return R.top_per_group(met, ["click_id"], ["view_id"]).select("user_id", "click_id", "view_id")


@query("O70", """
SELECT a.user_id, a.event_id, round(min(abs(a.time - b.time)), 4) AS distance FROM timed a JOIN timed b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' GROUP BY a.user_id, a.event_id""", ("timed",))  # fmt: skip
def nearest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.timed(spark, sf_dir)
    found = R.nearest(t.filter("event_type = 'click'").select("user_id", "event_id", "time"), t.filter("event_type = 'view'").select("user_id", F.col("time").alias("vt")), ["user_id"], "time", "vt")
    return found.filter("distance IS NOT NULL").select("user_id", "event_id", F.round("distance", 4).alias("distance"))


@query("O71", """
SELECT user_id, (floor(time / 600)::BIGINT + 1) * 600 AS frame_time, string_agg(event_type, '; ' ORDER BY time, event_id) FILTER (r <= 2) AS narration FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, floor(time / 600) ORDER BY time, event_id) AS r FROM timed) GROUP BY user_id, floor(time / 600)""", ("timed",))  # fmt: skip
def forward_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = (F.floor(F.col("time") / 600) + 1) * 600
    grouped = D.timed(spark, sf_dir).groupBy("user_id", frame.alias("frame_time")).agg(F.slice(F.array_sort(F.collect_list(F.struct("time", "event_id", "event_type"))), 1, 2).alias("x"))
    return grouped.select("user_id", "frame_time", F.array_join(F.transform("x", lambda x: x["event_type"]), "; ").alias("narration"))


@query("O74 O110 O271", """
SELECT a.conv_id, a.k, a.turn AS user_turn, b.turn AS reply_turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user') a
JOIN (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'assistant') b ON a.conv_id = b.conv_id AND a.k = b.k""")  # fmt: skip
def index_aligned_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long")
    c = table(spark, sf_dir, "conversations")
    side = lambda role, name: c.filter(F.col("role") == role).select("conv_id", k.alias("k"), F.col("turn").alias(name))
    return side("user", "user_turn").join(side("assistant", "reply_turn"), ["conv_id", "k"])


@query("O91 O42", """
SELECT user_id, event_type, votes FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, f) AS r FROM (SELECT user_id, event_type, count(*) AS votes, min(event_id) AS f FROM events GROUP BY ALL)) WHERE r = 1""")  # fmt: skip
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.majority(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query("O43", """
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, floor(time / 86400), event_type ORDER BY time, event_id) AS r FROM timed WHERE event_type NOT IN ('error')) WHERE r = 1""", ("timed",))  # fmt: skip
def stoplist_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.timed(spark, sf_dir).filter(~F.col("event_type").isin("error")).withColumn("day", F.floor(F.col("time") / 86400))
    return R.top_per_group(t, ["user_id", "day", "event_type"], ["time", "event_id"]).select("user_id", "event_id", "event_type")


@query("O44", """
SELECT c.conv_id, c.turn FROM conversations c LEFT JOIN (SELECT conv_id, min(turn) AS cut FROM conversations WHERE role = 'assistant' AND turn > 2 GROUP BY conv_id) m ON c.conv_id = m.conv_id WHERE cut IS NULL OR turn <= cut""")  # fmt: skip
def cut_at_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.min(F.when((F.col("role") == "assistant") & (F.col("turn") > 2), F.col("turn"))).over(Window.partitionBy("conv_id"))
    return table(spark, sf_dir, "conversations").withColumn("cut", cut).filter("cut IS NULL OR turn <= cut").select("conv_id", "turn")


@query("O144 O267", """
SELECT conv_id, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3)::BIGINT AS chunk, turn FROM conversations""")
def fixed_chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fixed_chunks(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], 3).select("conv_id", "chunk", "turn")


@query("O144 O196", """
WITH a AS (SELECT conv_id, list(turn ORDER BY turn) AS t FROM conversations GROUP BY conv_id), c AS (SELECT *, unnest(range(0, (len(t) - 1) // 3 + 1))::INT AS chunk FROM a)
SELECT conv_id, chunk, array_to_string(t[chunk * 3 + 1 : chunk * 3 + 3], ',') AS values, array_to_string(t[greatest(chunk * 3 - 2, 0) + 1 : chunk * 3], ',') AS context FROM c""")  # fmt: skip
def context_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.chunk_context(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "turn", 3, 2)
    return found.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("values", "context")})


@query("O169", """
SELECT conv_id, array_to_string(CASE WHEN len(t) <= 4 THEN t ELSE list_concat(list_concat(t[1:2], ['...']), t[len(t) - 1 : len(t)]) END, ',') AS window
FROM (SELECT conv_id, list(role || turn ORDER BY turn) AS t FROM conversations GROUP BY conv_id)""")  # fmt: skip
def turn_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(x["role"], x["turn"].cast("string")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(named.alias("t")).select("conv_id", F.array_join(R.ends_window(F.col("t"), 4), ",").alias("window"))


@query("O165 O164", "SELECT user_id, string_agg(DISTINCT step_id, ',' ORDER BY step_id) AS steps FROM steps GROUP BY user_id", ("timed", "steps"))
def natural_step_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    number, name = R.natural_step_order(F.col("step_id"))
    ordered = F.transform(F.array_sort(F.collect_set(F.struct(number.alias("n"), name.alias("s")))), lambda x: x["s"])
    return D.steps(spark, sf_dir).groupBy("user_id").agg(F.array_join(ordered, ",").alias("steps"))


@query("O87", "SELECT pct, count(*) AS users FROM (SELECT user_id, floor(100 * count(*) FILTER (event_type = 'view') / count(*))::BIGINT AS pct FROM events GROUP BY user_id) GROUP BY pct")
def percentage_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(R.ratio_histogram(F.count_if(F.col("event_type") == "view"), F.count(F.lit(1))).alias("pct"))
    return per.groupBy("pct").agg(F.count(F.lit(1)).alias("users"))


@query("O171 O172", "SELECT o_custkey, o_orderkey FROM orders EXCEPT SELECT o_custkey, l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'")
def frames_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(li, "o_orderkey", "left_anti").distinct().select("o_custkey", "o_orderkey")


@query("O170 O2", "SELECT 'documents' AS dataset, doc_id AS id, text FROM documents UNION ALL SELECT 'benchmark', item_id, text FROM benchmark")
def union_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda name, key: table(spark, sf_dir, name).select(F.lit(name).alias("dataset"), F.col(key).alias("id"), "text")
    return one("documents", "doc_id").unionByName(one("benchmark", "item_id"))


@query("O297", """
SELECT user_id, event_type, day, (row_number() OVER (PARTITION BY user_id ORDER BY f) - 1)::INT AS idx FROM (SELECT user_id, event_type, floor(time / 86400)::BIGINT AS day, min(event_id) AS f FROM timed GROUP BY ALL)""", ("timed",))  # fmt: skip
def reference_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = D.timed(spark, sf_dir).groupBy("user_id", "event_type", F.floor(F.col("time") / 86400).alias("day")).agg(F.min("event_id").alias("f"))
    return first.select("user_id", "event_type", "day", (F.row_number().over(Window.partitionBy("user_id").orderBy("f")) - 1).alias("idx"))


@query("O15 O162", "SELECT l_orderkey, l_linenumber, (sum(l_quantity::BIGINT) OVER w - l_quantity::BIGINT)::BIGINT AS first, (sum(l_quantity::BIGINT) OVER w)::BIGINT AS last FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)")
def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_quantity").cast("long")
    upto = F.sum(n).over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (upto - n).alias("first"), upto.alias("last"))


@query("O90", """
WITH step AS (SELECT user_id, time FROM timed WHERE event_type = 'view'), talk AS (SELECT *, event_type = 'click' AS asks, lead(event_type) OVER w AS nt, lead(time) OVER w AS nx FROM timed WHERE event_type IN ('click', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY time, event_id)),
p AS (SELECT t.event_id, t.user_id, min(abs(t.time - s.time)) AS d FROM talk t JOIN step s USING (user_id) GROUP BY ALL), r AS (SELECT s.user_id, s.time, min(abs(t.time - s.time)) AS d FROM step s JOIN talk t USING (user_id) GROUP BY ALL),
n AS (SELECT user_id, count(*) FILTER (asks AND nt IS NOT NULL AND (nt <> 'purchase' OR nx - time > 7200)) AS no_resp FROM talk GROUP BY user_id)
SELECT n.user_id, round(pp.d, 4) AS diff_p, round(rr.d, 4) AS diff_r, no_resp, round(10 - (pp.d + rr.d + 0.1 * no_resp), 4) AS score
FROM n JOIN (SELECT user_id, avg(d) AS d FROM p GROUP BY user_id) pp USING (user_id) JOIN (SELECT user_id, avg(d) AS d FROM r GROUP BY user_id) rr USING (user_id)""", ("timed",))  # fmt: skip
def auto_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.timed(spark, sf_dir)
    step = t.filter("event_type = 'view'").select("user_id", F.col("time").alias("st"))
    talk = t.filter(F.col("event_type").isin("click", "purchase")).select("user_id", "event_id", "event_type", "time")
    w = Window.partitionBy("user_id").orderBy("time", "event_id")
    unanswered = (F.col("event_type") == "click") & ((F.lead("event_type").over(w) != "purchase") | (F.lead("time").over(w) - F.col("time") > 7200))
    n = talk.withColumn("u", F.coalesce(unanswered, F.lit(False))).groupBy("user_id").agg(F.count_if("u").alias("no_resp"))
    p = R.nearest(talk, step, ["user_id"], "time", "st").groupBy("user_id").agg(F.avg("distance").alias("p"))
    r = R.nearest(step.distinct(), talk.select("user_id", F.col("time").alias("tt")), ["user_id"], "st", "tt").groupBy("user_id").agg(F.avg("distance").alias("r"))
    met = n.join(p, "user_id").join(r, "user_id").filter("p IS NOT NULL AND r IS NOT NULL")
    return met.select("user_id", F.round("p", 4).alias("diff_p"), F.round("r", 4).alias("diff_r"), "no_resp", F.round(10 - (F.col("p") + F.col("r") + 0.1 * F.col("no_resp")), 4).alias("score"))
