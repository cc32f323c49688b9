"""Queries over metrics and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import matching as M
from tidewright.operators import metrics as X
from tidewright.plans import derived as D
from tidewright.plans.registry import query
from tidewright.session import table
from tidewright.sources.scratch import written

_FR = ("timed", "frames")
_W = r"list_filter(string_split_regex(coalesce(%s, ''), '[ \t\n\r\f\v]+'), lambda w: w <> '')"


@query("O109 O120", """
WITH c AS (SELECT user_id, count(*) FILTER (ref <> '' AND gen <> '') AS tp, count(*) FILTER (ref = '' AND gen <> '') AS fp, count(*) FILTER (ref <> '' AND gen = '') AS fn, count(*) FILTER (ref = '' AND gen = '') AS tn FROM frames GROUP BY user_id),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r, coalesce(tn / nullif(tn + fp, 0), 0.0) AS s FROM c)
SELECT user_id, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, round((r + s) / 2, 6) AS balanced_accuracy FROM r""", _FR)  # fmt: skip
def binary_frame_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.frames(spark, sf_dir).select("user_id", (F.col("ref") != "").cast("int").alias("t"), (F.col("gen") != "").cast("int").alias("p"))
    found = X.binary_metrics(f, ["user_id"], "t", "p")
    return found.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "balanced_accuracy")})


@query("O110 O74", """
WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY time, event_id) AS k, event_id % 2 AS side FROM steps)
SELECT a.user_id, count(*) AS n, round(avg((a.step_id = b.step_id)::INT), 6) AS step_accuracy, round(avg((a.transition = b.transition)::INT), 6) AS transition_accuracy,
  round(avg((a.step_id = b.step_id AND a.transition = b.transition)::INT), 6) AS exact_accuracy FROM k a JOIN k b ON a.user_id = b.user_id AND a.k = b.k AND a.side = 0 AND b.side = 1 GROUP BY a.user_id""", ("timed", "steps"))  # fmt: skip
def content_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    side = F.col("event_id") % 2
    k = D.steps(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("user_id", side).orderBy("time", "event_id")))
    a = k.filter(side == 0).select("user_id", "k", F.col("step_id").alias("step"), "transition")
    b = k.filter(side == 1).select("user_id", "k", F.col("step_id").alias("ref_step"), F.col("transition").alias("ref_transition"))
    found = X.content_metrics(a.join(b, ["user_id", "k"]), ["user_id"])
    return found.withColumns({c: F.round(c, 6) for c in ("step_accuracy", "transition_accuracy", "exact_accuracy")})


@query("O72 O222", """
SELECT a.user_id, a.frame AS gen_frame, b.frame AS ref_frame, 1.0::DOUBLE AS text_cost, round(1.0 + pow(abs(b.frame - a.frame), 1.5) * (0.2 / pow(4, 1.5)), 6) AS cost, b.ref = '' AS silent
FROM frames a JOIN frames b ON a.user_id = b.user_id AND a.gen <> '' AND b.frame BETWEEN a.frame - 4 AND a.frame + 2""", _FR)  # fmt: skip
def match_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.match_candidates(D.frames(spark, sf_dir), ["user_id"], (-4, 2)).withColumn("cost", F.round("cost", 6))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames where what is said in both columns has a word in common."""
    f = D.frames(spark, sf_dir)
    return f.withColumn("ref", F.when(F.col("ref") != "", "view click").otherwise(""))


@query("O73")
def match_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.match_assign(M.match_candidates(_frames(spark, sf_dir), ["user_id"], (-4, 2)), "user_id", (-4, 2))


@query("O107 O53 O247")
def turn_taking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir)
    matches = written(M.match_assign(M.match_candidates(f, ["user_id"], (-4, 2)), "user_id", (-4, 2)), "matches")  # read twice
    return M.turn_taking(f, matches, ["user_id"], 2.0, 0.4)


_PAIRS = """pairs AS (SELECT d.doc_id, d.text AS hyp, b.text AS ref FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 97)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the item whose key their own leaves over 97. However large the benchmark, its items with such keys are few, so they are sent to the documents, which aren't shuffled."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("hyp"), (F.col("doc_id") % 97).alias("item_id"))
    items = table(spark, sf_dir, "benchmark").filter(F.col("item_id").between(-96, 96)).select("item_id", F.col("text").alias("ref"))
    return d.join(F.broadcast(items), "item_id")


@query("O113 O272 O47", f"""
WITH {_PAIRS}, w AS (SELECT doc_id, {_W % 'hyp'} AS h, {_W % 'ref'} AS r FROM pairs),
h AS (SELECT doc_id, n, array_to_string(h[i : i + n - 1], ' ') AS g, count(*) AS c FROM (SELECT doc_id, h, n, unnest(range(1, greatest(len(h) - n + 2, 1))) AS i FROM w, range(1, 5) AS t(n)) GROUP BY ALL),
r AS (SELECT doc_id, n, array_to_string(r[i : i + n - 1], ' ') AS g, count(*) AS c FROM (SELECT doc_id, r, n, unnest(range(1, greatest(len(r) - n + 2, 1))) AS i FROM w, range(1, 5) AS t(n)) GROUP BY ALL),
m AS (SELECT h.n, sum(least(h.c, r.c)) AS hit FROM h JOIN r USING (doc_id, n, g) GROUP BY h.n),
q AS (SELECT n, (coalesce((SELECT hit FROM m WHERE m.n = t.n), 0) + 1e-15) / ((SELECT sum(greatest(len(h) - n + 1, 0)) FROM w) + 1e-9) AS p FROM range(1, 5) AS t(n)),
b AS (SELECT CASE WHEN x < 1 THEN exp(1 - 1 / x) ELSE 1 END AS bp FROM (SELECT (sum(len(h)) + 1e-15) / (sum(len(r)) + 1e-9) AS x FROM w))
SELECT round(exp(sum(ln(p)) FILTER (n <= 1)) * any_value(bp), 6) AS bleu_1, round(exp(sum(ln(p)) FILTER (n <= 2) / 2) * any_value(bp), 6) AS bleu_2,
  round(exp(sum(ln(p)) FILTER (n <= 3) / 3) * any_value(bp), 6) AS bleu_3, round(exp(sum(ln(p)) / 4) * any_value(bp), 6) AS bleu_4 FROM q, b""")  # fmt: skip
def bleu_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.bleu(_pairs(spark, sf_dir), "doc_id", "hyp", "ref")
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query("O114", f"""
WITH {_PAIRS}, w AS (SELECT doc_id, {_W % 'hyp'} AS h, {_W % 'ref'} AS r FROM pairs),
h AS (SELECT doc_id, n, array_to_string(h[i : i + n - 1], ' ') AS g, count(*) AS c FROM (SELECT doc_id, h, n, unnest(range(1, greatest(len(h) - n + 2, 1))) AS i FROM w, range(1, 5) AS t(n)) GROUP BY ALL),
r AS (SELECT doc_id, n, array_to_string(r[i : i + n - 1], ' ') AS g, count(*) AS c FROM (SELECT doc_id, r, n, unnest(range(1, greatest(len(r) - n + 2, 1))) AS i FROM w, range(1, 5) AS t(n)) GROUP BY ALL),
df AS (SELECT n, g, count(*) AS df FROM r GROUP BY ALL), z AS (SELECT ln(count(*)) AS z FROM w),
hw AS (SELECT h.doc_id, h.n, h.g, h.c * (z - ln(greatest(coalesce(df, 1), 1))) AS w FROM h LEFT JOIN df USING (n, g), z), rw AS (SELECT r.doc_id, r.n, r.g, r.c * (z - ln(greatest(df, 1))) AS w FROM r JOIN df USING (n, g), z),
hn AS (SELECT doc_id, n, sqrt(sum(w * w)) AS x FROM hw GROUP BY ALL), rn AS (SELECT doc_id, n, sqrt(sum(w * w)) AS x FROM rw GROUP BY ALL),
d AS (SELECT hw.doc_id, hw.n, sum(least(hw.w, rw.w) * rw.w) AS dot FROM hw JOIN rw USING (doc_id, n, g) GROUP BY ALL),
s AS (SELECT d.doc_id, sum(CASE WHEN hn.x <> 0 AND rn.x <> 0 THEN dot / (hn.x * rn.x) ELSE dot END) AS s FROM d JOIN hn USING (doc_id, n) JOIN rn USING (doc_id, n) GROUP BY d.doc_id)
SELECT w.doc_id, round(coalesce(s, 0) * exp(-pow(greatest(len(h) - 1, 0) - greatest(len(r) - 1, 0), 2) / 72.0) / 4 * 10, 6) AS cider FROM w LEFT JOIN s USING (doc_id)""")  # fmt: skip
def cider_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.cider(_pairs(spark, sf_dir), "doc_id", "hyp", "ref").withColumn("cider", F.round("cider", 6))


@query("O115 O272 O47")
def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """METEOR by exact words only: its stems and synonyms need data that isn't here."""
    return X.text_scores(_pairs(spark, sf_dir), "doc_id", "hyp", "ref", ("bleu", "meteor", "unknown")).withColumn("value", F.round("value", 6))


@query("O153", """
SELECT l_orderkey, l_linenumber, round(0.6 * CASE WHEN min(l_quantity) OVER w < max(l_quantity) OVER w THEN (l_quantity - avg(l_quantity) OVER w) / stddev_pop(l_quantity) OVER w ELSE l_quantity END +
  0.4 * CASE WHEN min(l_discount) OVER w < max(l_discount) OVER w THEN (l_discount - avg(l_discount) OVER w) / stddev_pop(l_discount) OVER w ELSE l_discount END, 4) + 0.0 AS fused
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""")  # fmt: skip
def zscore_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return X.zscore_fusion(li, ["l_orderkey"], "l_quantity", "l_discount").select("l_orderkey", "l_linenumber", (F.round("fused", 4) + 0.0).alias("fused"))


@query("O154", """
SELECT user_id, round(1 / sum(exp(value / 100 - m)), 6) AS confidence, 1 / sum(exp(value / 100 - m)) >= 0.05 AS is_clear FROM (SELECT *, max(value / 100) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id""")
def softmax_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", (F.col("value") / 100).alias("s"))
    return X.softmax_confidence(e, ["user_id"], "s", 0.05).withColumn("confidence", F.round("confidence", 6))


@query("O168 O292", """
SELECT user_id, event_type, list_position(s, list_max(s))::INT - 1 AS best, round(0.7 / (1 + exp(-5 * CASE WHEN list_max(s) > list_min(s) THEN (list_sort(s, 'DESC')[1] - list_sort(s, 'DESC')[2]) / (list_max(s) - list_min(s)) ELSE 1 END)) +
  CASE WHEN list_max(s) > list_min(s) THEN 0.3 ELSE 0 END, 6) AS confidence FROM (SELECT user_id, event_type, list(value ORDER BY event_id) AS s FROM events GROUP BY ALL) WHERE len(s) >= 2""")  # fmt: skip
def argmax_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.best_of_groups(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", "value").filter("n >= 2")
    return found.select("user_id", "event_type", "best", F.round("confidence", 6).alias("confidence"))


@query("O102 O103", """
SELECT count(*) AS total, count(*) FILTER (value > 50) AS clear, count(*) FILTER (value <= 50) AS ambiguous, round(count(*) FILTER (value > 50) * 100 / count(*), 4) AS clear_pct, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std,
  min(value) AS least, max(value) AS most, round(median(value), 4) AS median FROM events""")  # fmt: skip
def similarity_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("clear", F.col("value") > 50)
    found = X.similarity_statistics(e, "value", "clear")
    return found.withColumns({c: F.round(c, 4) for c in ("clear_pct", "mean", "std", "median")})


@query("O112 O111", """
SELECT event_type, round(avg(m), 6) AS value FROM (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY ALL) GROUP BY event_type""")
def judge_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.two_level_mean(table(spark, sf_dir, "events"), ["event_type"], ["user_id"], "value").withColumn("value", F.round("value", 6))


# each block's scores over the steps that its user has, by place
_BLOCKS = """v AS (SELECT user_id, floor(time / 86400)::BIGINT AS block, event_id % 6 AS step, sum(value) AS score FROM timed GROUP BY ALL),
st AS (SELECT user_id, step, row_number() OVER (PARTITION BY user_id ORDER BY step) AS j FROM (SELECT DISTINCT user_id, step FROM v)),
bl AS (SELECT user_id, block, row_number() OVER (PARTITION BY user_id ORDER BY block) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT DISTINCT user_id, block FROM v)),
x AS (SELECT bl.user_id, bl.block, i, n, list(coalesce(score, 0.0) ORDER BY j) AS s, list(st.step ORDER BY j) AS steps, count(*) AS m FROM bl JOIN st USING (user_id) LEFT JOIN v ON v.user_id = bl.user_id AND v.block = bl.block AND v.step = st.step GROUP BY ALL)"""


@query("O148 O278 O152", f"""
WITH RECURSIVE {_BLOCKS},
w AS (SELECT user_id, i, n, list_transform(range(1, m + 1), lambda j: CASE WHEN j = 1 THEN s[1] ELSE -1e300 END) AS best, list_transform(range(1, m + 1), lambda j: [j]) AS paths FROM x WHERE i = 1 UNION ALL
  SELECT x.user_id, x.i, x.n, list_transform(range(1, x.m + 1), lambda j: greatest(w.best[j], CASE WHEN j > 1 THEN w.best[j - 1] ELSE -1e300 END) + x.s[j]),
    list_transform(range(1, x.m + 1), lambda j: list_append(CASE WHEN j > 1 AND w.best[j - 1] > w.best[j] THEN w.paths[j - 1] ELSE w.paths[j] END, j)) FROM w JOIN x ON x.user_id = w.user_id AND x.i = w.i + 1),
e AS (SELECT user_id, paths[list_position(best, list_max(best))] AS path FROM w WHERE i = n)
SELECT x.user_id, x.block, x.steps[e.path[x.i]] AS step FROM x JOIN e USING (user_id)""", ("timed",))  # fmt: skip
def monotonic_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.align_blocks(_scores(spark, sf_dir), "user_id", "dp")


@query("O151 O295", f"""
WITH RECURSIVE {_BLOCKS},
f AS (SELECT user_id, i, 1::BIGINT AS j FROM x WHERE i = 1 UNION ALL SELECT x.user_id, x.i, CASE WHEN f.j + 1 <= x.m AND x.s[f.j + 1] > x.s[f.j] THEN f.j + 1 ELSE f.j END FROM f JOIN x ON x.user_id = f.user_id AND x.i = f.i + 1),
b AS (SELECT user_id, i, m AS j FROM x WHERE i = n UNION ALL SELECT x.user_id, x.i, CASE WHEN b.j > 1 AND x.s[b.j - 1] > x.s[b.j] THEN b.j - 1 ELSE b.j END FROM b JOIN x ON x.user_id = b.user_id AND x.i = b.i - 1)
SELECT x.user_id, x.block, CASE WHEN x.s[b.j] > x.s[f.j] THEN x.steps[b.j] ELSE x.steps[f.j] END AS step, round(greatest(x.s[f.j], x.s[b.j]), 4) AS confidence, f.j <> b.j AS conflict
FROM x JOIN f ON f.user_id = x.user_id AND f.i = x.i JOIN b ON b.user_id = x.user_id AND b.i = x.i""", ("timed",))  # fmt: skip
def greedy_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores(spark, sf_dir)
    conf = s.withColumnRenamed("score", "confidence")
    side = lambda how: M.align_blocks(s, "user_id", how).join(conf, ["user_id", "block", "step"], "left").na.fill(0.0, ["confidence"])
    return M.resolve_conflicts(side("forward"), side("backward"), ["user_id", "block"]).withColumn("confidence", F.round("confidence", 4))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, block, step, score): how well each day's blocks fit each of six steps."""
    t = D.timed(spark, sf_dir).withColumn("block", F.floor(F.col("time") / 86400))
    return t.groupBy("user_id", "block", (F.col("event_id") % 6).alias("step")).agg(F.sum("value").alias("score"))
