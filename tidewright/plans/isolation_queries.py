"""Isolated failures, parsed replies, valid blocks, the log of phases, and blocks scored against steps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import isolation as I
from tidewright.operators.tiles import tile_scores
from tidewright.plans import derived as D
from tidewright.plans.registry import query
from tidewright.session import table


@query("O274 O27", """
SELECT conv_id, CASE WHEN bad IS NULL THEN n END AS turns, CASE WHEN bad IS NULL THEN words END AS words, CASE WHEN bad IS NOT NULL THEN 'ValueError: turn ' || bad || ' is too short' END AS reason, 
  CASE WHEN bad IS NOT NULL THEN 2 END::INT AS tries FROM (SELECT conv_id, count(*) AS n, sum(len(regexp_extract_all(text, '[^ ]+')))::BIGINT AS words, min(CASE WHEN length(text) < 25 THEN turn END) AS bad FROM conversations GROUP BY conv_id)""")  # fmt: skip
def isolated_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation with a turn below 25 characters fails and loses only itself."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        for turn, text in zip(rows["turn"], rows["text"], strict=True):
            if len(text) < 25:
                raise ValueError(f"turn {turn} is too short")
        return pd.DataFrame({"conv_id": rows["conv_id"].iloc[:1], "turns": len(rows), "words": sum(len([w for w in t.split(" ") if w]) for t in rows["text"])})

    rows, failures = I.isolated_fold(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], ["text"], fold, "conv_id long, turns long, words long", tries=2)
    failed = failures.select("conv_id", F.lit(None).cast("long").alias("turns"), F.lit(None).cast("long").alias("words"), "reason", "tries")
    return rows.select("*", F.lit(None).cast("string").alias("reason"), F.lit(None).cast("int").alias("tries")).unionByName(failed)


def _replies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    """Events with a reply of one of eight shapes, made of the number in their props."""
    k = F.get_json_object("props", "$.k")
    say = lambda form: F.format_string(form, k)
    shapes = [
        say('{"chosen_step": %s, "confidence": 0.75}'), say('Sure.\n```json\n{"chosen_step": %s}\n```\nDone.'), say('I take {"chosen_step": %s, "confidence": "0.9", "reasoning": "it fits"} here'), say("step %s"),
        F.lit("  "), say('{"chosen_step": "%s", "confidence": 0.75'), say('{"confidence": "high %s"}'), F.lit('{"confidence": 1}'),
    ]
    pick = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        pick = F.when(F.col("event_id") % 8 == i, shape).otherwise(pick)
    return table(spark, sf_dir, "events"), pick


@query("O293", """
SELECT event_id, (CASE WHEN shape = 4 THEN -1 WHEN shape IN (3, 5, 6) THEN CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id % 60 END WHEN shape = 7 THEN 0 WHEN k BETWEEN 1 AND 60 THEN k - 1 ELSE 0 END)::INT AS step,
  CASE WHEN shape = 4 THEN 0 WHEN shape IN (3, 5, 6) THEN CASE WHEN event_id % 3 = 0 THEN 0 ELSE 0.3 END WHEN shape = 0 THEN 0.75 WHEN shape = 1 THEN 0.5 WHEN shape = 2 THEN 0.9 ELSE 1 END::DOUBLE AS confidence,
  CASE WHEN shape = 4 THEN 'none' WHEN shape IN (3, 5, 6) THEN CASE WHEN event_id % 3 = 0 THEN 'none' ELSE 'fallback' END WHEN shape = 7 OR k BETWEEN 1 AND 60 THEN 'parsed' ELSE 'corrected' END AS source
FROM (SELECT event_id, user_id, event_id % 8 AS shape, (props->>'k')::BIGINT AS k FROM events)""")  # fmt: skip
def step_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, reply = _replies(spark, sf_dir)
    best = F.when(F.col("event_id") % 3 != 0, F.col("user_id") % 60)
    return events.select("event_id", I.step_decision(reply, F.lit(60), best).alias("d")).select("event_id", "d.*")


@query("O294", """
SELECT event_id, step, array_to_string(segments, ',') AS segments FROM (
  SELECT event_id, 'S' || (k % 7) AS step, CASE WHEN event_id % 3 = 0 THEN [event_id::VARCHAR] ELSE [event_id::VARCHAR, 'b' || k] END AS segments FROM (SELECT event_id, (props->>'k')::BIGINT AS k FROM events) WHERE event_id % 4 <> 3
  UNION ALL SELECT event_id, '9', ['x'] FROM events WHERE event_id % 4 <> 3)""")  # fmt: skip
def step_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, e = F.get_json_object("props", "$.k"), F.col("event_id").cast("string")
    lists = F.when(F.col("event_id") % 3 == 0, e).otherwise(F.concat(F.lit("["), e, F.lit(', "b'), k, F.lit('"]')))
    body = F.concat(F.lit('{"S'), (k.cast("long") % 7).cast("string"), F.lit('": '), lists, F.lit(', "9": "x"}'))
    shape = F.col("event_id") % 4
    reply = F.when(shape == 0, body).when(shape == 1, F.concat(F.lit('{"mapping": '), body, F.lit("}"))).when(shape == 2, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit('{"mapping": '), body))
    found = table(spark, sf_dir, "events").select("event_id", F.explode(I.step_mapping(reply)).alias("step", "segments"))
    return found.withColumn("segments", F.array_join("segments", ","))


@query("O291", "SELECT user_id, event_id, start_ts, end_ts FROM blocks WHERE start_ts < end_ts", ("timed", "blocks"))
def valid_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.valid_blocks(D.blocks(spark, sf_dir), "start_ts", "end_ts").select("user_id", "event_id", "start_ts", "end_ts")


@query("O280", """
SELECT (SELECT count(*) FROM blocks)::BIGINT AS blocks, sum(n)::BIGINT AS kept, sum(n - 1)::BIGINT AS merged, count(DISTINCT user_id) AS keys, count(*) AS spans, round(avg(e - s), 3) AS mean_length, 0::BIGINT AS violations, true AS is_valid FROM (
  SELECT user_id, count(*) AS n, min(start_ts) AS s, max(end_ts) AS e FROM (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY start_ts, end_ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, coalesce(start_ts > max(end_ts) OVER (PARTITION BY user_id ORDER BY start_ts, end_ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS o FROM blocks WHERE start_ts < end_ts)) GROUP BY user_id, g)""", ("timed", "blocks"))  # fmt: skip
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.audit_log(D.blocks(spark, sf_dir), ["user_id"], "start_ts", "end_ts")
    return found.select("reduction.*", "construction.keys", "construction.spans", F.round("construction.mean_length", 3).alias("mean_length"), "validation.violations", "validation.is_valid")


@query("O254", """
SELECT label, block, rank::INT AS rank, step, round(semantic, 6) AS semantic, round(entail, 6) AS entail, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY label, block ORDER BY score DESC, step) AS rank FROM (
    SELECT *, round(0.6 * semantic + 0.4 * entail, 12) AS score FROM (
      SELECT label, block, step, semantic, (dot - min(dot) OVER w) / (max(dot) OVER w - min(dot) OVER w + 1e-8) AS entail FROM (
        SELECT a.label, a.vec_id AS block, b.vec_id AS step, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS semantic, list_inner_product(a.embedding[1:16]::DOUBLE[], b.embedding[17:32]::DOUBLE[]) AS dot
        FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id % 50 = 0) WINDOW w AS (PARTITION BY label)))) WHERE rank <= 3""")  # fmt: skip
def block_step_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors against the steps of their label; the steps are the rows whose id is divisible by 50, the two halves stand for an entailment model's towers."""
    v = table(spark, sf_dir, "embeddings")
    blocks = v.select("label", F.col("vec_id").alias("block"), F.col("embedding").alias("vector"), F.slice("embedding", 1, 16).alias("premise"))
    steps = v.filter("vec_id % 50 = 0").select("label", F.col("vec_id").alias("step"), F.col("embedding").alias("vector"), F.slice("embedding", 17, 16).alias("hypothesis"))
    scored = tile_scores(blocks, steps, "label")
    return scored.select("label", "block", "rank", "step", *[(F.round(c, 6) + 0.0).alias(c) for c in ("semantic", "entail", "score")])
