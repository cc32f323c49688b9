"""Model-backed steps as vectorised functions with retry rounds. The model is a parameter; a deterministic stub stands in offline."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.sources.scratch import written

Model = Callable[[list[str]], list[str | None]]


def stub_model(prompts: list[str]) -> list[str | None]:
    """Answers made of the prompt alone; about one in eight fails the first time it is asked."""
    out: list[str | None] = []
    for p in prompts:
        h = md5(p.encode()).hexdigest()
        out.append(None if h[0] in "01" and "(again)" not in p else f"answer {h[:8]}")
    return out


def generate(items: DataFrame, prompt: str, model: Model = stub_model, samples: int = 1) -> DataFrame:
    """*items* with ok and texts (array of *samples* answers); a failed answer makes the row not ok."""
    kinds = [f"`{c}` {t}" for c, t in items.dtypes if c not in ("ok", "texts")]
    items = items.drop("ok", "texts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            prompts = rows[prompt].tolist()
            answers = model([p if k == 0 else f"{p} #{k}" for p in prompts for k in range(samples)])  # the whole batch in one call
            texts = [answers[j * samples : (j + 1) * samples] for j in range(len(prompts))]
            yield rows.assign(ok=[None not in t for t in texts], texts=[[x for x in t if x is not None] for t in texts])

    return items.mapInPandas(run, ", ".join([*kinds, "ok boolean", "texts array<string>"]))


def generate_with_retries(items: DataFrame, prompt: str, model: Model = stub_model, rounds: int = 3, valid: str = "true", guidance: str | None = None) -> DataFrame:
    """*items* with ok, text and tries: rows that fail, or whose text isn't *valid* (SQL), are asked again, up to *rounds* times.

    A repeated prompt says so, and holds the column *guidance*, if that is given: help for the model that is never returned itself.
    Each round is written to the shared folder, so a prompt is sent once a round, however its answers are read.
    """
    todo, done = items.withColumn("_prompt", F.col(prompt)), []
    columns = items.columns
    for n in range(1, rounds + 1):
        asked = generate(todo, "_prompt", model).withColumn("text", F.try_element_at("texts", F.lit(1))).withColumn("tries", F.lit(n))
        asked = written(asked, f"round-{n}")
        good = F.col("ok") & F.expr(valid)
        if n < rounds:
            done.append(asked.filter(good).select(*columns, F.lit(True).alias("ok"), "text", "tries"))
            todo = asked.filter(~good).withColumn("_prompt", F.concat_ws(" ", "_prompt", F.lit("(again)"), *([F.col(guidance)] if guidance and n == 1 else []))).select(*columns, "_prompt")
        else:
            done.append(asked.select(*columns, good.alias("ok"), F.when(good, F.col("text")).alias("text"), "tries"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def map_spans(items: DataFrame, key: str, model: Model, rounds: int = 3) -> DataFrame:
    """(key, mapping, tries) by a model that maps *blocks* to *steps* (numbers of each): an array with each block's step, from 1.

    An answer counts if it is a JSON array with a step of each block that never falls and uses every step. A rejected prompt is sent again with a
    mapping that steps evenly through both, from either end, as guidance; the guidance is never returned. A row that is still wrong after the
    last round has no mapping.
    """
    even = F.transform(F.sequence(F.lit(1), F.col("blocks").cast("int")), lambda i: F.ceil(i * F.col("steps") / F.col("blocks")).cast("int"))
    back = F.transform(F.sequence(F.lit(1), F.col("blocks").cast("int")), lambda i: (F.floor((i - 1) * F.col("steps") / F.col("blocks")) + 1).cast("int"))
    told = F.concat_ws(" ", F.lit("forward"), F.to_json(even), F.lit("backward"), F.to_json(back))
    prompt = F.concat_ws(" ", F.lit("map"), F.col("blocks").cast("string"), F.lit("blocks to"), F.col("steps").cast("string"), F.lit("steps of"), F.col(key).cast("string"))
    parsed = "from_json(text, 'array<int>')"
    rising = f"forall(sequence(2, greatest(blocks, 2)), i -> blocks < 2 OR element_at({parsed}, cast(i AS int)) >= element_at({parsed}, cast(i - 1 AS int)))"
    valid = f"coalesce(size({parsed}) = blocks AND array_size(array_distinct({parsed})) = steps AND array_min({parsed}) = 1 AND array_max({parsed}) = steps AND {rising}, false)"
    asked = generate_with_retries(items.withColumns({"_told": told, "_ask": prompt}), "_ask", model, rounds, valid, "_told")
    return asked.select(key, F.when(F.col("ok"), F.expr(parsed)).alias("mapping"), "tries")


def break_ties(choices: DataFrame, key: list[str], model: Model | None = None) -> DataFrame:
    """(key, step): of each key's choices (step, confidence) the most confident, the smallest step of equals; a model may answer instead."""
    best = choices.groupBy(*key).agg(F.max_by("step", F.struct("confidence", -F.col("step"))).alias("step"), F.concat_ws(",", F.sort_array(F.collect_list(F.col("step").cast("string")))).alias("_p"))
    if model is None:
        return best.drop("_p")
    asked = generate(best, "_p", model)
    return asked.select(*key, F.coalesce(F.try_element_at("texts", F.lit(1)).try_cast("long"), F.col("step")).alias("step"))


def dialogue_by_clip(clips: DataFrame, user_types: list[str], model: Model = stub_model) -> DataFrame:
    """(video_id, user_type, clip, time, text): a turn for each clip and user type, at the clip's end; types may be written type@n."""
    kinds = [t.split("@")[0] for t in user_types for _ in range(int(t.split("@")[1]) if "@" in t else 1)]
    asked = clips.withColumn("user_type", F.explode(F.array(*map(F.lit, dict.fromkeys(kinds))))).withColumn("prompt", F.concat_ws("|", "video_id", "user_type", F.col("clip").cast("string"), "description"))
    made = generate_with_retries(asked, "prompt", model)
    return made.filter("ok").select("video_id", "user_type", "clip", F.col("end_ts").alias("time"), "text")
