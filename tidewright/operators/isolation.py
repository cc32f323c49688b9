"""Failures kept to the key that they come from, replies parsed with a fallback, and a log of phases."""

from __future__ import annotations

import traceback

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.grouped import Fold, fold_groups
from tidewright.sources.scratch import written


def isolated_fold(df: DataFrame, key: str, order: list[str], columns: list[str], fold: Fold, schema: str, tries: int = 1) -> tuple[DataFrame, DataFrame]:
    """(rows, failures) of *fold* over each key's rows in *order*; a key whose fold raises gives no rows but a failure, and ends nothing else.

    failures: key, reason (the error's class and text), trace (the line that raised it), tries. A fold is tried *tries* times, which helps against
    outside trouble only; each try gets a copy of the rows. The folds run once and are written, so both results are read from the same run. Null keys are one
    key; an empty table gives two empty ones. Rows of a fold must fit *schema*, as with any fold: what can't be converted to it ends the job.
    """
    kind = dict(df.dtypes)[key]
    made = [c.strip().split()[0].strip("`") for c in _split_columns(schema)]

    def guarded(rows: pd.DataFrame) -> pd.DataFrame:
        for n in range(1, tries + 1):
            try:
                out = fold(rows.copy())[made].astype(object)
                return out.where(out.notna(), None).assign(key_=rows[key].iloc[0], reason_=None, trace_=None, tries_=n)
            except Exception as error:  # noqa: BLE001 - any fault of a key is that key's own
                line = traceback.extract_tb(error.__traceback__)[-1]
                failure = {"key_": rows[key].iloc[0], "reason_": f"{type(error).__name__}: {error}", "trace_": f"{line.name}: {line.line}", "tries_": n}
        return pd.DataFrame([dict.fromkeys(made) | failure], dtype=object)

    ran = written(fold_groups(df, key, order, columns, guarded, f"{schema}, key_ {kind}, reason_ string, trace_ string, tries_ int"), "isolated")
    failed = F.col("reason_").isNotNull()
    failures = ran.filter(failed).select(F.col("key_").alias(key), F.col("reason_").alias("reason"), F.col("trace_").alias("trace"), F.col("tries_").alias("tries"))
    return ran.filter(~failed).select(*[f"`{c}`" for c in made]), failures


def _split_columns(schema: str) -> list[str]:
    """The columns of a DDL string, cut at commas that lie in no brackets."""
    out, depth = [""], 0
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def reply_json(reply: Column) -> Column:
    """The JSON of a model's reply: its first fenced block of that kind, else from the first { to the last }, else all of it."""
    fenced = F.split(F.split(reply, "```json", 3)[1], "```", 2)[0]
    braces = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.when(reply.contains("```json"), fenced).when(braces != "", braces).otherwise(reply)


def whole_json(text: Column) -> Column:
    """The JSON value that all of *text* is, else null. The parser stops behind a value, so what follows is found by setting the text in brackets of both kinds."""
    items = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(named.isNotNull() & F.try_variant_get(items, "$[1]", "variant").isNull(), F.try_variant_get(items, "$[0]", "variant"))


def step_decision(reply: Column, steps: Column, best: Column) -> Column:
    """struct(step, confidence, source) of a reply that names a step from 1 and a confidence; steps count from 0.

    Left out, the step is the first and the confidence 0.5; a step outside the *steps* known becomes the first. Blank or null replies give -1 and 0. What is no
    object, or holds a step that is no number or a confidence that can't be read as one, falls back to the *best* alternative with 0.3, or, where that is
    null, to -1 and 0. source: parsed, corrected, fallback, none.
    """
    strict = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"}
    text = F.btrim(reply_json(reply), F.lit(" \t\r\n"))
    parsed = F.from_json(F.when(text.startswith("{") & whole_json(text).isNotNull(), text), "chosen_step double, confidence string, _bad string", strict)
    sure = F.when(parsed["confidence"].isNull(), 0.5).otherwise(parsed["confidence"].try_cast("double"))
    read = parsed.isNotNull() & parsed["_bad"].isNull() & sure.isNotNull()
    step = F.floor(F.coalesce(parsed["chosen_step"], F.lit(1.0)) - 1).cast("int")
    inside = (step >= 0) & (step < steps)
    made = lambda s, c, source: F.struct(s.cast("int").alias("step"), c.cast("double").alias("confidence"), F.lit(source).alias("source"))
    none = made(F.lit(-1), F.lit(0.0), "none")
    fallback = F.when(best.isNotNull(), made(best, F.lit(0.3), "fallback")).otherwise(none)
    blank = reply.isNull() | (F.regexp_replace(reply, r"\s", "") == "")
    return F.when(blank, none).when(read & inside, made(step, sure, "parsed")).when(read, made(F.lit(0), sure, "corrected")).otherwise(fallback)


def step_mapping(reply: Column) -> Column:
    """map<string, array<string>> of a reply that maps steps to segments, by itself or under "mapping"; null where it holds no such object.

    A single segment becomes a list of one; numbers and booleans are written as in JSON, and a JSON null is a null segment.
    """
    tree = whole_json(reply_json(reply))
    kind = lambda v: F.schema_of_variant(v)
    inner = F.try_variant_get(tree, "$.mapping", "variant")
    whole = F.when(kind(tree).startswith("OBJECT") & inner.isNotNull(), inner).when(kind(tree).startswith("OBJECT"), tree)
    entries = F.try_variant_get(F.when(kind(whole).startswith("OBJECT"), whole), "$", "map<string,variant>")
    one = lambda v: F.try_variant_get(v, "$", "string")
    return F.transform_values(entries, lambda _, v: F.when(kind(v).startswith("ARRAY"), F.transform(F.try_variant_get(v, "$", "array<variant>"), one)).otherwise(F.array(one(v))))


def valid_blocks(blocks: DataFrame, start: str, end: str) -> DataFrame:
    """The blocks that start before they end: points and blocks without a start or an end are dropped."""
    return blocks.filter(F.col(start) < F.col(end))


def audit_log(blocks: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """One nested row: what the three phases reduction, construction and validation of *blocks* do, in one pass.

    reduction: blocks, those with start < end, and those merged into one that they overlap or touch. construction: keys with spans, spans, and their mean length.
    validation: spans, violations (an end behind the next start), is_valid. The phases are columns of one window over the rows, not tables of their own, so nothing is
    computed twice, and counts are right after lost tasks too. Nulls in the key are one key. An empty table gives zeros, a null mean and is_valid.
    """
    order = Window.partitionBy(*key).orderBy(F.col("_ok").desc(), start, end)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ok = F.col("_ok")
    marked = blocks.withColumn("_ok", F.coalesce(F.col(start) < F.col(end), F.lit(False)))
    reached = marked.withColumn("_reach", F.max(F.when(ok, F.col(end))).over(before))
    opens = ok & (F.col("_reach").isNull() | (F.col(start) > F.col("_reach")))
    spans = reached.withColumn("_opens", opens).withColumn("_span", F.sum(F.col("_opens").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    one = spans.groupBy(*key, F.when(ok, F.col("_span")).alias("_span")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.when(ok, F.col(start))).alias("_s"), F.max(F.when(ok, F.col(end))).alias("_e")
    )
    some = F.col("_span").isNotNull()
    after = F.lead("_s").over(Window.partitionBy(*key).orderBy(F.col("_span").asc_nulls_last()))
    ruled = one.withColumn("_bad", F.coalesce(some & (F.col("_e") >= after), F.lit(False)))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    count, bad = F.count_if(some), F.count_if("_bad")
    first = F.count_if(some & (F.col("_span") == 1))
    return ruled.agg(
        F.struct(n("_n").alias("blocks"), n(F.when(some, F.col("_n")).otherwise(0)).alias("kept"), n(F.when(some, F.col("_n") - 1).otherwise(0)).alias("merged")).alias("reduction"),
        F.struct(first.alias("keys"), count.alias("spans"), F.avg(F.when(some, F.col("_e") - F.col("_s"))).alias("mean_length")).alias("construction"),
        F.struct(count.alias("spans"), bad.alias("violations"), (bad == 0).alias("is_valid")).alias("validation"),
    )
