"""Constraint checks. Each gives a message per row, null where nothing is wrong, or a table of violations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant", "DST_UPDATE")
#: What an identifier of each level looks like: S1, S1.2, S1.2.a.
ID_PATTERNS = {"step": r"^S[1-9]\d*$", "substep": r"^S[1-9]\d*\.[1-9]\d*$", "action": r"^S[1-9]\d*\.[1-9]\d*\.[a-z]+$"}


def first_error(*checks: tuple[Column, Column | str]) -> Column:
    """The message of the first (condition, message) that holds; null if none does."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), m if isinstance(m, Column) else F.lit(m)) for bad, m in checks], F.lit(None).cast("string"))


def as_result(message: Column) -> Column:
    """struct(valid, message) of an error message."""
    return F.struct(message.isNull().alias("valid"), F.coalesce(message, F.lit("")).alias("message"))


def clip_error(start: Column, end: Column, total: Column) -> Column:
    return first_error((start.isNull() | end.isNull(), "missing bound"), (start < 0, "negative start"), (end > total, "end past the last frame"), (start >= end, "empty clip"))


def turn_error(role: Column, content: Column, updates: bool = True) -> Column:
    """Role and content checks of one turn; state updates are roles only if *updates*."""
    known = ROLES if updates else ROLES[:3]
    return first_error((role.isNull(), "missing role"), (content.isNull(), "missing content"), (~role.isin(*known), F.concat(F.lit("invalid role "), role)))


def sample_error(seq_len: Column, max_len: Column, fps: Column, first_role: Column, turns: Column) -> Column:
    """Checks of a training sample in their order: turns, lengths, rate, system prompt first."""
    return first_error(
        (turns == 0, "empty conversation"), (seq_len.isNull() | (seq_len < 0), "invalid length"), (max_len.isNull() | (max_len <= 0), "invalid limit"), (seq_len > max_len, F.format_string("length %d exceeds %d", seq_len, max_len)), (fps.isNull() | (fps <= 0), "invalid rate"), (first_role != "system", "no system prompt")
    )


def flat_time_checks(df: DataFrame, key: list[str], order: list[str], epsilon: float = 1e-6, regress: float = 10.0) -> DataFrame:
    """*df* with error (end before start) and warning (starts more than *regress* seconds before the latest start so far)."""
    latest = F.max("start_ts").over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumns({"error": first_error((F.col("start_ts").isNull() | F.col("end_ts").isNull(), "not a number"), (F.col("start_ts") > F.col("end_ts") + epsilon, "ends before it starts")), "warning": F.coalesce(F.col("start_ts") < latest - regress, F.lit(False))})


def tree_time_violations(nodes: DataFrame, key: list[str], epsilon: float = 1e-6) -> DataFrame:
    """(key, node_id, kind) of nodes (node_id, parent_id, start_ts, end_ts) that are inverted, leave their parent, or begin before a sibling ends."""
    parents = nodes.select(*key, F.col("node_id").alias("parent_id"), F.col("start_ts").alias("ps"), F.col("end_ts").alias("pe"))
    outside = nodes.join(parents, [*key, "parent_id"]).filter((F.col("start_ts") < F.col("ps") - epsilon) | (F.col("end_ts") > F.col("pe") + epsilon))
    w = Window.partitionBy(*key, "parent_id").orderBy("start_ts", "node_id")
    crowded = nodes.withColumn("_before", F.lag("end_ts").over(w)).filter(F.col("start_ts") < F.col("_before") - epsilon)
    one = lambda df, kind: df.select(*key, "node_id", F.lit(kind).alias("kind"))
    return one(nodes.filter(F.col("start_ts") > F.col("end_ts") + epsilon), "inverted").unionByName(one(outside, "outside parent")).unionByName(one(crowded, "overlaps sibling"))


def id_violations(nodes: DataFrame, key: list[str]) -> DataFrame:
    """(key, node_id, kind): identifiers of a wrong form, under another parent, repeated, or out of the order of their starts."""
    form = F.lit(False)
    for level, pattern in ID_PATTERNS.items():
        form = form | ((F.col("level") == level) & ~F.col("node_id").rlike(pattern))
    one = lambda df, kind: df.select(*key, "node_id", F.lit(kind).alias("kind"))
    stray = nodes.filter(F.col("parent_id").isNotNull() & ~F.col("node_id").startswith(F.concat("parent_id", F.lit("."))))
    again = nodes.groupBy(*key, "node_id").count().filter("count > 1")
    last = F.regexp_extract("node_id", r"(\d+|[a-z]+)$", 1)
    number = F.coalesce(last.try_cast("int"), F.ascii(last))
    most = F.max("_n").over(Window.partitionBy(*key, "parent_id").orderBy("start_ts", "node_id").rowsBetween(Window.unboundedPreceding, -1))
    late = nodes.withColumn("_n", number).withColumn("_m", most).filter("_n <= _m")
    return one(nodes.filter(form), "form").unionByName(one(stray, "parent")).unionByName(one(again, "repeated")).unionByName(one(late, "order"))


def mapping_errors(mapping: DataFrame, key: list[str], segments: str, steps: int) -> DataFrame:
    """(key, missing_steps, repeated_segments, backward): what keeps a mapping segment -> step from being total, single and monotone."""
    w = Window.partitionBy(*key).orderBy(segments)
    marked = mapping.withColumns({"_back": (F.col("step") < F.lag("step").over(w)).cast("int"), "_again": (F.row_number().over(Window.partitionBy(*key, segments).orderBy("step")) > 1).cast("int")})
    return marked.groupBy(*key).agg((F.lit(steps) - F.count_distinct("step")).alias("missing_steps"), F.sum("_again").alias("repeated_segments"), F.coalesce(F.sum("_back"), F.lit(0)).alias("backward"))


def alignment_issues(turns: DataFrame, key: list[str], order: list[str], max_gap: int = 10, max_off: float = 2.0, fps: float = 2.0) -> DataFrame:
    """Turns that begin more than *max_gap* frames after the one before ends, or whose frames' centre is over *max_off* frames from their time."""
    gap = F.col("start_frame") - F.lag("end_frame").over(Window.partitionBy(*key).orderBy(*order))
    off = F.abs((F.col("start_frame") + F.col("end_frame")) / 2 - F.col("time") * fps)
    return turns.withColumns({"_gap": gap, "_off": off}).withColumn("issue", first_error((F.col("_gap") > max_gap, "gap"), (F.col("_off") > max_off, "off centre"))).filter("issue IS NOT NULL").drop("_gap", "_off")


def length_advice(length: Column, most: int) -> Column:
    """What to do about a sequence length: ok, shorten by so much, or split into so many."""
    return F.when(length <= most, "ok").when(length <= most * 1.2, F.concat(F.lit("shorten by "), (length - most).cast("string"))).otherwise(F.concat(F.lit("split into "), F.ceil(length / most).cast("string")))


def missing_fields(df: DataFrame, required: tuple[str, ...]) -> Column:
    """Names of required columns that are absent or null, comma-joined; empty if none is."""
    return F.concat_ws(",", *[F.when(F.col(c).isNull(), c) if c in df.columns else F.lit(c) for c in required])


def parse_errors(texts: DataFrame, key: str, text: str, around: int = 50) -> DataFrame:
    """(key, line, column, message, context, pointer) of texts that are no JSON: where parsing stops, and what stands around that place."""
    import json

    kind = texts.schema[key].dataType.simpleString()

    def run(batches):
        for rows in batches:
            found = []
            for k, t in zip(rows[key], rows[text], strict=True):
                try:
                    json.loads(t or "")
                except json.JSONDecodeError as error:
                    begin = max(0, error.pos - around)
                    found.append((k, error.lineno, error.colno, error.msg, (t or "")[begin : error.pos + around], " " * (error.pos - begin) + "^"))
            yield pd.DataFrame(found, columns=[key, "line", "column", "message", "context", "pointer"])

    return texts.select(key, text).mapInPandas(run, f"`{key}` {kind}, line int, column int, message string, context string, pointer string")
