"""Step states: replay of transitions, state as of a time or a turn, validity of transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a transition does to a step's state.
RESULT = {"start": "in_progress", "complete": "completed"}
EXTENDED_RESULT = RESULT | {"pause": "paused", "resume": "in_progress", "cancel": "cancelled", "reset": "not_started", "fail": "failed"}


def state_after(transition: Column, results: dict[str, str] = RESULT) -> Column:
    """The state that a transition leads to; null for one that changes nothing."""
    out = F.lit(None).cast("string")
    for k, v in results.items():
        out = F.when(transition == k, v).otherwise(out)
    return out


def state_history(steps: DataFrame, key: list[str], order: list[str], results: dict[str, str] = RESULT) -> DataFrame:
    """After each transition, all steps of the key seen so far with their states, as "S1:completed,S2:in_progress".

    Each row meets the distinct steps of its key, as many as its state may name, and the last state of each is carried forward.
    """
    ranked = steps.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    state = state_after(F.col("transition"), results)
    named = ranked.filter(state.isNotNull()).select(*key, F.col("step_id").alias("_s")).distinct()
    carried = F.last(F.when(F.col("step_id") == F.col("_s"), state), ignorenulls=True)
    w = Window.partitionBy(*key, "_s").orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    seen = ranked.join(named, key, "left").withColumn("_state", carried.over(w))
    text = F.array_join(F.array_sort(F.collect_list(F.when(F.col("_state").isNotNull(), F.concat_ws(":", "_s", "_state")))), ",")
    return seen.groupBy(*key, *order, "step_id", "transition", "_rank").agg(text.alias("state")).drop("_rank")


def state_as_of(probes: DataFrame, steps: DataFrame, key: list[str], probe_time: str, order: list[str], results: dict[str, str] = RESULT) -> DataFrame:
    """For each probe, each step's state after the last transition at or before the probe's time.

    Each probe meets the distinct steps of its key, as many as its answer may name. Probes and transitions of a step are then sorted
    together by time, and the last state is carried forward: no probe meets the transitions themselves.
    """
    moves = steps.withColumn("_state", state_after(F.col("transition"), results)).filter("_state IS NOT NULL")
    asked = probes.join(moves.select(*key, "step_id").distinct(), key).withColumns({"_t": F.col(probe_time), "_probe": F.lit(1)})
    made = moves.select(*key, "step_id", "_state", *[F.col(c).alias("_t" if j == 0 else f"_o{j}") for j, c in enumerate(order)], F.lit(0).alias("_probe"))
    w = Window.partitionBy(*key, "step_id").orderBy("_t", "_probe", *[f"_o{j}" for j in range(1, len(order))]).rowsBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(made, allowMissingColumns=True).withColumn("state", F.last("_state", ignorenulls=True).over(w))
    return both.filter("_probe = 1 AND state IS NOT NULL").select(*probes.columns, "step_id", "state")


def transition_validity(steps: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Each start or complete with the step's state before it: a start needs not_started, a complete in_progress.

    Invalid transitions count as made all the same.
    """
    w = Window.partitionBy(*key, "step_id").orderBy(*order)
    moves = steps.withColumn("_state", state_after(F.col("transition"))).filter("_state IS NOT NULL")
    seen = moves.withColumn("before", F.coalesce(F.lag("_state").over(w), F.lit("not_started")))
    need = F.when(F.col("transition") == "start", "not_started").otherwise("in_progress")
    return seen.withColumn("valid", F.col("before") == need).drop("_state")


def state_at_rank(steps: DataFrame, key: list[str], order: list[str], split: Column) -> DataFrame:
    """Every step of a key with its state before the transition of rank *split* (from 0); not_started where it has none by then."""
    ranked = steps.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)
    total = ranked.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    state = state_after(F.col("transition"))
    by_then = (F.col("_rank") < split) & state.isNotNull()
    return total.groupBy(*key, "step_id").agg(F.coalesce(F.max_by(F.when(by_then, state), F.when(by_then, F.col("_rank"))), F.lit("not_started")).alias("state"))


def state_summary(steps: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Transitions, distinct steps, the time line, and the last state of each step."""
    state = state_after(F.col("transition"))
    last = steps.withColumn("_state", state).groupBy(*key, "step_id").agg(F.max_by("_state", F.when(F.col("_state").isNotNull(), F.struct(*order))).alias("_last"), F.count(F.lit(1)).alias("_n"))
    final = F.array_join(F.array_sort(F.collect_list(F.when(F.col("_last").isNotNull(), F.concat_ws(":", "step_id", "_last")))), ",")
    return last.groupBy(*key).agg(F.sum("_n").alias("transitions"), F.count(F.lit(1)).alias("steps"), final.alias("final_state"))


def spans_to_events(spans: DataFrame, key: list[str], existing: DataFrame | None = None) -> DataFrame:
    """A start event for each span, and a complete one where it ends after it starts; events that exist already are left out."""
    made = spans.select(*key, F.explode(F.array(F.struct(F.lit("start").alias("transition"), F.col("start_ts").alias("time")), F.struct(F.lit("complete").alias("transition"), F.when(F.col("end_ts") > F.col("start_ts"), F.col("end_ts")).alias("time")))).alias("e"), "step_id")
    events = made.select(*key, "step_id", "e.transition", "e.time").filter("time IS NOT NULL").distinct()
    return events if existing is None else events.join(existing.select(*key, "step_id", "transition", "time"), [*key, "step_id", "transition", "time"], "left_anti")


def last_value_forward(df: DataFrame, key: list[str], order: list[str], value: str, into: str) -> DataFrame:
    """The last non-null *value* at or before each row."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(into, F.last(value, ignorenulls=True).over(w))
