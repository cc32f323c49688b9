"""Stateful stream operators, keyed so that state and work spread over keys.

Each takes a streaming (or static) DataFrame and gives rows in append mode. Within a micro-batch a key's rows are put in order of
event time; across batches the source must deliver a key in order, as a log per video does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_RESULT = {"start": "in_progress", "complete": "completed"}
#: What to do when a context is full.
POLICIES = ("none", "drop_all", "drop_middle", "summarize", "summarize_with_dst")


def replay_states(steps: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, *order, step_id, transition, state): all steps' states after each transition, as text "S1:completed,..."."""
    kinds = dict(steps.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in [key, *order, "step_id", "transition"]]) + ", state string"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(x.split(":") for x in state.get[0].split(",") if x) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values(order)
        texts = []
        for step, move in zip(rows["step_id"], rows["transition"], strict=True):
            if move in _RESULT:
                held[step] = _RESULT[move]
            texts.append(",".join(f"{s}:{held[s]}" for s in sorted(held)))
        state.update((texts[-1],))
        yield rows[[key, *order, "step_id", "transition"]].assign(state=texts)

    return steps.groupBy(key).applyInPandasWithState(run, schema, "held string", "append", GroupStateTimeout.NoTimeout)


def changes(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, *order, value) of rows whose value differs from the one before; the first row of a key counts."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [key, *order, value])

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order)
        before = rows[value].shift()
        if state.exists:
            before.iloc[0] = state.get[0]
        state.update((rows[value].iloc[-1],))
        yield rows[(rows[value] != before).to_numpy()][[key, *order, value]]

    return df.groupBy(key).applyInPandasWithState(run, schema, "before string", "append", GroupStateTimeout.NoTimeout)


def overflow(costs: list[int], policy: str, most: int, reserve: int = 0, head: int = 1, tail: int = 2, summary: int = 20, states: int = 0) -> list[int]:
    """What is left of a context of items with *costs* once it reaches *most* less *reserve*.

    none keeps all; drop_all drops all; drop_middle keeps the first *head* and last *tail* items; summarize puts one item of cost
    *summary* in the place of all; summarize_with_dst adds the cost of the steps' *states* to it.
    """
    if policy not in POLICIES:
        raise ValueError(f"{policy} is none of {', '.join(POLICIES)}")
    if policy == "none" or sum(costs) < most - reserve:
        return costs
    if policy == "drop_all":
        return []
    if policy == "drop_middle":
        return costs if len(costs) <= head + tail else costs[:head] + costs[-tail:]
    return [summary + (states if policy == "summarize_with_dst" else 0)]


def context_sizes(items: DataFrame, key: str, order: str, cost: str, policy: str, most: int, states: str | None = None) -> DataFrame:
    """(key, order, size, dropped): the context's size after each item, and what the policy took out of it.

    *states*: the column with the cost of the steps' states at each item, for summarize_with_dst.
    """
    kinds = dict(items.dtypes)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [int(x) for x in state.get[0].split(",") if x] if state.exists else []
        rows = pd.concat(list(batches)).sort_values(order)
        size, dropped = [], []
        for c, s in zip(rows[cost], rows[states] if states else [0] * len(rows), strict=True):
            full = [*held, int(c)]
            held = overflow(full, policy, most, states=int(s))
            size.append(sum(held))
            dropped.append(sum(full) - sum(held))
        state.update((",".join(map(str, held)),))
        yield rows[[key, order]].assign(size=size, dropped=dropped)

    return items.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {order} {kinds[order]}, size long, dropped long", "held string", "append", GroupStateTimeout.NoTimeout)


Speaker = Callable[[str, str, str], str]


def stub_speaker(said: str, last: str, knowledge: str) -> str:
    """What a model would say, made of the frame's text alone: nothing where that is empty or was said last."""
    return "" if said in ("", last) else said


def frame_loop(frames: DataFrame, key: str, order: list[str], speaker: Speaker = stub_speaker, use_reference: bool = False, max_time: float = -1) -> DataFrame:
    """(key, *order, time, gen, ref) for the frames of each video (system, said, ref, time), one after the other.

    The state of a video is its last message, its knowledge (the first system text that holds "Task knowledge:"), its first system
    text, and whether it has ended. *use_reference* feeds the reference back as the last message, where there is one, instead of what was
    generated. The frame that reaches *max_time* is the last.
    """
    kinds = dict(frames.dtypes)
    names = list(dict.fromkeys([key, *order, "time"]))
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", gen string, ref string"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, known, first, ended = state.get if state.exists else ("", "", None, False)
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for at, r in enumerate(rows.itertuples(index=False)):
            if ended:
                break
            system = r.system or ""
            first = system if first is None else first
            known = known or (system if "Task knowledge:" in system else "")
            gen = speaker(r.said or "", last, known)
            out.append((at, gen))
            if use_reference and r.ref is not None:
                last = r.ref
            else:
                last = gen or last
            ended = 0 < max_time <= r.time
        state.update((last, known, first or "", ended))
        if out:
            yield rows.iloc[[at for at, _ in out]][[*names, "ref"]].assign(gen=[g for _, g in out])[[*names, "gen", "ref"]]

    return frames.groupBy(key).applyInPandasWithState(run, schema, "last string, known string, first string, ended boolean", "append", GroupStateTimeout.NoTimeout)


def window_counts(events: DataFrame, time: str, width: str, slide: str | None = None, late: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """Rows per window of event time and *by*; rows later than *late* behind the latest are dropped by the stream."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    counted = events.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("begins"), *by, "n", "total")


def session_counts(events: DataFrame, time: str, gap: str, key: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of each key: rows not more than *gap* apart."""
    counted = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "n")
