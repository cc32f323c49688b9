"""Stateful streams with typed state: frames with two gates, changes with gaps, and thresholds that remember.

Each operator keeps a key's state in value, list and map states of a StatefulProcessor, so state is as large as what it holds and is read and written
in parts. Within a micro-batch a key's rows are put in order; across batches the source must deliver a key in order, as a log per video does. State
outlives restarts by the stream's checkpoint. Rows without a key are left out, as rows that follow one in a batch would be taken for its own. The session needs a state store with column families, which with_state_store() asks for.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_RESULT = {"start": "in_progress", "complete": "completed"}
#: The update gate never opens below this probability, whatever threshold is asked for.
UPDATE_FLOOR = 0.6
_STORE = "spark.sql.streaming.stateStore.providerClass"


def with_state_store(spark: SparkSession) -> SparkSession:
    """*spark*, with the state store that typed states need."""
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def _sorted(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(order, kind="stable")


def _run(df: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    with_state_store(df.sparkSession)
    return df.filter(F.col(key).isNotNull()).groupBy(key).transformWithStateInPandas(processor, outputStructType=schema, outputMode="append", timeMode="none")


def repeated_words(text: str, most: int) -> bool:
    """Whether *text* is nothing but one word, said more than *most* times: what a generator does when it is stuck."""
    words = text.split()
    return len(words) > most and len(set(words)) == 1


class _Frames(StatefulProcessor):
    def __init__(self, key: str, order: str, speak: float, update: float, most: int, reserve: int, cost: int) -> None:
        self.names, self.speak, self.update = (key, order), speak, max(update, UPDATE_FLOOR)
        self.room, self.cost = most - reserve, cost

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.steps = handle.getMapState("steps", "step string", "state string")
        self.length = handle.getValueState("length", "tokens long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        name, order = self.names
        steps = {k[0]: v[0] for k, v in self.steps.iterator()}
        length = self.length.get()[0] if self.length.exists() else None
        prompt, out = 0, []
        for r in _sorted(rows, [order]).itertuples(index=False):
            if length is None:  # a new context: the states' prompt goes before the frame
                length = self.cost + 2 * len(steps)
            length += 1
            updated, spoken = r.update_prob > self.update, r.speak_prob > self.speak
            moved = r.update_text or "" if updated else None
            if moved is not None:
                length += len(moved.split())
                moved = "" if repeated_words(moved, 3) else moved
                step, arrow, change = moved.partition("->")
                if arrow and change.strip() in _RESULT:
                    steps[step.strip()] = _RESULT[change.strip()]
                    self.steps.updateValue((step.strip(),), (_RESULT[change.strip()],))
            said = r.speak_text or "" if spoken else ""
            length += len(said.split())
            said = "" if repeated_words(said, 5) else said
            full = length >= self.room
            states = ",".join(f"{s}:{steps[s]}" for s in sorted(steps))
            out.append((key[0], getattr(r, order), said, moved, states, int(spoken), int(updated), length, full))
            if full:
                length = None
        if length is None:
            self.length.clear()
        else:
            self.length.update((length,))
        yield pd.DataFrame(out, columns=[name, order, "said", "moved", "states", "speaking", "updating", "tokens", "rebuilt"])

    def close(self) -> None:
        pass


def gated_frames(frames: DataFrame, key: str, order: str, speak: float = 0.5, update: float = 0.5, most: int = 4096, reserve: int = 0, cost: int = 20) -> DataFrame:
    """(key, order, said, moved, states, speaking, updating, tokens, rebuilt): a row for every frame with the states after it.

    *frames*: key, order, speak_prob, speak_text, update_prob, update_text. A frame speaks if its probability is above *speak*, and updates if it is
    above *update* and above 0.6; null probabilities do neither. "S1->start" and "S1->complete" set a step's state and other updates none; text that only repeats one
    word (more than 3 times for updates, 5 for speech) is dropped. moved is null where the update gate stayed shut. tokens is the context's
    length: *cost* and two for each state when it begins, one a frame, one a word of what was generated, dropped or not. At *most* less *reserve* the
    context is given up (rebuilt) and the next frame begins a new one from the states. Of one key's repeated orders the order of arrival counts.
    """
    kinds = dict(frames.dtypes)
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, said string, moved string, states string, speaking int, updating int, tokens long, rebuilt boolean"
    return _run(frames.select(key, order, "speak_prob", "speak_text", "update_prob", "update_text"), key, _Frames(key, order, speak, update, most, reserve, cost), schema)


class _Changes(StatefulProcessor):
    def __init__(self, key: str, order: str, value: str) -> None:
        self.names = (key, order, value)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.before = handle.getValueState("before", "value string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        name, order, value = self.names
        before, out = (self.before.get()[0] if self.before.exists() else None), []
        for at, now in _sorted(rows, [order])[[order, value]].itertuples(index=False):
            now = None if pd.isna(now) else now
            if before is not None and now is not None and now != before:
                out.append((key[0], at, before, now))
            before = now
        if before is None:
            self.before.clear()
        else:
            self.before.update((before,))
        yield pd.DataFrame(out, columns=[name, order, "before", value])

    def close(self) -> None:
        pass


def changes_within(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, order, before, value): rows whose value (text) differs from that of the row before, neither being null.

    A null is a gap: it clears what is remembered, so a key's first row and the first one after a gap are no changes.
    """
    kinds = dict(df.dtypes)
    return _run(df.select(key, order, value), key, _Changes(key, order, value), f"{key} {kinds[key]}, {order} {kinds[order]}, before string, {value} string")


class _Threshold(StatefulProcessor):
    def __init__(self, key: str, order: str, prob: str, mode: str) -> None:
        self.names, self.falls = (key, order, prob), mode.startswith("diff")
        self.limit = float(mode.removeprefix("diff"))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "p double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        name, order, prob = self.names
        last, out = (self.last.get()[0] if self.last.exists() else None), []
        for at, p in _sorted(rows, [order])[[order, prob]].itertuples(index=False):
            if pd.isna(p):
                out.append((key[0], at, False))
                continue
            falls = self.falls and last is not None and last - p > self.limit
            out.append((key[0], at, bool(falls or p <= (0.5 if self.falls else self.limit))))
            last = float(p)
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame(out, columns=[name, order, "speaks"])

    def close(self) -> None:
        pass


def talk_gate(df: DataFrame, key: str, order: str, prob: str, mode: str) -> DataFrame:
    """(key, order, speaks) by the probability *prob* of staying silent: *mode* "0.3" speaks up to it and is silent above.

    "diff0.3" speaks where the probability has fallen by more than that since the key's last one, and otherwise up to 0.5. A null
    probability never speaks and isn't remembered.
    """
    kinds = dict(df.dtypes)
    return _run(df.select(key, order, prob), key, _Threshold(key, order, prob, mode), f"{key} {kinds[key]}, {order} {kinds[order]}, speaks boolean")


_FRAME, _REPLY = "frame", "assistant"


class _Attached(StatefulProcessor):
    def __init__(self, key: str, patience: int) -> None:
        self.key, self.patience = key, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, n long, kind string, text string")
        self.pending = handle.getListState("pending", "text string")
        self.open = handle.getValueState("open", "ms long, n long, prompt string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        latest = None
        for batch in rows:
            came = [(int(r.ms), int(r.n), r.kind, r.text or "") for r in batch.itertuples(index=False) if r.kind is not None]
            if came:
                self.waiting.appendList(came)
                latest = max(latest or came[0][0], max(r[0] for r in came))
        if latest is not None:
            self.handle.registerTimer(latest)
        yield pd.DataFrame([], columns=[self.key, "n", "prompt", "ref"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((r for r in held if r[0] <= now), key=lambda r: (r[0], r[2] == _FRAME, r[1]))
        pending = [r[0] for r in self.pending.get()] if self.pending.exists() else []
        shown = tuple(self.open.get()) if self.open.exists() else None
        out: list[tuple] = []

        def close(ref: str) -> None:
            nonlocal shown
            if shown is not None:
                out.append((key[0], shown[1], shown[2], ref))
            shown = None

        for ms, n, kind, text in ready:
            if kind == _FRAME:
                close("")
                shown, pending = (ms, n, "\n".join(pending)), []
            elif kind == _REPLY:
                close(text if shown is not None and ms <= shown[0] + self.patience else "")
            else:
                pending.append(text)
        if shown is not None:
            if now >= shown[0] + self.patience:
                close("")
            else:
                self.handle.registerTimer(shown[0] + self.patience)
        for state, left in ((self.waiting, [r for r in held if r[0] > now]), (self.pending, [(t,) for t in pending])):
            if left:
                state.put(left)
            else:
                state.clear()
        if shown is None:
            self.open.clear()
        else:
            self.open.update(shown)
        yield pd.DataFrame(out, columns=[self.key, "n", "prompt", "ref"])

    def close(self) -> None:
        pass


def attach_messages(frames: DataFrame, messages: DataFrame, key: str, delay: str = "0 seconds", patience: int = 3_600_000) -> DataFrame:
    """(key, n, prompt, ref) of each frame: the messages since the frame before it, and the reply that is given on it.

    *frames*: key, time (timestamp), n; *messages*: key, time, n, kind, text. Two streams, each with a watermark of *delay*: rows wait in the state
    until both streams have passed their time, so neither needs to keep step with the other, and what comes later than that is dropped. At equal times
    messages go before frames, in order of n. Messages but those of the assistant wait for the next frame, however far; a line each in its prompt.
    A reply belongs to the last frame before it, up to *patience* milliseconds; a second reply on a frame, or one that comes too late for it, has none. A
    frame is given when its reply, the next frame or the end of its patience has come. Null texts are empty; a null kind (or a frame without n) only moves the
    watermark; rows without key or time are left out.
    """
    spark, kind = frames.sparkSession, dict(frames.dtypes)[key]
    with_state_store(spark)

    def timed(df: DataFrame, what: list) -> DataFrame:
        rows = df.filter(F.col("time").isNotNull() & F.col(key).isNotNull()).withWatermark("time", delay)
        return rows.select(F.col(key), "time", F.unix_millis("time").alias("ms"), F.col("n").cast("long").alias("n"), *what)

    both = timed(frames, [F.when(F.col("n").isNotNull(), _FRAME).alias("kind"), F.lit("").alias("text")]).unionByName(timed(messages, [F.when(F.col("n").isNotNull(), F.col("kind")).alias("kind"), "text"]))
    schema = f"`{key}` {kind}, n long, prompt string, ref string"
    return both.groupBy(key).transformWithStateInPandas(_Attached(key, patience), outputStructType=schema, outputMode="append", timeMode="EventTime")
