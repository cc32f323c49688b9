"""Typed-state streams over several micro-batches and a restart, against plain restatements."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from tidewright.streaming import processors as X


def streamed(spark, folder, rows, schema, operator):
    """What *operator* gives for *rows* (key, order, ...) in ten files, one a micro-batch: five, and after a restart from the checkpoint five more."""
    rows = sorted(rows, key=lambda r: r[1])
    ends = {k: len(rows) * k // 10 for k in range(11)}
    for half in (range(5), range(5, 10)):
        for k in half:
            spark.createDataFrame(rows[ends[k] : ends[k + 1]], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        query = operator(source).writeStream.format("parquet").option("checkpointLocation", f"{folder}/marks").trigger(availableNow=True).start(f"{folder}/out")
        query.awaitTermination()
        assert query.lastProgress["batchId"] >= 4
    return [tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()]


@pytest.fixture
def values():
    rng = random.Random(7)
    return [(rng.choice("abc"), i, rng.choice(["x", "x", "y", None])) for i in range(300)]


def test_changes_with_gaps_across_batches(spark, tmp_path, values):
    numbered = [(ord(k), i, v) for k, i, v in values] + [(None, i, "x") for i in range(0, 300, 5)]  # rows without a key leave the others alone
    got = streamed(spark, tmp_path, numbered, "k long, i long, v string", lambda s: X.changes_within(s, "k", "i", "v"))
    got = [(chr(k), *rest) for k, *rest in got]
    want, before = [], defaultdict(lambda: None)
    for k, i, v in values:
        if v is not None and before[k] is not None and before[k] != v:
            want.append((k, i, before[k], v))
        before[k] = v
    assert sorted(got) == want or sorted(got, key=lambda r: r[1]) == want


@pytest.mark.parametrize("mode", ["0.4", "diff0.3"])
def test_thresholds_remember_across_batches(spark, tmp_path, mode):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i, None if rng.random() < 0.1 else rng.random()) for i in range(200)]
    got = streamed(spark, tmp_path, rows, "k string, i long, p double", lambda s: X.talk_gate(s, "k", "i", "p", mode))
    want, last = [], {}
    for k, i, p in rows:
        if p is None:
            want.append((k, i, False))
            continue
        fell = mode == "diff0.3" and k in last and last[k] - p > 0.3
        want.append((k, i, fell or p <= (0.5 if mode == "diff0.3" else 0.4)))
        last[k] = p
    assert sorted(got, key=lambda r: r[1]) == want


def test_gates_states_and_context_across_batches(spark, tmp_path):
    rng = random.Random(4)
    texts = ["S1->start", "S1->complete", "S2 -> start", "S3->reset", "no arrow", "a a a a", "a a a", None, ""]
    said = ["hello there", "um um um um um um", "um um um um um", None, ""]
    rows = [(rng.choice("abc"), i, None if rng.random() < 0.1 else rng.random(), rng.choice(said), None if rng.random() < 0.1 else rng.random(), rng.choice(texts)) for i in range(400)]
    schema = "k string, i long, speak_prob double, speak_text string, update_prob double, update_text string"
    got = streamed(spark, tmp_path, rows, schema, lambda s: X.gated_frames(s, "k", "i", speak=0.3, update=0.2, most=60, reserve=12, cost=10))
    states, length, want = defaultdict(dict), defaultdict(lambda: None), []
    stuck = lambda text, n: len(text.split()) > n and len(set(text.split())) == 1
    for k, i, p, speech, q, update in rows:
        size = (10 + 2 * len(states[k]) if length[k] is None else length[k]) + 1
        moved = None
        if q is not None and q > 0.6:  # the floor, not the 0.2 asked for
            moved = update or ""
            size += len(moved.split())
            moved = "" if stuck(moved, 3) else moved
            if "->" in moved:
                step, change = (x.strip() for x in moved.split("->"))
                if change in ("start", "complete"):
                    states[k][step] = {"start": "in_progress", "complete": "completed"}[change]
        text = (speech or "") if p is not None and p > 0.3 else ""
        size += len(text.split())
        want.append((k, i, "" if stuck(text, 5) else text, moved, ",".join(f"{s}:{x}" for s, x in sorted(states[k].items())), int(p is not None and p > 0.3), int(q is not None and q > 0.6), size, size >= 48))
        length[k] = None if size >= 48 else size
    assert sorted(got, key=lambda r: r[1]) == want
    assert any(r[8] for r in want)


def test_messages_wait_for_frames_of_another_stream(spark, tmp_path):
    from datetime import datetime, timedelta, timezone

    at = lambda s: datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=s)
    shapes = {"frames": "k string, time timestamp, n long", "messages": "k string, time timestamp, n long, kind string, text string"}
    end = at(10_000)
    batches = [  # frames lag behind messages, over a restart; the last row of each stream moves the watermark
        ([("a", at(10), 1)], [("a", at(5), 1, "system", "s"), ("a", at(10), 2, "user", "u"), ("a", at(25), 3, "assistant", "r1"), ("a", at(26), 4, "assistant", "lost")]),
        ([("a", at(20), 2), ("b", at(30), 1)], [("b", at(500), 5, "assistant", "too late"), (None, None, 9, "user", "no time"), ("a", at(31), 6, "user", None)]),
        ([("a", at(40), 3), ("a", at(50), 4)], [("a", at(60), 7, "assistant", "r4"), ("b", at(501), 8, "user", "never shown")]),
        ([("tick", end, None), (None, end, 7)], [("tick", end, None, None, None)]),
    ]
    for half in (batches[:2], batches[2:]):
        for parts in half:
            for (name, schema), rows in zip(shapes.items(), parts, strict=True):
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        frames, messages = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}") for name, schema in shapes.items())
        found = X.attach_messages(frames, messages, "k", patience=100_000)
        found.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/marks").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == [("a", 1, "s\nu", ""), ("a", 2, "", "r1"), ("a", 3, "", ""), ("a", 4, "", "r4"), ("b", 1, "", "")]
