"""Operators on small literal fixtures, and sequential ones against plain restatements."""

from __future__ import annotations

import random
from itertools import permutations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import dialogue as G
from tidewright.functions import text as T
from tidewright.operators import frames as R
from tidewright.operators import generation as N
from tidewright.operators import intervals as I
from tidewright.operators import matching as M
from tidewright.operators import metrics as X
from tidewright.operators import packing as P
from tidewright.operators import relations as J
from tidewright.operators import states as S
from tidewright.operators import validators as V
from tidewright.sources import files
from tidewright.streaming.stateful import overflow


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_parse_blocks_of_both_dialects(spark):
    b = lambda line: one(spark, T.parse_block(F.lit(line)))
    assert tuple(b("[94.4s-105.2s] - attach wheel")) == ("attach wheel", 94.4, 105.2)
    assert tuple(b("[111.0s] point")) == ("point", 111.0, None)
    assert b("no time") is None and b("[3s] ") is None
    t = lambda line: one(spark, T.parse_block_trailing_unit(F.lit(line)))
    assert t("[94.4s-105.2s] attach") is None
    assert tuple(t("[94.4-105.2s] attach")) == ("attach", 94.4, 105.2)
    assert tuple(t("[10s] unscrew it")) == ("unscrew it", 10.0, 16.0)


def test_parse_turns(spark):
    p = lambda line: one(spark, T.parse_turn(F.lit(line)))
    assert tuple(p("[15.5s] Assistant: Do it [Initiative|Instruction, info]")) == (15.5, "assistant", "Do it", "initiative|instruction,info_sharing")
    assert tuple(p("[2s] User: hm")) == (2.0, "user", "hm", "")
    assert [p(x) for x in ("[xs] User: a", "[1s] Bob: a", "[1s] User: (aside)", "plain")] == [None] * 4


def test_time_codes(spark):
    assert one(spark, T.frame_of(F.lit(1.25), 2.0)) == 2 and one(spark, T.frame_of(F.lit(1.75), 2.0)) == 4
    assert one(spark, T.frame_of_stamp(F.lit("00:00:01.5"), 1000.0)) == 1005
    assert one(spark, T.stamp_of_frame(F.lit(1499), 25)) == "00:00:60"
    assert one(spark, T.letters_to_number(F.lit("aa"))) == 27 and one(spark, T.letters_to_number(F.lit("A"))) == -1


def test_stamps_keep_hours_of_three_digits(spark):
    stamps = [one(spark, T.stamp_of_frame(F.lit(n), 25)) for n in (0, 8_999_999, 9_000_000, 9_000_005, 42_000_001, 90_000_000)]
    assert stamps == ["00:00:00", "99:59:60", "100:00:00", "100:00:01", "466:40:01", "1000:00:00"]
    assert one(spark, T.stamp_of_frame(F.lit(None).cast("long"), 25)) is None


def test_uuid5_and_json(spark):
    import uuid

    assert one(spark, T.uuid5_dns(F.lit("video_1_2"))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "video_1_2"))
    assert one(spark, T.json_object_text(F.lit('x ```json\n{"a": [1, 2,],}\n``` y'))) == '{"a": [1, 2]}'


def test_narrations_and_cleaning(spark):
    m = lambda *items: one(spark, G.merge_narrations(F.array(*map(F.lit, items))))
    assert m("#C C opens box", "#C C takes cup #C C again", "#C C third") == "C opens box and takes cup."
    assert m("#O someone", "#C C walks #unsure") == ""
    c = lambda t: tuple(one(spark, G.clean_generated(F.lit(t))))
    assert c("Hello there<|eot_id|>rest") == ("Hello there", None)
    assert c("assistant: yes: sir") == ("yes: sir", "assistant") and c(" . ") == ("", None)
    assert c("<|start_header_id|>user<|end_header_id|>\n\nhi<|eot_id|>") == ("hi", "user")
    assert one(spark, G.describe_updates(F.expr("array(named_struct('step_id', 'S1', 'transition', 'start'))"))) == "Step S1 has been started."


def test_labels_take_the_first_list(spark):
    assert one(spark, T.turn_labels(F.lit("assistant"), F.lit("Well done, wait"))) == "initiative|instruction,feedback"
    assert one(spark, T.turn_labels(F.lit("DST_UPDATE"), F.lit("x"))) == "dst_update|generic"
    assert one(spark, T.is_garbage(F.lit("a a a a"), 3)) and not one(spark, T.is_garbage(F.lit("a a a"), 3))


BLOCKS = "k long, i long, start_ts double, end_ts double"


def test_blocks_are_absorbed_in_order(spark):
    rows = [(1, 0, 0.0, 10.0), (1, 1, 2.0, 4.0), (1, 2, 6.0, 8.0), (1, 3, 3.0, None), (1, 4, 30.0, 35.0), (1, 5, 29.0, 40.0), (2, 0, 1.0, None), (2, 1, 0.0, 5.0)]
    got = {(r.k, r.i): r.absorbed for r in I.absorb_contained(spark.createDataFrame(rows, BLOCKS), "k", "i").collect()}
    assert got == {(1, 0): 3, (1, 4): 0, (1, 5): 0, (2, 0): 0, (2, 1): 0}


def test_blocks_of_many_keys_and_batches_are_absorbed_apart(spark):
    r = random.Random(6)
    rows = [(r.choice([None, 1, 2, 3, 4]), i, r.choice([None, *map(float, range(9))]), r.choice([None, *map(float, range(12))])) for i in range(300)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
        got = sorted(tuple(x)[1:] for x in I.absorb_contained(spark.createDataFrame(rows, BLOCKS), "k", "i").collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    kept = {}
    for k, i, s, e in rows:
        last = s if e is None else e
        outer = next((x for x in kept.get(k, []) if None not in (x[1], x[2], s) and x[1] <= s and last <= x[2]), None)
        if outer is None:
            kept.setdefault(k, []).append([i, s, e, 0])
        else:
            outer[3] += 1
    assert got == sorted(map(tuple, (x for group in kept.values() for x in group)))


def test_micro_gaps_compare_with_the_head_of_the_run(spark):
    rows = [(1, 0, "turn the left screw", 0.0, 1.0), (1, 1, "turn the left screw", 2.0, 3.0), (1, 2, "turn the right screw", 3.5, 4.0), (1, 3, "open box", 4.1, 5.0)]
    got = I.merge_micro_gaps(spark.createDataFrame(rows, "k long, i long, text string, start_ts double, end_ts double"), "k", "i").orderBy("i").collect()
    assert [(r.i, r.end_ts, r.merged) for r in got] == [(0, 3.0, 2), (2, 4.0, 1), (3, 5.0, 1)]


def test_push_overlaps_is_the_fold(spark):
    r = random.Random(1)
    rows = [(k, i, s := r.uniform(0, 100), s + r.uniform(0, 20)) for k in range(5) for i in range(30)]
    got = {(x.k, x.i): (x.start_ts, x.end_ts) for x in I.push_overlaps(spark.createDataFrame(rows, BLOCKS), ["k"], "i").collect()}
    for k in range(5):
        last = float("-inf")
        for _, i, s, e in sorted((x for x in rows if x[0] == k), key=lambda x: (x[2], x[1])):
            at = max(s, last)
            last = at + e - s
            assert got[k, i] == pytest.approx((at, last))


def test_repaired_tree_has_no_violations(spark):
    r = random.Random(2)
    rows = []
    for k in range(4):
        for i in range(3):
            rows.append((k, "step", f"S{i + 1}", None, r.uniform(0, 50), r.uniform(50, 60)))
            rows += [(k, "substep", f"S{i + 1}.{j + 1}", f"S{i + 1}", s := r.uniform(0, 80), s + r.uniform(0, 10)) for j in range(3)]
    nodes = spark.createDataFrame(rows, "k long, level string, node_id string, parent_id string, start_ts double, end_ts double")
    fixed = I.repair_tree(nodes, "k")
    assert fixed.count() == len(rows) and V.tree_time_violations(fixed, ["k"]).count() == 0


def test_frames_follow_the_loop(spark):
    r = random.Random(3)
    rows = [(k, i, r.choice(["user", "assistant"]), float(t)) for k in range(6) for i, t in enumerate(sorted(r.uniform(0, 30) for _ in range(8)))]
    turns = spark.createDataFrame(rows, "k long, turn long, role string, time double")
    got = {(x.k, x.turn): (x.start_frame, x.end_frame) for x in R.frames_continuous(turns, ["k"], 2.0, F.lit(40).cast("long")).collect()}
    strict = {(x.k, x.turn): (x.start_frame, x.end_frame) for x in R.frames_alternating(turns, ["k"], 0.5, F.lit(12), ["turn"]).collect()}
    for k in range(6):
        start = last = 0
        for _, i, _, t in (x for x in rows if x[0] == k):
            end = max(min(int(t * 2), 40), start)
            assert got[k, i] == (start, end)
            start = end
        for _, i, _, t in (x for x in rows if x[0] == k):
            end = max(int(t * 0.5), last + 1)
            if end > 12:
                assert (k, i) not in strict
            else:
                assert strict[k, i] == (last, end)
            last = end


def test_state_truth_table(spark):
    steps = spark.createDataFrame([(1, 1, 10.0, "S1", "start"), (1, 2, 25.0, "S1", "complete"), (1, 3, 45.0, "S2", "start")], "u long, i long, time double, step_id string, transition string")
    probes = spark.createDataFrame([(1, 5.0), (1, 15.0), (1, 30.0), (1, 50.0)], "u long, t double")
    got = S.state_as_of(probes, steps, ["u"], "t", ["time", "i"]).collect()
    assert {(r.t, r.step_id): r.state for r in got} == {(15.0, "S1"): "in_progress", (30.0, "S1"): "completed", (50.0, "S1"): "completed", (50.0, "S2"): "in_progress"}
    bad = S.transition_validity(spark.createDataFrame([(1, 1, 1.0, "S1", "complete"), (1, 2, 2.0, "S1", "start")], steps.schema), ["u"], ["time", "i"]).orderBy("i").collect()
    assert [(r.before, r.valid) for r in bad] == [("not_started", False), ("completed", False)]


def test_assignment_is_the_cheapest():
    r = random.Random(4)
    for _ in range(200):
        n, m = r.randint(1, 5), r.randint(5, 6)
        cost = {(i, j): float(r.randint(0, 6)) for i in range(n) for j in range(m)}
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(m), n))
        got = M.assign(cost)
        assert len(got) == n == len(set(got.values())) and sum(cost[e] for e in got.items()) == best
    for _ in range(200):
        n, m = r.randint(1, 4), r.randint(1, 4)
        cost = {(i, j): float(r.randint(0, 6)) for i in range(n) for j in range(m) if r.random() < 0.5}
        places = [[j for j in range(m) if (i, j) in cost] + [None] for i in range(n)]
        legal = [c for c in product(*places) if len({j for j in c if j is not None}) == sum(j is not None for j in c)]
        best = min((sum(j is None for j in c), sum(cost[i, j] for i, j in enumerate(c) if j is not None)) for c in legal)
        got = M.assign(cost)
        assert (n - len(got), sum(cost[e] for e in got.items())) == best and len(set(got.values())) == len(got)
    assert M.assign({(0, 0): 0.0, (1, 0): 0.0}) in ({0: 0}, {1: 0}) and M.assign({}) == {}


def test_replaying_the_reference_is_perfect(spark):
    said = spark.createDataFrame([(1, f, t, t) for f, t in enumerate(["hello there", "", "", "turn it", ""])], "u long, frame long, gen string, ref string")
    out = M.turn_taking(said, M.match_assign(M.match_candidates(said, ["u"], (-2, 2)), "u"), ["u"], 2.0).first()
    assert (out.f1, out.jaccard_index, out.num_missed, out.num_redundant, out.semantic_score, out.time_diff) == (1.0, 1.0, 0, 0, 1.0, 0.0)


def test_alignments():
    s = np.array([[3, 0, 0], [2, 2, 0], [0, 4, 1], [0, 0, 5]], float)
    assert M.monotonic_alignment(s) == [0, 1, 1, 2] and M.greedy_alignment(s) == [0, 0, 1, 2] and M.greedy_alignment(s, True) == [0, 1, 1, 2]
    assert M.monotonic_alignment(np.zeros((3, 2))) == [0, 0, 0]
    r = np.random.default_rng(5)
    for _ in range(50):
        t = r.random((6, 3))
        paths = [[0]]
        for _ in range(5):
            paths = [p + [p[-1] + d] for p in paths for d in (0, 1) if p[-1] + d < 3]
        assert sum(t[i, j] for i, j in enumerate(M.monotonic_alignment(t))) == pytest.approx(max(sum(t[i, j] for i, j in enumerate(p)) for p in paths))


def test_bleu_and_cider_of_equal_texts(spark):
    pairs = spark.createDataFrame([(1, "the cat sat on the mat", "the cat sat on the mat"), (2, "a dog ran over there fast", "a dog ran over there fast")], "i long, h string, r string")
    assert all(v == pytest.approx(1.0, abs=1e-6) for v in X.bleu(pairs, "i", "h", "r").first())
    assert [r.cider for r in X.cider(pairs, "i", "h", "r").collect()] == pytest.approx([10.0, 10.0])
    short = spark.createDataFrame([(1, "the cat", "the cat sat on the mat")], "i long, h string, r string")
    assert X.bleu(short, "i", "h", "r").first().bleu_1 == pytest.approx(np.exp(1 - 3), rel=1e-6)


def test_budget_split_covers_every_reply_once(spark):
    r = random.Random(6)
    rows = [(k, i, r.choice(["user", "assistant"]), float(i), r.randint(10, 90)) for k in range(8) for i in range(20)]
    turns = spark.createDataFrame(rows, "k long, i long, role string, time double, c long")
    got = P.split_by_budget(turns, "k", "i", "c", 200).collect()
    assert len({(x.k, x.i) for x in got}) == len(got)
    cost = {(k, i): c for k, i, _, _, c in rows}
    role = {(k, i): s for k, i, s, _, _ in rows}
    parts: dict = {}
    for x in got:
        parts.setdefault((x.k, x.segment), []).append(x.i)
    for (k, _), items in parts.items():
        assert sorted(items) == list(range(min(items), max(items) + 1)) and sum(cost[k, i] for i in items) <= 200
        assert any(role[k, i] == "assistant" for i in items)
    assert {(k, i) for k, i, s, _, _ in rows if s == "assistant"} <= {(x.k, x.i) for x in got}


def test_adjusted_times_keep_their_distance(spark):
    rows = [(1, 0, "user", 0.0), (1, 1, "assistant", 0.1), (1, 2, "assistant", 0.2), (1, 3, "user", 0.3), (1, 4, "assistant", 9.0)]
    got = [r.time for r in P.adjust_times(spark.createDataFrame(rows, "k long, i long, role string, time double"), "k", "i").orderBy("i").collect()]
    assert got[0] == 0.0 and got[1] == 0.1 and all(b - a >= 0.5 for a, b in zip(got[1:], got[2:], strict=False))


def test_band_and_point_joins_are_exact(spark):
    r = random.Random(7)
    a = [(r.randint(0, 2), i, r.uniform(0, 50)) for i in range(80)]
    b = [(r.randint(0, 2), i, r.uniform(0, 50)) for i in range(80)]
    left, right = spark.createDataFrame(a, "k long, i long, ta double"), spark.createDataFrame(b, "k long, j long, tb double")
    got = sorted((x.i, x.j) for x in J.band_join(left, right, ["k"], "ta", "tb", -1.5, 4).collect())
    assert got == sorted((i, j) for k, i, s in a for q, j, t in b if k == q and -1.5 <= t - s <= 4)
    near = {x.i: x.distance for x in J.nearest(left, right, ["k"], "ta", "tb").collect()}
    assert all(near[i] == pytest.approx(min(abs(t - s) for q, _, t in b if q == k)) for k, i, s in a)
    spans = spark.createDataFrame([(k, i, s, s + i % 9) for k, i, s in a], "k long, n long, start_ts double, end_ts double")
    found = sorted((x.j, x.n) for x in J.point_in_interval(right, spans, ["k"], "tb", 3.0).collect())
    assert found == sorted((j, i) for q, j, t in b for k, i, s in a if k == q and s <= t <= s + i % 9)


def test_context_policies():
    assert overflow([5, 5, 5], "none", 10) == [5, 5, 5] and overflow([5, 5, 5], "drop_all", 10) == []
    assert overflow([1, 2, 3, 4, 5], "drop_middle", 10) == [1, 4, 5] and overflow([9, 9], "summarize", 10) == [20]
    assert overflow([1, 2], "drop_all", 10) == [1, 2]


def test_results_do_not_depend_on_partitions(spark):
    rows = [(k, i, float(i % 7), float(i % 7 + i % 3)) for k in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, BLOCKS)
    for f in (lambda d: I.interval_union(d, ["k"]), lambda d: I.absorb_contained(d, "k", "i"), lambda d: I.push_overlaps(d, ["k"], "i")):
        assert sorted(map(tuple, f(df.coalesce(1)).collect())) == sorted(map(tuple, f(df.repartition(9)).collect()))


def test_empty_tables_give_empty_results(spark):
    none = spark.createDataFrame([], BLOCKS)
    assert I.absorb_contained(none, "k", "i").count() == I.interval_union(none, ["k"]).count() == I.gaps(none, ["k"]).count() == 0
    assert I.temporal_violations(none, ["k"], "i").count() == I.fix_overlaps(none, ["k"], ["start_ts"]).count() == 0


def test_validators(spark):
    msg = lambda c: one(spark, c)
    assert msg(V.clip_error(F.lit(-1), F.lit(4), F.lit(9))) == "negative start" and msg(V.clip_error(F.lit(4), F.lit(4), F.lit(9))) == "empty clip"
    assert msg(V.clip_error(F.lit(None).cast("int"), F.lit(4), F.lit(9))) == "missing bound" and msg(V.clip_error(F.lit(0), F.lit(4), F.lit(9))) is None
    assert msg(V.turn_error(F.lit("DST_UPDATE"), F.lit("x"))) is None and msg(V.turn_error(F.lit("DST_UPDATE"), F.lit("x"), False)) == "invalid role DST_UPDATE"


def test_files_round_trip(spark, tmp_path):
    good, path = '{"a": 1}', str(tmp_path / "x.json")
    (tmp_path / "x.json").write_text(good + "\n{broken\n")
    rows = files.read_json_lines(spark, path, "a long").collect()
    assert [(r.a, r[files.CORRUPT]) for r in rows] == [(1, None), (None, "{broken")]
    assert files.read_json_folder(spark, str(tmp_path / "nowhere"), "a long").count() == 0
    (tmp_path / "d").mkdir()
    for i in (3, 1):
        (tmp_path / "d" / f"{i}.json").write_text(f'[{{"a": {i}}}]')
    assert [r.a for r in files.read_json_folder(spark, str(tmp_path / "d"), "a long", 1).collect()] == [1]
    assert {(r.a, r.sample_idx) for r in files.read_predictions(spark, str(tmp_path / "d"), "a long", 2).collect()} == {(1, 1), (3, 3)}
    with pytest.raises(ValueError, match="2 of 3"):
        files.read_predictions(spark, str(tmp_path / "d"), "a long", 3)
    df = spark.createDataFrame([(1, "x"), (2, None)], "i long, t string")
    files.write_split(df, str(tmp_path / "q"), F.col("t").isNotNull())
    assert spark.read.json(str(tmp_path / "q/failed")).count() == spark.read.json(str(tmp_path / "q/done")).count() == 1


def test_generation_retries_what_fails(spark):
    out = N.generate_with_retries(spark.createDataFrame([(i, f"p{i}") for i in range(60)], "i long, p string"), "p").collect()
    assert len(out) == 60 and all(r.ok for r in out) and {r.tries for r in out} == {1, 2}


def test_binary_metrics_without_division(spark):
    r = X.binary_metrics(spark.createDataFrame([(1, 0, 0), (1, -100, 1)], "g long, t int, p int"), ["g"], "t", "p").first()
    assert (r.tn, r.tp, r.precision, r.recall, r.f1, r.balanced_accuracy) == (1, 0, 0.0, 0.0, 0.0, 0.5)


def test_prepared_clips_keep_room_and_carry_progress(spark):
    from tidewright.operators.packing import cut_parts, prepare_clips

    role = ["user", "assistant", "user", "assistant", "assistant", "user"]
    assert cut_parts(role, [10] * 6, 25) == [(0, 1), (2, 3), (4, 5)]
    assert cut_parts(role, [10] * 6, 25, lambda reply: 0 if reply is None else 10) == [(0, 1), (3, 3), (4, 4)]
    assert cut_parts(["user"] * 3, [10] * 3, 15) == [] and cut_parts([], [], 5) == []
    rows = [(1, i, r, f"so far {i}" if r == "assistant" else None, "know", i * 4, i * 4 + 4, 40, 10) for i, r in enumerate(role)]
    rows += [(2, 0, "assistant", "w " * 4000, None, 0, 4, 40, 10)]
    df = spark.createDataFrame(rows, "k int, t int, role string, progress string, knowledge string, start_frame long, end_frame long, n_frames long, cost long")
    got = prepare_clips(df, "k", "t", "cost", 50, ("P",), summaries=False, context=(1, 1)).filter("k = 1").orderBy("clip").collect()
    assert [(r.k, r["first"], r["last"], r.start_frame, r.end_frame) for r in got] == [(1, 0, 3, 0, 16), (1, 4, 5, 14, 24)]
    assert [r.system_prompt for r in got] == ["P", "P so far 3 Task knowledge: know"]
    with_summaries = prepare_clips(df, "k", "t", "cost", 73, ("P",)).orderBy("clip").collect()  # 23 are kept free; the second conversation needs too many
    assert [(r.k, r["last"], r.progress) for r in with_summaries] == [(1, 3, "so far 3"), (1, 5, "so far 4")]


def test_strategies_and_the_frame_loop(spark, tmp_path):
    from tidewright.streaming.runs import run_to_table
    from tidewright.streaming.stateful import frame_loop, overflow

    costs = [10, 20, 30, 40, 50]
    assert [overflow(costs, p, 100, states=7) for p in ("none", "drop_all", "drop_middle", "summarize", "summarize_with_dst")] == [costs, [], [10, 40, 50], [20], [27]]
    with pytest.raises(ValueError, match="none of"):
        overflow(costs, "other", 100)
    rows = [(1, 0, 0.5, "Task knowledge: x", "a", "r"), (1, 1, 1.0, None, "a", None), (1, 2, 1.5, None, "b", None), (1, 3, 2.0, None, "c", None), (2, 0, 0.5, None, None, None)]
    path = str(tmp_path / "frames")
    spark.createDataFrame(rows, "v int, f int, time double, system string, said string, ref string").coalesce(1).write.parquet(path)
    stream = lambda: spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    loop = lambda **o: {(r.v, r.f): r.gen for r in run_to_table(frame_loop(stream(), "v", ["f"], **o)).collect()}
    assert loop(max_time=1.5) == {(1, 0): "a", (1, 1): "", (1, 2): "b", (2, 0): ""}
    assert loop(use_reference=True)[1, 1] == "a"  # the reference "r" was fed back, so "a" is new again
    heard = loop(speaker=lambda said, last, known: f"{last}|{known}")
    assert heard[1, 1] == "|Task knowledge: x|Task knowledge: x"


def test_scans_that_check(spark):
    from tidewright.sources import files as S

    frames = spark.createDataFrame([("a", i, "YQ==", b"f" if i else None) for i in range(3)], "video_uid string, frame_idx long, image string, feature binary")
    assert [bytes(r.data) for r in S.decoded_frames(frames, 2.0).orderBy("frame_idx").collect()] == [b"a", b"f", b"f"]
    clips = spark.createDataFrame([("a", 0, 4), ("a", 0, 3), ("b", 1, 1)], "video_uid string, clip_start int, clip_end int")
    assert [r.error for r in S.checked_clips(frames, clips).orderBy("video_uid", "clip_end").collect()] == [None, "clip ends at 4 of 3", "clip ends at 1 of 0"]
    with pytest.raises(Exception, match="clip ends at 4 of 3"):
        S.checked_clips(frames, clips, strict=True).collect()
    files = spark.createDataFrame([("/d/x_12.tsv",), ("/d/a_12.tsv",)], "path string")
    videos = spark.createDataFrame([(12,), (13,)], "id int")
    assert {r.id: r.path for r in S.file_of_each(files, videos, "id").collect()} == {12: "/d/a_12.tsv", 13: None}
    with pytest.raises(Exception, match="no annotation file for 13"):
        S.file_of_each(files, videos, "id", strict=True).collect()


def test_parse_errors_point_at_the_place(spark):
    from tidewright.operators.validators import parse_errors

    rows = parse_errors(spark.createDataFrame([(1, '{"a": 1}'), (2, '{\n"a" 1}'), (3, None)], "k int, t string"), "k", "t").orderBy("k").collect()
    assert [(r.k, r.line, r.column) for r in rows] == [(2, 2, 5), (3, 1, 1)] and rows[0].context[len(rows[0].pointer) - 1] == "1"


def test_prompts_are_sent_once_a_round(spark):
    from tidewright.operators.generation import generate_with_retries, map_spans

    calls = spark.sparkContext.accumulator(0)

    def failing(prompts):
        calls.add(len(prompts))
        return [None] * len(prompts)

    out = generate_with_retries(spark.range(20).selectExpr("cast(id AS string) p"), "p", failing, rounds=3)
    assert out.filter("ok").count() == 0 and out.count() == 20 and calls.value == 60
    never = map_spans(spark.createDataFrame([(1, 3, 2)], "k int, blocks int, steps int"), "k", lambda ps: ["[2, 1, 1]"] * len(ps)).first()
    assert never.mapping is None and never.tries == 3


def test_state_is_carried_over_micro_batches(spark, tmp_path):
    import os

    from tidewright.streaming.runs import run_to_table
    from tidewright.streaming.stateful import changes, context_sizes, replay_states

    rows = [(u, e, f"S{e % 3}", ("start", "complete", "reset")[e % 5 % 3], 10 + e) for e in range(30) for u in (1, 2)]
    columns = "user_id long, event_id long, step_id string, transition string, cost long"
    path = tmp_path / "log"
    path.mkdir()
    for n in range(3):  # a file a batch, in order of time
        spark.createDataFrame(rows[n * 20 : n * 20 + 20], columns).coalesce(1).write.parquet(str(tmp_path / f"part{n}"))
        source = next((tmp_path / f"part{n}").glob("part-*.parquet"))
        os.utime(source.rename(path / f"{n}.parquet"), (n + 1, n + 1))
    whole = tmp_path / "whole"
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(str(whole))
    schema = spark.read.parquet(str(whole)).schema
    stream = lambda where, **o: spark.readStream.schema(schema).options(**o).parquet(str(where))
    for run in (lambda s: replay_states(s, "user_id", ["event_id"]), lambda s: changes(s, "user_id", ["event_id"], "step_id"), lambda s: context_sizes(s, "user_id", "event_id", "cost", "drop_middle", 100)):
        many = run_to_table(run(stream(path, maxFilesPerTrigger=1, pathGlobFilter="*.parquet")))
        assert sorted(map(str, many.collect())) == sorted(map(str, run_to_table(run(stream(whole))).collect()))


def test_matching_in_parts_is_matching_of_the_whole(spark):
    r = random.Random(3)
    rows = [(u, f, r.choice(["", "a b", "b c"]), r.choice(["", "a c", "b"])) for u in (1, 2) for f in sorted(r.sample(range(200), 70))]
    frames = spark.createDataFrame(rows, "u int, frame long, gen string, ref string")
    candidates = M.match_candidates(frames, ["u"], (-4, 2))
    cost = {}
    for c in candidates.collect():
        cost.setdefault(c.u, {})[c.gen_frame, c.ref_frame] = c.cost
    got = {}
    for x in M.match_assign(candidates, "u").collect():
        got.setdefault(x.u, {})[x.gen_frame] = x.ref_frame
    for u in cost:
        want = M.assign(cost[u])
        assert len(got[u]) == len(want) and sum(cost[u][k] for k in got[u].items()) == pytest.approx(sum(cost[u][k] for k in want.items()))


@pytest.mark.parametrize("reach", [(-4, 2), None])
def test_parts_over_many_batches_are_matched_as_one(spark, reach):
    r = random.Random(5)
    rows = [(u, f, r.choice(["", "a b", "b c"]), r.choice(["", "a c", "b"])) for u in (1, 2, 3) for f in sorted(r.sample(range(900), 400))]
    candidates = M.match_candidates(spark.createDataFrame(rows, "u int, frame long, gen string, ref string"), ["u"], (-4, 2))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        small = sorted(map(tuple, M.match_assign(candidates, "u", reach).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    cost = {}
    for c in candidates.collect():
        cost.setdefault(c.u, {})[c.gen_frame, c.ref_frame] = c.cost
    for u, edges in cost.items():
        got, want = {x[1]: x[2] for x in small if x[0] == u}, M.assign(edges)
        assert len(got) == len(want) == len(set(got.values())) and sum(edges[e] for e in got.items()) == pytest.approx(sum(edges[e] for e in want.items()))


def test_assignment_leaves_out_what_is_no_candidate(spark):
    schema = "u string, gen_frame long, ref_frame long, text_cost double, cost double, silent boolean"
    rows = [("a", 1, 1, 0.0, 0.5, False), ("a", 1, 1, 0.0, 0.5, False), ("a", 2, 1, 0.0, 0.1, False), (None, 1, 1, 0.0, 0.1, False), ("b", None, 1, 0.0, 0.1, False), ("b", 1, 2, 0.0, None, True)]
    got = M.match_assign(spark.createDataFrame(rows, schema), "u", (-1, 1)).collect()
    assert [(x.u, x.gen_frame, x.ref_frame) for x in got] == [("a", 2, 1)]
    assert M.match_assign(spark.createDataFrame([], schema), "u").count() == 0


def test_first_container_is_the_scan_of_all_kept():
    r = random.Random(9)
    for _ in range(300):
        n = r.randint(0, 40)
        spans = [(float(r.randint(0, 12)) if r.random() < 0.95 else float("nan"), float(r.randint(0, 14)) if r.random() < 0.8 else float("nan")) for _ in range(n)]
        kept, want = [], []
        for i, (s, e) in enumerate(spans):
            last = s if np.isnan(e) else e
            outer = next((k for k in kept if not np.isnan(spans[k][1]) and spans[k][0] <= s and last <= spans[k][1]), -1)
            want.append(outer)
            if outer < 0:
                kept.append(i)
        got = I.first_container(*(np.array([x[c] for x in spans], float) for c in (0, 1)))
        assert got.tolist() == want


def test_pack_streams_keys_of_any_size(spark):
    rng = random.Random(5)
    rows = [(k, i, float(rng.choice([0, 7, 30, 90]))) for k in [None, *range(40)] for i in range(1 if k and k % 3 else rng.randint(1, 60))]
    want, at, used, last = {}, 0, 0, object()
    for k, i, price in rows:
        at, used = (0, 0) if k != last else (at, used) if not used or used + price < 80 else (at + 1, 0)
        want[k, i], used, last = at, used + price, k
    ends = {k: i for k, i in want}
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "k long, i int, c double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert {(r.k, r.i): r.bin for r in P.pack(df, "k", "i", "c", 80).collect()} == want
            assert {(r.k, r.i): r.bin for r in P.pack(df, "k", "i", "c", 80, keep_last=False).collect()} == {x: b for x, b in want.items() if ends[x[0]] != x[1]}
            assert {(r.k, r.line - 1): r.bin for r in P.pack(df, "k", ["i", "c"], "c", 80, place="line").collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_meteor_of_exact_words(spark):
    assert X.meteor_of("a b c d".split(), "a b c d".split()) == pytest.approx(1 - 0.5 / 64)
    assert X.meteor_of("c d a b".split(), "a b c d".split()) == pytest.approx(1 - 0.5 / 8)
    assert X.meteor_of("a x".split(), "a b c".split()) == pytest.approx(10 * 0.5 / 3 / (1 / 3 + 4.5) * 0.5)
    assert X.meteor_of("a a a".split(), ["a"]) == pytest.approx(10 / 3 / (1 + 3) * 0.5)
    assert X.meteor_of([], ["a"]) == X.meteor_of(["a"], []) == 0
    pairs = spark.createDataFrame([(1, "a b c d", "a b c d"), (2, "x", " "), (3, None, "y")], "k int, h string, r string")
    got = {r.metric: r.value for r in X.text_scores(pairs, "k", "h", "r", ("meteor", "bleu", "nonsense")).collect()}
    assert set(got) == {"meteor", "bleu_1", "bleu_2", "bleu_3", "bleu_4"} and got["meteor"] == pytest.approx((1 - 0.5 / 64) / 2)
    assert {r.value for r in X.text_scores(pairs.filter("k = 2"), "k", "h", "r").collect()} == {0.0}
