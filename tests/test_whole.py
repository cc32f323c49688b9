"""Queries over whole tables and whole texts, against plain restatements on small fixtures."""

from __future__ import annotations

import math
from collections import Counter

import pytest

from tidewright.plans import QUERIES


def words(text):
    return text.split()


def grams(w, n):
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("texts"))
    docs = [(0, "a b c d\ne f g h a b", "en"), (1, "x y\nz w x y z", "fr"), (2, "no no\nno no", "de"), (97, "a b c\nd e f", "fr"), (3, "no no no no\nreal words", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(0, "a b c d e f"), (1, "x y z w x"), (2, "p q r")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    turns = [(1, 0, "user", "first\nsecond"), (1, 1, "assistant", "one\ntwo\nthree"), (1, 2, "assistant", "(aside)\nx"), (1, 3, "user", "first\nsecond"), (1, 4, "system", "x"), (2, 0, "assistant", "y\nz"), (2, 1, "assistant", "last [a|b]\nline")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{sf}/conversations.parquet")
    return sf, docs, turns


def test_bleu_scores_whole_texts_of_all_languages(spark, texts):
    sf, docs, _ = texts
    refs = {0: "a b c d e f", 1: "x y z w x", 2: "p q r"}
    pairs = [(words(t), words(refs[d % 97])) for d, t, _ in docs if d % 97 in refs]
    p = [(sum(sum((grams(h, n) & grams(r, n)).values()) for h, r in pairs) + 1e-15) / (sum(max(len(h) - n + 1, 0) for h, _ in pairs) + 1e-9) for n in range(1, 5)]
    x = sum(len(h) for h, _ in pairs) / sum(len(r) for _, r in pairs)
    want = [math.exp(sum(map(math.log, p[:n])) / n) * (math.exp(1 - 1 / x) if x < 1 else 1) for n in range(1, 5)]
    assert list(QUERIES["bleu_corpus"](spark, sf).first()) == pytest.approx(want, abs=2e-6)
    assert {r.doc_id for r in QUERIES["cider_corpus"](spark, sf).collect()} == {0, 1, 2, 97}


def test_garbage_is_judged_on_whole_texts(spark, texts):
    sf, docs, _ = texts
    got = {r.doc_id: r.text for r in QUERIES["garbage_filter"](spark, sf).collect()}
    assert got == {d: "" if d == 2 else t for d, t, _ in docs}


def test_transcript_keeps_all_lines(spark, texts):
    sf, _, _ = texts
    got = {(r.conv_id, r.turn): (r.content, r.labels) for r in QUERIES["parse_transcript"](spark, sf).collect()}
    own = {k: v[0] for k, v in got.items()}
    assert own == {(1, 0): "first\nsecond", (1, 1): "one\ntwo\nthree", (1, 3): "first\nsecond", (2, 0): "y\nz", (2, 1): "last \nline"}
    assert got[2, 0][1] == "initiative|instruction,feedback" and got[1, 1][1] == "initiative|other"


def test_nothing_is_left_out_by_its_number(spark, sf_dir, texts):
    from tidewright.plans import derived as D

    events = D.timed(spark, sf_dir).collect()
    moves = [(r.user_id, r.step_id, r.time) for r in D.steps(spark, sf_dir).collect() if r.transition != "reset"]
    want = Counter()
    for e in events:
        if e.event_type == "click":
            want[e.event_id] = len({s for u, s, t in moves if u == e.user_id and t <= e.time})
    assert Counter(r.probe_id for r in QUERIES["asof_state"](spark, sf_dir).collect()) == +want
    spans = {r.user_id for r in D.spans(spark, sf_dir).collect()}
    signups = {e.event_id for e in events if e.event_type == "signup" and e.user_id in spans}
    assert signups <= {r.event_id for r in QUERIES["annotation_state"](spark, sf_dir).collect()}
    told = QUERIES["count_narration"](spark, sf_dir).collect()
    assert sum(int(x.split()[0]) for r in told for x in r.text.split(", ")) == len(events)
    sf, _, turns = texts
    assert Counter((r.conv_id, r["at"]) for r in QUERIES["segment_locator"](spark, sf).collect()) == Counter({(1, 0): 2, (1, 1): 1, (1, 2): 1, (1, 4): 1, (2, 0): 1, (2, 1): 1})
    pairs = {(r.conv_id, r.split_turn, r.context_turn) for r in QUERIES["overlap_context"](spark, sf).collect()}
    assert pairs == {(c, a, b) for c, a, _, _ in turns for d, b, _, _ in turns if c == d and b < a}


def test_first_match_by_source_order(spark, sf_dir):
    from tidewright.plans import COVERS
    from tidewright.plans import derived as D

    events = D.timed(spark, sf_dir).collect()
    clicks = [e for e in events if e.event_type == "click"]
    spans = D.spans(spark, sf_dir).collect()
    held = {c.event_id: min((s.span_id for s in spans if s.user_id == c.user_id and s.start_ts <= c.time <= s.end_ts), default=None) for c in clicks}
    near = {c.event_id: min((v.event_id for v in events if v.event_type == "view" and v.user_id == c.user_id and abs(v.time - c.time) < 1800), default=None) for c in clicks}
    got = [(r.event_id, r.span_id) for r in QUERIES["point_in_interval_first"](spark, sf_dir).collect()]
    assert sorted(got) == sorted((c, s) for c, s in held.items() if s is not None)
    got = [(r.click_id, r.view_id) for r in QUERIES["near_time_first"](spark, sf_dir).collect()]
    assert sorted(got) == sorted((c, v) for c, v in near.items() if v is not None)
