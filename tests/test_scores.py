"""BLEU, CIDEr and their summary against plain restatements: repeated rows, odd texts, and what is shuffled."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewright.operators import metrics as X

TEXTS = ["a b c d\ne f a b", None, "", " \t\n", "a", "a b c", "x y z w x y z a b c", "a b " * 300, "été b c d", "a b c d\x1ce f", "q r s t u v"]
REFS = ["a b c d e f a b", "x y z w x", "", None, "été b c\fd e", "a b c", "a b c d e f a b"]
ROWS = [(i * 10 + j, h, r) for i, h in enumerate(TEXTS) for j, r in enumerate(REFS)]
ROWS += ROWS[:20] + [(0, "a b c", "a b c d"), (0, "z w x", "x y z w x")]


def grams(text: str | None) -> tuple[list[str], list[Counter]]:
    w = [x for x in re.split(r"[ \t\n\r\f\v]+", text or "") if x]
    return w, [Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for n in range(1, 5)]


def plain_cider(rows: list[tuple]) -> Counter:
    df, z, out = Counter(), math.log(len(rows)), []
    for _, _, r in rows:
        df.update((n, g) for n, own in enumerate(grams(r)[1]) for g in own)
    for k, h, r in rows:
        (hw, hg), (rw, rg) = grams(h), grams(r)
        total = 0.0
        for n in range(4):
            a, b = ({g: c * (z - math.log(max(df[n, g], 1))) for g, c in x[n].items()} for x in (hg, rg))
            dot = sum(min(a[g], b[g]) * b[g] for g in a.keys() & b.keys())
            length = math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values()))
            total += dot / length if length else dot
        d = max(len(hw) - 1, 0) - max(len(rw) - 1, 0)
        out.append((k, round(total * math.exp(-d * d / 72) / 4 * 10, 6) + 0.0))
    return Counter(out)


def plain_bleu(rows: list[tuple]) -> list[float]:
    pairs = [(grams(h), grams(r)) for _, h, r in rows]
    p = [(sum((h[1][n] & r[1][n]).total() for h, r in pairs) + 1e-15) / (sum(max(len(h[0]) - n, 0) for h, _ in pairs) + 1e-9) for n in range(4)]
    x = sum(len(h[0]) for h, _ in pairs) / sum(len(r[0]) for _, r in pairs)
    return [math.exp(sum(map(math.log, p[: n + 1])) / (n + 1)) * (math.exp(1 - 1 / x) if x < 1 else 1) for n in range(4)]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(ROWS, "k long, h string, r string").repartition(3).cache()


def shuffled(df) -> list[str]:
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if re.search(r"hashpartitioning\(.*gram", line)]


def test_bleu_counts_each_row_by_itself_and_shuffles_no_grams(pairs):
    found = X.bleu(pairs, "k", "h", "r")
    assert list(found.first()) == pytest.approx(plain_bleu(ROWS), rel=1e-9)
    assert not shuffled(found)


@pytest.mark.parametrize("bits", [1 << 23, 1 << 15])
def test_cider_is_exact_whatever_the_bitmap_lets_through(pairs, monkeypatch, bits):
    monkeypatch.setattr(X, "_BITS", bits)
    found = X.cider(pairs, "k", "h", "r")
    assert Counter((r.k, r.c) for r in found.select("k", (F.round("cider", 6) + 0.0).alias("c")).collect()) == plain_cider(ROWS)
    assert not shuffled(found)


def test_cider_keeps_grams_whose_bits_are_taken(pairs, monkeypatch):
    monkeypatch.setattr(X, "_gram_bits", lambda df: b"\xff" * (X._BITS // 8))
    found = X.cider(pairs, "k", "h", "r").select("k", (F.round("cider", 6) + 0.0).alias("c"))
    assert Counter((r.k, r.c) for r in found.collect()) == plain_cider(ROWS)


def test_text_scores_shuffle_no_grams(pairs):
    found = X.text_scores(pairs, "k", "h", "r", ("bleu", "meteor"))
    own = [row for row in ROWS if grams(row[2])[0]]
    got = {r.metric: r.value for r in found.collect()}
    assert [got[f"bleu_{n}"] for n in range(1, 5)] == pytest.approx(plain_bleu(own), rel=1e-9)
    assert not shuffled(found)


def test_pairs_shuffle_no_documents_whatever_the_benchmarks_size(spark, tmp_path):
    from tidewright.plans import metric_queries as Q

    docs = [(i, None if i % 11 == 0 else f"a b c {i} d") for i in [*range(-300, 300), 2**40]]
    items = [(i, [f"a b c {i}", "", None, " x "][i % 4]) for i in range(-400, 400)] + [(None, "a b c")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    of, own = dict(items), [(d, t, int(math.fmod(d, 97))) for d, t in docs]
    found, before = Q._pairs(spark, str(tmp_path)), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    assert Counter((r.doc_id, r.hyp, r.ref) for r in found.collect()) == Counter((d, t, of[i]) for d, t, i in own)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a benchmark above any limit
        scores = Q.text_scores(spark, str(tmp_path))
        got = {r.metric: r.value for r in scores.collect()}
        plan = scores._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [got[f"bleu_{n}"] for n in range(1, 5)] == pytest.approx(plain_bleu([(d, t, of[i]) for d, t, i in own if grams(of[i])[0]]), abs=1e-6)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
