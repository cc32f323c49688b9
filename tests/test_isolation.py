"""Isolated folds, replies with a fallback, mappings and the log of phases, on small literal tables."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.operators import isolation as I


def test_a_failing_key_loses_only_itself(spark):
    big = 2**53 + 1
    data = [("a", 1, big), ("a", 2, 5), ("bad", 1, 7), (None, 1, 8), ("c", 1, 0)]
    df = spark.createDataFrame(data, "k string, o int, v long")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        if (rows["v"] == 7).any():
            raise KeyError("seven")
        return rows[["k", "v"]]

    rows, failures = I.isolated_fold(df, "k", ["o"], ["v"], fold, "k string, v long", tries=3)
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([("a", big), ("a", 5), (None, 8), ("c", 0)], key=str)
    found = failures.collect()
    assert [(r.k, r.reason, r.tries) for r in found] == [("bad", "KeyError: 'seven'", 3)] and "raise KeyError" in found[0].trace


def test_tries_are_counted_and_copies_are_given(spark):
    df = spark.createDataFrame([(1, 1, 10), (2, 1, 20)], "k int, o int, v int")
    seen: list[int] = []

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        seen.append(1)
        first = rows["v"].iloc[0]
        rows["v"] = 0
        if len(seen) % 2:
            raise OSError("try again")
        return pd.DataFrame({"v": [first]})

    rows, failures = I.isolated_fold(df.coalesce(1), "k", ["o"], ["v"], fold, "v int", tries=2)
    assert sorted(r.v for r in rows.collect()) == [10, 20] and failures.count() == 0
    rows, failures = I.isolated_fold(df.limit(0), "k", ["o"], ["v"], fold, "v int")
    assert rows.count() == failures.count() == 0


DECISIONS = [
    ('{"chosen_step": 3, "confidence": 0.8}', (2, 0.8, "parsed")),
    ('x ```json\n{"chosen_step": 2}\n``` {"chosen_step": 1}', (1, 0.5, "parsed")),
    ("{}", (0, 0.5, "parsed")),
    ('{"chosen_step": 9}', (0, 0.5, "corrected")),
    ('{"chosen_step": 0, "confidence": "0.25"}', (0, 0.25, "corrected")),
    ('{"chosen_step": "two"}', (1, 0.3, "fallback")),
    ('{"confidence": "sure"}', (1, 0.3, "fallback")),
    ("{'chosen_step': 1}", (1, 0.3, "fallback")),
    ('{"chosen_step": 1} or {"chosen_step": 2}', (1, 0.3, "fallback")),
    ('{"chosen_step": 1}, {"chosen_step": 2}', (1, 0.3, "fallback")),
    ('{"chosen_step": 1}] {}', (1, 0.3, "fallback")),
    ("[1]", (1, 0.3, "fallback")),
    ("no idea", (1, 0.3, "fallback")),
    (" \n\t", (-1, 0.0, "none")),
    ("", (-1, 0.0, "none")),
    (None, (-1, 0.0, "none")),
]


def test_step_decisions_with_fallbacks(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(DECISIONS)], "i int, t string")
    got = df.select("i", I.step_decision(F.col("t"), F.lit(4), F.lit(1)).alias("d")).orderBy("i").collect()
    assert [tuple(r.d) for r in got] == [d for _, d in DECISIONS]
    none = df.filter("i = 12").select(I.step_decision(F.col("t"), F.lit(4), F.lit(None).cast("int")).alias("d")).first().d
    assert tuple(none) == (-1, 0.0, "none")


MAPPINGS = [
    ('{"S1": ["a", 2], "S2": "b", "3": 4.5}', {"S1": ["a", "2"], "S2": ["b"], "3": ["4.5"]}),
    ('ok\n```json\n{"mapping": {"S1": "[a]", "S2": []}}\n```', {"S1": ["[a]"], "S2": []}),
    ('{"S1": true, "S2": null}', {"S1": ["true"], "S2": [None]}),
    ("{}", {}),
    ('{"mapping": [1]}', None),
    ("[1, 2]", None),
    ('{"S1": ', None),
    ('{"S1": "a"} {"S2": "b"}', None),
    ("words", None),
    ("", None),
    (None, None),
]


def test_step_mappings(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(MAPPINGS)], "i int, t string")
    assert [r.m for r in df.select("i", I.step_mapping(F.col("t")).alias("m")).orderBy("i").collect()] == [m for _, m in MAPPINGS]


def test_audit_log_counts_phases(spark):
    data = [("a", 0.0, 4.0), ("a", 4.0, 5.0), ("a", 1.0, 2.0), ("a", 6.0, 7.0), ("a", 3.0, None), ("a", 9.0, 9.0), (None, 1.0, 2.0), ("z", None, None)]
    df = spark.createDataFrame(data, "k string, s double, e double")
    assert {r.s for r in I.valid_blocks(df, "s", "e").collect()} == {0.0, 4.0, 1.0, 6.0}
    r = I.audit_log(df, ["k"], "s", "e").first()
    assert tuple(r.reduction) == (8, 5, 2)
    assert tuple(r.construction) == (2, 3, pytest.approx(7 / 3))
    assert tuple(r.validation) == (3, 0, True)
    r = I.audit_log(df.limit(0), ["k"], "s", "e").first()
    assert tuple(r.reduction) == (0, 0, 0) and tuple(r.construction) == (0, 0, None) and tuple(r.validation) == (0, 0, True)
