"""Greedy bins over blocks, against plain folds."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators.chains import greedy_bins


def plain(costs, most, closes):
    out, at, used = [], 0, 0
    for c in costs:
        c = c or 0
        if closes == "before" and used and used + c >= most:
            at, used = at + 1, 0
        out.append(at)
        used += c
        if closes == "after" and used > most:
            at, used = at + 1, 0
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("closes", ["before", "after"])
def test_bins_over_blocks_equal_the_fold(spark, seed, closes):
    rng = random.Random(seed)
    keys = [None, "", "a", "b"]
    data = [(k, i, rng.choice([None, 0, 0, 1, 2, 3, 7, 30]), "x") for k in keys for i in range(rng.choice([0, 1, 6, 250]))]
    most = rng.choice([1, 2, 5, 11, 40, 400])
    df = spark.createDataFrame(data, "k string, o long, c long, p_ string").repartition(3)
    got = greedy_bins(df, "k", ["o"], "c", most, closes, block_rows=rng.choice([3, 17, 50]))
    assert got.columns == ["k", "o", "c", "p_", "bin"]
    want = {}
    for k in keys:
        rows = [r for r in data if r[0] == k]
        want |= {(k, r[1]): b for r, b in zip(rows, plain([r[2] for r in rows], most, closes), strict=True)}
    assert {(r.k, r.o): r.bin for r in got.collect()} == want


@pytest.mark.parametrize("closes", ["before", "after"])
def test_one_key_over_many_blocks_with_a_bin_longer_than_blocks(spark, closes):
    costs = [(i * 7919) % 13 for i in range(20_000)]
    df = spark.range(20_000).select(F.lit(1).alias("k"), "id", ((F.col("id") * 7919) % 13).alias("c"))
    for most in (60, 5000):
        got = greedy_bins(df, "k", ["id"], "c", most, closes, block_rows=700).orderBy("id").toPandas()["bin"].tolist()
        assert got == plain(costs, most, closes)


def test_ties_repeats_empty_tables_and_bad_costs(spark):
    data = [("a", 1, 4)] * 5 + [("a", 1, 9)] * 3
    got = greedy_bins(spark.createDataFrame(data, "k string, o int, c int"), "k", ["o"], "c", 10, block_rows=2).collect()
    assert sorted((r.bin, r.c) for r in got) == [(0, 4), (0, 4), (1, 4), (1, 4), (2, 4), (3, 9), (4, 9), (5, 9)]
    assert greedy_bins(spark.createDataFrame([], "k string, o int, c int"), "k", ["o"], "c", 10).collect() == []
    with pytest.raises(ValueError, match="most"):
        greedy_bins(spark.createDataFrame(data, "k string, o int, c int"), "k", ["o"], "c", 0)
    with pytest.raises(Exception, match="negative"):
        greedy_bins(spark.createDataFrame([("a", 1, -1)], "k string, o int, c int"), "k", ["o"], "c", 3).collect()
