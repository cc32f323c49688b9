"""Blocks against steps in tiles, against plain loops."""

from __future__ import annotations

import numpy as np
import pytest

from tidewright.operators.tiles import tile_scores


def plain(blocks, steps, top):
    out = set()
    for key in {b[0] for b in blocks} & {s[0] for s in steps}:
        own, other = [b for b in blocks if b[0] == key], [s for s in steps if s[0] == key]
        dot = np.array([[np.dot(b[3], s[3]) for s in other] for b in own])
        entail = (dot - dot.min()) / (dot.max() - dot.min() + 1e-8)
        unit = lambda v: np.array(v) / n if (n := np.linalg.norm(v)) else np.array(v)
        for i, b in enumerate(own):
            scored = sorted((-round(0.6 * float(unit(b[2]) @ unit(s[2])) + 0.4 * entail[i, j], 12), s[1]) for j, s in enumerate(other))
            out |= {(key, b[1], r + 1, step, round(-x, 6) + 0.0) for r, (x, step) in enumerate(scored[:top])}
    return out


@pytest.mark.parametrize("tile", [4, 1000])
def test_tiles_equal_all_pairs(spark, tile):
    rng = np.random.default_rng(5)
    vector = lambda n: [float(x) for x in rng.integers(-3, 4, n)]
    blocks = [(k, i, vector(6), vector(3), "x") for k, n in [("a", 30), ("b", 1), (None, 5), ("alone", 3)] for i in range(n)]
    blocks.append(("a", 100, [0.0] * 6, vector(3), "x"))
    steps = [(k, i, vector(6), vector(3)) for k, n in [("a", 11), ("b", 2), (None, 4), ("unmet", 2)] for i in range(n)]
    steps += [("a", 50, *steps[0][2:]), ("a", 51, *steps[0][2:])]
    left = spark.createDataFrame([*blocks, ("a", 200, None, [1.0] * 3, ""), ("a", None, [1.0] * 6, [1.0] * 3, ""), ("a", 201, [], [1.0] * 3, ""), blocks[0]], "g string, block long, vector array<double>, premise array<double>, k string")
    right = spark.createDataFrame(steps, "g string, step long, vector array<double>, hypothesis array<double>")
    got = {(r.g, r.block, r.rank, r.step, round(r.score, 6) + 0.0) for r in tile_scores(left, right, "g", top=3, tile=tile).collect()}
    assert got == plain(blocks, steps, 3)
    assert tile_scores(left.limit(0), right, "g").collect() == tile_scores(left, right.limit(0), "g").collect() == []
