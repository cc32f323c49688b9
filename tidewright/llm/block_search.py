"""Nearest neighbours by a block matrix join with int8 product tiles.

Queries and candidates are dealt into groups; a tile is the product of one group of each. Within a tile the vectors are
quantised to int8 with a scale each, the products of the codes give every distance with an error bound from the
quantisation residuals, and only pairs whose lower bound is within the query's k-th smallest upper bound are computed
again in double precision on the original vectors. The bounds never exclude a true neighbour, so the
result is exact. Each tile leaves k + 1 pairs a query at most; heaps merge them.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCHEMA = "qid long, qkey long, vec_id long, score double"


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows of *vectors* whose vector is not null, not all zero, and holds finite components only."""
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.filter(F.col(column).isNotNull() & good & F.exists(v, lambda x: x != 0))


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    values = table.column(column).combine_chunks()
    return np.asarray(values.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(values), -1)


def _quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scales, residual norms): x = scale * code + residual, codes from -127 to 127."""
    scale = np.abs(x).max(axis=1, initial=0) / 127
    scale[scale == 0] = 1
    code = np.rint(x / scale[:, None]).astype(np.int8)
    return code, scale, np.sqrt(((x - scale[:, None] * code) ** 2).sum(axis=1))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows: in float32 while every partial sum stays below 2**24, else in float64."""
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.float64)


def _distances(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed in the order of the components; where the squares leave the range of doubles, in scaled numbers."""
    exact = np.zeros(len(points))
    for d in (points - query).T:  # as a plain loop over the components would
        exact += d * d
    out = np.sqrt(exact)
    for j in np.flatnonzero(~np.isfinite(exact) | (exact < 1e-290)):
        d = np.abs(points[j] - query)
        most = d.max(initial=0.0)
        out[j] = most * np.sqrt(((d / most) ** 2).sum()) if 0 < most < np.inf else most
    return out


def search_tile(queries: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query's row, id, distance) of each query's *k* nearest *points*, ties to the smaller id; found through the bounds.

    A bound that isn't a number, as components of 1e200 make, excludes nothing: such pairs are computed again.
    """
    out: list[tuple[int, int, float]] = []
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        pc, ps, pr = _quantise(points)
        pn = (points**2).sum(axis=1)
        hats = np.sqrt(pn) + pr
        for at in range(0, len(queries), 256):
            q = queries[at : at + 256]
            qc, qs, qr = _quantise(q)
            qn = (q**2).sum(axis=1)
            square = qn[:, None] + pn[None, :] - 2 * (qs[:, None] * ps[None, :]) * _product(qc, pc)
            # |a.b - a'.b'| <= |a'| |eb| + |ea| |b|, with a' and b' the quantised vectors; the last terms cover rounding
            size = np.sqrt(qn) + qr
            slack = 2 * (size[:, None] * pr[None, :] + qr[:, None] * hats[None, :]) + 1e-9 * (qn[:, None] + pn[None, :]) + 1e-280
            upper = square + slack
            upper[np.isnan(upper)] = np.inf
            kth = np.partition(upper, min(k, len(points)) - 1, axis=1)[:, min(k, len(points)) - 1]
            for i, row in enumerate(~(square - slack > kth[:, None])):
                left = np.flatnonzero(row)
                exact = _distances(points[left], q[i])
                order = np.lexsort((ids[left], exact))[:k]
                out += [(at + i, int(ids[left[j]]), float(exact[j])) for j in order]
    return out


def block_search(vectors: DataFrame, queries: DataFrame, k: int = 10, group_rows: int = 8192, query_rows: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's *k* nearest of *vectors* by Euclidean distance, its own row left out.

    Both tables: vec_id long, embedding array of numbers; other columns don't matter. Vectors that are null, zero or
    hold null or non-finite components take no part, on either side. Ties go to the smaller vec_id. Vectors are compared
    with those of their own length only. A row that repeats a query is answered once; rows that repeat a candidate count each,
    but of those equal to the query in id and vector one is its own row. Rows without vec_id take no part. Fewer
    candidates than *k* give fewer rows; an empty table gives none.
    """
    side = lambda df: usable(df.filter("vec_id IS NOT NULL")).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v")).withColumn("dim", F.size("v"))
    asked, points = side(queries).dropDuplicates(["vec_id", "v"]), side(vectors)
    n_points, n_asked = points.count(), asked.count()
    pg, qg = max(1, math.ceil(n_points / group_rows)), max(1, math.ceil(n_asked / query_rows))
    cell = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    left = asked.withColumn("qg", cell(qg)).withColumn("pg", F.explode(F.sequence(F.lit(0), F.lit(pg - 1)).cast("array<long>")))
    right = points.withColumn("pg", cell(pg)).withColumn("qg", F.explode(F.sequence(F.lit(0), F.lit(qg - 1)).cast("array<long>")))
    left = left.withColumn("qkey", F.xxhash64("v"))

    def tile(q: pa.Table, p: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if q.num_rows and p.num_rows:
            found = search_tile(_matrix(q, "v"), _matrix(p, "v"), p.column("vec_id").to_numpy(), k + 1)
        qid, qkey = q.column("vec_id").to_pylist(), q.column("qkey").to_pylist()
        cols = [[qid[i] for i, _, _ in found], [qkey[i] for i, _, _ in found], [x for _, x, _ in found], [s for _, _, s in found]]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["qid", "qkey", "vec_id", "score"])

    def merge(found: pa.Table) -> pa.Table:
        rows = zip(found.column("score").to_pylist(), found.column("vec_id").to_pylist(), strict=True)
        best = heapq.nsmallest(k + 1, rows)
        qid = found.column("qid")[0].as_py()
        own = next((i for i, (score, vec) in enumerate(best) if score == 0 and vec == qid), len(best))
        best = (best[:own] + best[own + 1 :])[:k]
        return pa.table([pa.array([qid] * len(best), pa.int64()), pa.array(range(1, len(best) + 1), pa.int32()), pa.array([v for _, v in best], pa.int64()), pa.array([s for s, _ in best], pa.float64())], ["query_id", "rank", "vec_id", "score"])

    keys = ["pg", "qg", "dim"]
    tiles = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(tile, _SCHEMA)
    return tiles.groupBy("qid", "qkey").applyInArrow(merge, "query_id long, rank int, vec_id long, score double")
