"""Scores of all blocks against all steps of a key, in tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.sources.scratch import written

_TINY = 1e-8


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, in double precision, each divided by its norm; a zero vector stays zero."""
    rows = np.asarray(vectors.flatten()).astype(np.float64).reshape(len(vectors), -1)
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def tile_scores(blocks: DataFrame, steps: DataFrame, key: str, weight: float = 0.6, top: int = 3, tile: int = 1024) -> DataFrame:
    """(key, block, rank, step, semantic, entail, score): the *top* steps of each block among the steps of its key.

    *blocks*: key, block (long), vector, premise; *steps*: key, step (long), vector, hypothesis; vectors are arrays of numbers of one length. semantic is the
    cosine of the two vectors; entail the dot product of premise and hypothesis (an entailment model's two towers, arrays of one length too), scaled to 0..1
    over all pairs of a key by its extremes; score is their mean by *weight*. Ties go to the smaller step.

    Blocks and steps are dealt into tiles of *tile* rows by hash; a task holds two tiles and their product. A first pass gives each key's extremes from
    the tiles', a second the scores, of which a tile keeps *top* per block; tiles' best are ranked per block by a window. No pairs are written. Each side is copied
    once per tile of the other, so a key with few steps stays cheap whatever the number of its blocks. Rows without id or with a null or empty vector take no part;
    null keys are one key; a key without blocks or steps gives nothing. Of rows that repeat an id one counts, the one with the smallest vectors in array order.
    """
    kind = dict(blocks.dtypes)[key]
    named = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))

    def dealt(df: DataFrame, row: str, second: str) -> DataFrame:
        usable = F.col(row).isNotNull() & (F.size("vector") > 0) & (F.size(second) > 0) & ~F.exists("vector", lambda x: x.isNull()) & ~F.exists(second, lambda x: x.isNull())
        pair = F.struct(F.col("vector").cast("array<double>").alias("v"), F.col(second).cast("array<double>").alias("w"))
        one = df.filter(usable).groupBy(named.alias("k"), F.col(row).cast("long").alias("id")).agg(F.min(pair).alias("x"), F.first(key).alias("key"))
        sizes = one.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / tile).cast("long").alias("n")).withColumnRenamed("k", "k2")
        return written(one.join(sizes, F.col("k") == F.col("k2")).select("k", "key", "id", "x.v", "x.w", "n", F.pmod(F.xxhash64("id"), "n").alias("t")), "tiles")

    left, right = dealt(blocks, "block", "premise"), dealt(steps, "step", "hypothesis")
    counts = lambda df: df.select(F.col("k").alias("k2"), F.col("n").alias("m")).distinct()
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))
    of_left = left.join(counts(right), F.col("k") == F.col("k2")).select("k", F.lit(0).alias("side"), "id", "v", "w", F.col("t").alias("i"), copies.alias("j"))
    of_right = right.join(counts(left), F.col("k") == F.col("k2")).select("k", F.lit(1).alias("side"), "id", "v", "w", copies.alias("i"), F.col("t").alias("j"))
    tiles = of_left.unionByName(of_right).repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "side", "id")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Table, pa.Table]]:
        """(key, blocks, steps) of each tile in turn."""
        held: list[pa.Table] = []
        at = None
        for batch in batches:
            place = list(zip(batch.column("k").to_pylist(), batch.column("i").to_pylist(), batch.column("j").to_pylist(), strict=True))
            cuts = [n for n in range(len(place)) if not n or place[n] != place[n - 1]] + [len(place)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if place[a] != at and held:
                    yield at[0], *sides(held)
                    held = []
                at = place[a]
                held.append(pa.Table.from_batches([batch.slice(a, z - a)]))
        if held:
            yield at[0], *sides(held)

    def sides(held: list[pa.Table]) -> tuple[pa.Table, pa.Table]:
        whole = pa.concat_tables(held).combine_chunks()
        n = int((whole.column("side").to_numpy() == 0).sum())
        return whole.slice(0, n), whole.slice(n)

    def plain(rows: pa.ChunkedArray) -> np.ndarray:
        one = rows.combine_chunks()
        return np.asarray(one.flatten()).reshape(len(one), -1)

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, a, b in each(batches):
            if a.num_rows and b.num_rows:
                dot = plain(a.column("w")) @ plain(b.column("w")).T
                yield pa.RecordBatch.from_pydict({"k": [k], "low": [float(dot.min())], "high": [float(dot.max())]})

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, a, b in each(batches):
            if not (a.num_rows and b.num_rows):
                continue
            low, high = a.column("low")[0].as_py(), a.column("high")[0].as_py()
            semantic = _matrix(a.column("v").combine_chunks()) @ _matrix(b.column("v").combine_chunks()).T
            entail = (plain(a.column("w")) @ plain(b.column("w")).T - low) / (high - low + _TINY)
            # products of equal rows may differ in their last bits by their place in a tile
            score = np.round(weight * semantic + (1 - weight) * entail, 12)
            ids, n = b.column("id").to_numpy(), min(top, b.num_rows)
            # steps are sorted by id, so a stable sort leaves ties to the smaller one
            order = np.argsort(-score, axis=1, kind="stable")[:, :n]
            line = np.repeat(np.arange(a.num_rows), n)
            found = (line, order.ravel())
            yield pa.RecordBatch.from_pydict({"k": [k] * len(line), "id": a.column("id").to_numpy()[line], "step": ids[found[1]], "semantic": semantic[found], "entail": entail[found], "score": score[found]})

    span = tiles.mapInArrow(extremes, "k string, low double, high double").groupBy("k").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    span = written(span, "extremes").withColumnRenamed("k", "k2")
    scaled = of_left.unionByName(of_right).join(span, F.col("k") == F.col("k2")).drop("k2").repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "side", "id")
    kept = scaled.mapInArrow(best, "k string, id long, step long, semantic double, entail double, score double")
    place = F.row_number().over(Window.partitionBy("k", "id").orderBy(F.col("score").desc(), "step"))
    rows = kept.withColumn("rank", place).filter(F.col("rank") <= top)
    keys = left.select(F.col("k").alias("k2"), "key").groupBy("k2").agg(F.first("key").alias("key"))
    return rows.join(keys, F.col("k") == F.col("k2")).select(F.col("key").cast(kind).alias(key), F.col("id").alias("block"), "rank", "step", "semantic", "entail", "score")
