"""Joins, selections and samples that the timeline pipelines need, each with a stated order where one decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: list[str], order: list, k: int = 1) -> DataFrame:
    """The first *k* rows of each group by *order*, which must not leave ties that matter."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def first_match_join(left: DataFrame, right: DataFrame, on: list, left_key: list[str], order: list) -> DataFrame:
    """Left join that keeps the first matching row of *right* by *order*."""
    met = left.join(right, on, "left")
    return top_per_group(met, left_key, order)


def semi_unless_empty(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows with a key in *keys*; all rows if *keys* is empty."""
    return df if keys.isEmpty() else df.join(keys, on, "left_semi")


def point_in_interval(points: DataFrame, intervals: DataFrame, key: list[str], at: str, width: float) -> DataFrame:
    """Each point with every interval of its key that holds it, bounds included.

    Time is cut into buckets of *width*: an interval is filed under each bucket that it touches, a point under its own, so the join
    is on equal keys and a key with very many points spreads over its buckets.
    """
    filed = intervals.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_ts") / width), F.floor(F.col("end_ts") / width))))
    own = points.withColumn("_b", F.floor(F.col(at) / width))
    return own.join(filed, [*key, "_b"]).filter(F.col(at).between(F.col("start_ts"), F.col("end_ts"))).drop("_b")


def band_join(left: DataFrame, right: DataFrame, key: list[str], left_at: str, right_at: str, low: float, high: float) -> DataFrame:
    """Pairs of a key with low <= right_at - left_at <= high, by buckets as wide as the band."""
    width = max(high - low, 1e-9)
    lower = F.floor((F.col(left_at) + low) / width)
    own = left.withColumn("_b", F.explode(F.array(lower, lower + 1)))
    other = right.withColumn("_b", F.floor(F.col(right_at) / width))
    return own.join(other, [*key, "_b"]).filter((F.col(right_at) - F.col(left_at)).between(low, high)).drop("_b")


def nearest(left: DataFrame, right: DataFrame, key: list[str], left_at: str, right_at: str) -> DataFrame:
    """*left* with the distance to the nearest *right_at* of its key, from the last one before and the first one after; null where there is none."""
    both = left.select("*", F.col(left_at).alias("_t"), F.lit(None).cast("double").alias("_r"), F.lit(1).alias("_left")).unionByName(
        right.select(*key, F.col(right_at).alias("_t"), F.col(right_at).cast("double").alias("_r"), F.lit(0).alias("_left")), allowMissingColumns=True
    )
    w = Window.partitionBy(*key).orderBy("_t", "_left")
    before = F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = F.least(F.abs(F.col("_t") - F.col("_before")), F.abs(F.col("_after") - F.col("_t")))
    return both.withColumns({"_before": before, "_after": after}).filter("_left = 1").withColumn("distance", near).drop("_t", "_r", "_left", "_before", "_after")


def hash_rank(key: Column, seed: int = 0) -> Column:
    """A fixed pseudo-random number from 0 to below 1 for each key."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) / F.lit(1_000_000.0)


def md5_rank(key: Column) -> Column:
    """As hash_rank(), from the MD5 of the key's text, which other engines compute too."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def sample_share(df: DataFrame, group: list[str], key: str, share: float) -> DataFrame:
    """max(int(share * n), 1) rows of each group of n, those with the smallest hashes; all where *share* is 1 or more."""
    w = Window.partitionBy(*group)
    n = F.greatest(F.floor(F.count(F.lit(1)).over(w) * share), F.lit(1))
    ranked = df.withColumns({"_k": n, "_r": F.row_number().over(w.orderBy(F.md5(F.col(key).cast("string")), key))})
    return ranked.filter((F.lit(share >= 1)) | (F.col("_r") <= F.col("_k"))).drop("_k", "_r")


def best_of_every_type(df: DataFrame, key: list[str], kind: str, score: str, tie: str, least: float, kinds: int) -> DataFrame:
    """The best row of each type with a score of at least *least*, for keys that have all *kinds* types."""
    best = top_per_group(df.filter(F.col(score) >= least), [*key, kind], [F.col(score).desc(), tie])
    return best.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*key))).filter(F.col("_n") == kinds).drop("_n")


def train_share(df: DataFrame, key: list[str], score: str, tie: str, least: float, ratio: float, ascending: bool = True) -> DataFrame:
    """Rows with a score of at least *least*: repeated int(ratio) times, or the first ceil(n * ratio) of each key by score."""
    kept = df.filter(F.col(score) >= least)
    if ratio > 1:
        return kept.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(int(ratio)))))
    w = Window.partitionBy(*key)
    order = F.col(score).asc() if ascending else F.col(score).desc()
    ranked = kept.withColumns({"_r": F.row_number().over(w.orderBy(order, tie)), "_n": F.ceil(F.count(F.lit(1)).over(w) * ratio)})
    return ranked.filter("_r <= _n").drop("_r", "_n").withColumn("copy", F.lit(1))


def majority(df: DataFrame, group: list[str], value: str, position: str) -> DataFrame:
    """The commonest value of each group with its votes; the one seen first wins a tie."""
    votes = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("votes"), F.min(position).alias("_first"))
    return top_per_group(votes, group, [F.col("votes").desc(), "_first"]).drop("_first")


def round_robin(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The part from 0 to *n* - 1 that each row falls to in turn. The order is global: for small tables of work items."""
    return df.withColumn("part", F.pmod(F.row_number().over(Window.orderBy(*order)) - 1, F.lit(n)))


def fixed_chunks(df: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """Groups of *n* consecutive rows of a key, numbered from 0."""
    return df.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1) / n))


def chunk_context(df: DataFrame, key: list[str], order: list[str], value: str, n: int, before: int) -> DataFrame:
    """A row per chunk with its values in order and the *before* values ahead of it."""
    w = Window.partitionBy(*key).orderBy(*order)
    ranked = df.withColumn("_r", F.row_number().over(w) - 1)
    all_ = ranked.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", value))), lambda x: x[value]).alias("_all"))
    cut = all_.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / n).cast("int"))))
    start = F.greatest(F.col("chunk") * n - before, F.lit(0))
    return cut.select(*key, "chunk", F.slice("_all", F.col("chunk") * n + 1, F.lit(n)).alias("values"), F.slice("_all", start + 1, F.col("chunk") * n - start).alias("context"))


def ends_window(values: Column, k: int) -> Column:
    """The first and last k / 2 items of an array with "..." between, if it has more than *k*."""
    half = k // 2
    return F.when(F.size(values) <= k, values).otherwise(F.concat(F.slice(values, 1, half), F.array(F.lit("...")), F.slice(values, -half, half)))


def natural_step_order(step_id: Column) -> tuple[Column, Column]:
    """Order of step ids: by number where one follows the letter, then by text."""
    return F.substring(step_id, 2, 2147483647).try_cast("int"), step_id


def ratio_histogram(positive: Column, total: Column) -> Column:
    """Whole per cent of *positive* in *total*."""
    return F.floor(100 * positive / total)

