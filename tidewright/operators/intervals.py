"""Intervals on a time axis: overlaps, gaps, coverage, merging and repair.

Tables have a key, start_ts and end_ts, and an identifier that breaks ties. Keys are videos, users or conversations:
bounded, so a window per key fits a task; where rows of a key must be paired, a bucket of time is part of the join key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.grouped import fold_groups


def interval_union(df: DataFrame, key: list[str], start: str = "start_ts", end: str = "end_ts") -> DataFrame:
    """The islands (key, start, end, n) that overlapping or touching intervals form."""
    w = Window.partitionBy(*key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)
    marked = df.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_island")


def covered_length(df: DataFrame, key: list[str], start: str = "start_ts", end: str = "end_ts") -> DataFrame:
    """Length that a key's intervals cover together, and how much of the way from first start to last end that is."""
    islands = interval_union(df, key, start, end)
    length = F.sum(F.col(end) - F.col(start))
    reach = F.max(end) - F.min(start)
    return islands.groupBy(*key).agg(length.alias("covered"), F.coalesce(F.try_divide(length, reach), F.lit(0.0)).alias("coverage"), F.count(F.lit(1)).alias("islands"))


def gaps(df: DataFrame, key: list[str], start: str = "start_ts", end: str = "end_ts") -> DataFrame:
    """(key, start, end) of what lies between islands."""
    islands = interval_union(df, key, start, end)
    after = F.lead(start).over(Window.partitionBy(*key).orderBy(start))
    return islands.select(*key, F.col(end).alias(start), after.alias(end)).filter(F.col(end).isNotNull())


def silence_gaps(turns: DataFrame, key: list[str], first: Column, last: Column) -> DataFrame:
    """Frames from *first* to *last* that no turn (start_frame to end_frame, both included) covers."""
    whole = turns.groupBy(*key).agg(first.alias("_first"), last.alias("_last"))
    own = turns.select(*key, F.col("start_frame").alias("s"), (F.col("end_frame") + 1).alias("e"))
    edges = whole.select(*key, F.col("_first").alias("s"), F.col("_first").alias("e")).unionByName(whole.select(*key, (F.col("_last") + 1).alias("s"), (F.col("_last") + 1).alias("e")))
    found = gaps(own.unionByName(edges), key, "s", "e")
    return found.select(*key, F.col("s").alias("gap_start"), (F.col("e") - 1).alias("gap_end"), (F.col("e") - F.col("s")).alias("frames"))


def fix_overlaps(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Cut neighbours that overlap at the middle between the end of the first and the start of the second."""
    w = Window.partitionBy(*key).orderBy(*order)
    before, after = F.lag("end_ts").over(w), F.lead("start_ts").over(w)
    return df.withColumns(
        {
            "_s": F.when(before > F.col("start_ts"), (before + F.col("start_ts")) / 2).otherwise(F.col("start_ts")),
            "_e": F.when(F.col("end_ts") > after, (F.col("end_ts") + after) / 2).otherwise(F.col("end_ts")),
        }
    ).withColumns({"start_ts": F.col("_s"), "end_ts": F.col("_e")}).drop("_s", "_e")


def temporal_violations(df: DataFrame, key: list[str], ident: str, max_overlap: float = 0.0, max_gap: float = 300.0) -> DataFrame:
    """Neighbours that overlap by more than *max_overlap* (error) or lie more than *max_gap* apart (warning), and inverted spans."""
    good = df.filter("end_ts >= start_ts")
    w = Window.partitionBy(*key).orderBy("start_ts", ident)
    pairs = good.withColumns({"next_id": F.lead(ident).over(w), "_next": F.lead("start_ts").over(w)}).filter("next_id IS NOT NULL")
    delta = F.col("end_ts") - F.col("_next")
    kind = F.when(delta > max_overlap, "overlap").when(-delta > max_gap, "gap")
    found = pairs.select(*key, F.col(ident).alias("span_id"), "next_id", kind.alias("kind"), F.when(kind == "overlap", "error").otherwise("warning").alias("severity"), F.abs(delta).alias("amount")).filter("kind IS NOT NULL")
    bad = df.filter("end_ts < start_ts").select(*key, F.col(ident).alias("span_id"), F.lit(None).cast("long").alias("next_id"), F.lit("inverted").alias("kind"), F.lit("error").alias("severity"), (F.col("start_ts") - F.col("end_ts")).alias("amount"))
    return found.unionByName(bad)


def clamp_durations(df: DataFrame, key: list[str], ident: str, least: float = 1.0, most: float = 300.0) -> DataFrame:
    """Swap inverted spans, move ends so that durations lie between *least* and *most*, and number the spans by start."""
    start, end = F.least("start_ts", "end_ts"), F.greatest("start_ts", "end_ts")
    length = F.least(F.greatest(end - start, F.lit(least)), F.lit(most))
    fixed = df.withColumns({"_s": start, "_e": start + length}).withColumns({"start_ts": F.col("_s"), "end_ts": F.col("_e")}).drop("_s", "_e")
    return fixed.withColumn("number", F.row_number().over(Window.partitionBy(*key).orderBy("start_ts", ident)))


def span_envelopes(blocks: DataFrame, group: list[str], least: float = 0.0, most: float = float("inf")) -> DataFrame:
    """A span per group from its blocks with start before end: first start, last end; spans of a duration outside the bounds go."""
    good = blocks.filter("start_ts < end_ts").groupBy(*group).agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.count(F.lit(1)).alias("n_blocks"))
    return good.filter((F.col("end_ts") - F.col("start_ts")).between(least, most))


def span_envelopes_latest_start(blocks: DataFrame, group: list[str], ident: str) -> DataFrame:
    """As span_envelopes(), but the end is that of the block that starts last; inverted blocks are swapped first."""
    b = blocks.filter("end_ts IS NOT NULL").withColumns({"s": F.least("start_ts", "end_ts"), "e": F.greatest("start_ts", "end_ts")})
    return b.groupBy(*group).agg(F.min("s").alias("start_ts"), F.max_by("e", F.struct("s", ident)).alias("end_ts"))


def span_statistics(spans: DataFrame, key: list[str]) -> DataFrame:
    length = F.col("end_ts") - F.col("start_ts")
    return spans.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(length).alias("mean_duration"), F.min(length).alias("min_duration"), F.max(length).alias("max_duration"), F.min("start_ts").alias("first_start"), F.max("end_ts").alias("last_end")
    )


def temporal_iou(a: DataFrame, b: DataFrame, key: list[str], scales: int = 24, least: float = 1.0) -> DataFrame:
    """Intersection over union of every pair of intervals of a key, where they meet at all.

    Time is cut into cells of *least* times a power of two. An interval belongs to the smallest scale whose cells are as long as it (the
    largest, if none is), where it touches two cells at most. Intervals of two scales meet in the cells of the larger; so pairs are
    found by equal keys, and only near ones are compared. A pair that shares two cells counts in the first.
    """
    level = F.least(F.ceil(F.log2(F.greatest((F.col("end_ts") - F.col("start_ts")) / least, F.lit(1.0)))), F.lit(scales)).cast("int")
    left, right = (df.filter("start_ts <= end_ts").withColumn(own, level) for df, own in ((a, "_la"), (b, "_lb")))
    levels = sorted(r[0] for r in left.select("_la").union(right.select("_lb")).distinct().collect()) or [0]  # scales + 1 numbers at most

    def celled(df: DataFrame, own: str, first: str) -> DataFrame:
        width = F.pow(F.lit(2.0), F.col("_at")) * least
        spread = df.withColumn("_at", F.explode(F.array(*map(F.lit, levels)))).filter(F.col("_at") >= F.col(own))
        cells = F.sequence(F.floor(F.col("start_ts") / width), F.floor(F.col("end_ts") / width))
        return spread.withColumns({first: F.floor(F.col("start_ts") / width), "_cell": F.explode(cells)})

    up_a, up_b = celled(left, "_la", "_fa"), celled(right, "_lb", "_fb")
    right_cols = up_b.select(*key, "_at", "_cell", "_fb", "_lb", *[F.col(c).alias(f"other_{c}") for c in b.columns if c not in key])
    pairs = up_a.join(right_cols, [*key, "_at", "_cell"])
    pairs = pairs.filter((F.col("_at") == F.greatest("_la", "_lb")) & (F.col("_cell") == F.greatest("_fa", "_fb")) & (F.col("start_ts") <= F.col("other_end_ts")) & (F.col("other_start_ts") <= F.col("end_ts")))
    both = F.least("end_ts", "other_end_ts") - F.greatest("start_ts", "other_start_ts")
    union = F.greatest("end_ts", "other_end_ts") - F.least("start_ts", "other_start_ts")
    iou = F.coalesce(F.try_divide(F.greatest(both, F.lit(0.0)), union), F.lit(0.0))
    return pairs.withColumn("iou", iou).select(*a.columns, *[f"other_{c}" for c in b.columns if c not in key], "iou")


def _prefix_best(places: np.ndarray, values: np.ndarray, asks: np.ndarray) -> np.ndarray:
    """Event by event: the greatest of the values filed so far at places up to the event's, then its value is filed there (-inf: nothing is).

    A tree of prefixes by lowest bits: an event costs the logarithm of the number of places. *asks*: the place up to which an event asks.
    """
    size = int(max(places.max(initial=0), asks.max(initial=0))) + 1
    tree = [-np.inf] * (size + 1)
    out = np.empty(len(places))
    for k, (place, value, ask) in enumerate(zip(places.tolist(), values.tolist(), asks.tolist(), strict=True)):
        best, at = -np.inf, ask + 1
        while at > 0:
            if tree[at] > best:
                best = tree[at]
            at &= at - 1
        out[k] = best
        if value != -np.inf:
            at = place + 1
            while at <= size:
                if tree[at] < value:
                    tree[at] = value
                at += at & -at
    return out


def first_container(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each interval, in order: which earlier one that nothing contains is the first to contain it; -1 where there is none.

    Both in n log n. What a contained interval contains, its container contains too; so whether there is one shows in the latest end of all
    earlier intervals that start no later. Which is first is then asked of a sweep by start over trees of the least position by falling end.
    """
    last = np.where(np.isnan(end), start, end)
    opens, known = ~np.isnan(end) & ~np.isnan(start), ~np.isnan(start)
    _, place = np.unique(np.where(known, start, np.inf), return_inverse=True)
    latest = _prefix_best(place, np.where(opens, end, -np.inf), place)
    inside = known & (latest >= last)
    out = np.full(len(start), -1)
    if not inside.any():
        return out
    _, low = np.unique(-np.where(known, last, -np.inf), return_inverse=True)  # place 0 is the latest end
    outer = opens & ~inside
    # sweep by start; of equal starts those that contain are filed before the others ask
    sweep = np.lexsort((np.arange(len(start)), ~outer, start))
    sweep = sweep[outer[sweep] | inside[sweep]]
    first = -_prefix_best(low[sweep], np.where(outer[sweep], -sweep.astype(float), -np.inf), low[sweep])
    asked = inside[sweep]
    out[sweep[asked]] = first[asked].astype(int)
    return out


def absorb_contained(blocks: DataFrame, key: str, ident: str) -> DataFrame:
    """Blocks that no earlier kept block of their key contains, in order of *ident*; how many each absorbed.

    A point (no end) can be contained but contains nothing. Bounds count as inside. The order matters: an outer block
    that comes after an inner one doesn't absorb it. A block without a start is kept and contains nothing.
    """
    kind = blocks.schema[key].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        k = rows[key]
        group = (~((k == k.shift()) | (k.isna() & k.shift().isna()))).to_numpy()[1:].cumsum()
        both = rows[["start_ts", "end_ts"]].to_numpy(float)
        values, place = np.unique(both, return_inverse=True)  # places in the order of values, apart for each key
        spans = np.where(np.isnan(both), np.nan, place.reshape(both.shape) + np.r_[0, group][:, None] * float(len(values)))
        by = first_container(spans[:, 0], spans[:, 1])
        absorbed = np.bincount(by[by >= 0], minlength=len(rows))
        return rows.assign(absorbed=absorbed)[by < 0][[key, ident, "start_ts", "end_ts", "absorbed"]]

    return fold_groups(blocks, key, [ident], ["start_ts", "end_ts"], run, f"{key} {kind}, {ident} long, start_ts double, end_ts double, absorbed long", many=True)


def merge_micro_gaps(blocks: DataFrame, key: str, ident: str, max_gap: float = 2.0, least_overlap: float = 0.6) -> DataFrame:
    """Blocks in order joined to the run before them when the gap is short and the text resembles that of the run's first block."""
    kind = blocks.schema[key].dataType.simpleString()

    def alike(a: str, b: str) -> float:
        x, y = set(a.lower().split()), set(b.lower().split())
        return len(x & y) / len(x | y) if x | y else 0.0

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for k, i, t, s, e in rows[[key, ident, "text", "start_ts", "end_ts"]].itertuples(index=False):
            if out and s - out[-1][4] < max_gap and alike(out[-1][2], t) > least_overlap:
                out[-1][4], out[-1][5] = e, out[-1][5] + 1
            else:
                out.append([k, i, t, s, e, 1])
        return pd.DataFrame(out, columns=[key, ident, "text", "start_ts", "end_ts", "merged"])

    return fold_groups(blocks, key, ["start_ts", ident], ["text", "end_ts"], run, f"{key} {kind}, {ident} long, text string, start_ts double, end_ts double, merged long")


def push_overlaps(df: DataFrame, key: list[str], ident: str) -> DataFrame:
    """Swap inverted intervals, sort them, and push each that begins before the one before it ends, keeping its duration.

    The pushed start is the running maximum of start minus the durations before it, plus these durations: no fold is needed.
    """
    w = Window.partitionBy(*key).orderBy("_s", ident)
    sorted_ = df.withColumns({"_s": F.least("start_ts", "end_ts"), "_d": F.abs(F.col("end_ts") - F.col("start_ts"))})
    before = sorted_.withColumn("_b", F.coalesce(F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    pushed = before.withColumn("_at", F.max(F.col("_s") - F.col("_b")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_b"))
    return pushed.withColumns({"start_ts": F.col("_at"), "end_ts": F.col("_at") + F.col("_d")}).drop("_s", "_d", "_b", "_at")


def run_merge(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Consecutive rows of equal *value* as one: (key, value, start_ts, end_ts, n, run)."""
    w = Window.partitionBy(*key).orderBy(*order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = df.withColumn("_c", change).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*key, "run", value).agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.count(F.lit(1)).alias("n"))



def repair_tree(nodes: DataFrame, key: str) -> DataFrame:
    """(key, node_id, parent_id, start_ts, end_ts): siblings pushed behind one another, children moved into their parents, parents grown to hold them.

    Durations are kept where possible. A key's tree is small; nodes are taken by level, in order of start.
    """
    kind = nodes.schema[key].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        below: dict[str | None, list[tuple]] = {}
        for r in rows.itertuples(index=False):
            below.setdefault(None if pd.isna(r.parent_id) else r.parent_id, []).append((r.start_ts, r.node_id, r.end_ts))
        out: list[list] = []

        def place(parent: str | None, at: float) -> float:
            for start, name, end in sorted(below.get(parent, []), key=lambda x: x[:2]):
                begin = max(start, at)
                row = [rows[key].iloc[0], name, parent, begin, begin + max(end - start, 0.0)]
                out.append(row)
                row[4] = max(row[4], place(name, begin))
                at = row[4]
            return at

        place(None, float("-inf"))
        return pd.DataFrame(out, columns=[key, "node_id", "parent_id", "start_ts", "end_ts"])

    return fold_groups(nodes, key, ["start_ts", "node_id"], ["parent_id", "end_ts"], run, f"{key} {kind}, node_id string, parent_id string, start_ts double, end_ts double")
