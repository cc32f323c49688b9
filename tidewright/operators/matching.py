"""Matching of generated with reference frames: candidate pairs in a band, least-cost assignment, turn-taking metrics."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.text import jaccard
from tidewright.operators.grouped import fold_groups


def distance_cost(gap: Column, window: tuple[int, int], factor: float, power: float) -> Column:
    """Cost of a match *gap* frames away: *factor* at the window's far end, growing with *power*."""
    reach = max(abs(window[0]), window[1])
    return F.pow(F.abs(gap), F.lit(power)) * (factor / reach**power)


def match_candidates(frames: DataFrame, key: list[str], window: tuple[int, int], factor: float = 0.2, power: float = 1.5) -> DataFrame:
    """(key, gen_frame, ref_frame, text_cost, cost, silent) of each talking generated frame and every frame in the window about it.

    *frames*: frame, gen, ref; an empty string is silence. A silent reference costs 1 in text and is a legal target: a
    generated frame that ends there is redundant. Frames are found by equal keys, one for each offset of the window.
    """
    own = frames.filter("gen <> ''").select(*key, F.col("frame").alias("gen_frame"), "gen", F.explode(F.array(*[F.lit(d) for d in range(window[0], window[1] + 1)])).alias("gap"))
    other = frames.select(*key, F.col("frame").alias("ref_frame"), "ref")
    met = own.withColumn("ref_frame", F.col("gen_frame") + F.col("gap")).join(other, [*key, "ref_frame"])
    text = F.when(F.col("ref") == "", 1.0).otherwise(1 - jaccard(F.col("gen"), F.col("ref")))
    return met.withColumn("text_cost", text).select(*key, "gen_frame", "ref_frame", "text_cost", (F.col("text_cost") + distance_cost(F.col("gap"), window, factor, power)).alias("cost"), (F.col("ref") == "").alias("silent"))


def assign(cost: dict[tuple[int, int], float]) -> dict[int, int]:
    """Row -> column of the matching with most rows and, among these, the least total cost.

    A cost of zero is an edge like any other. Where not all rows find a column, each gets one of its own that costs more than all
    edges together: so as few as can be stay unmatched, and those whose absence is cheapest.
    """
    chosen = _augmented(cost)
    rows = {i for i, _ in cost}
    if len(chosen) == len(rows):
        return chosen
    free, much = max(j for _, j in cost) + 1, 1 + 2 * sum(map(abs, cost.values()))
    spare = {(i, free + k): much for k, i in enumerate(sorted(rows))}
    return {i: j for i, j in _augmented(cost | spare).items() if j < free}


def _augmented(cost: dict[tuple[int, int], float]) -> dict[int, int]:
    """The cheapest matching of all rows by shortest augmenting paths; a row that no free column can be found for is left out."""
    out: dict[int, list[tuple[int, float]]] = {}
    for (i, j), c in cost.items():
        out.setdefault(i, []).append((j, c))
    row_of: dict[int, int] = {}
    col_of: dict[int, int] = {}
    pot_row: dict[int, float] = {i: min(c for _, c in edges) for i, edges in out.items()}
    pot_col: dict[int, float] = {}
    for start in sorted(out):
        dist, via, done = {start: 0.0}, {}, set()
        heap, reached = [(0.0, start)], None
        best_col: dict[int, float] = {}
        order: list[tuple[float, int]] = []
        col_heap: list[tuple[float, int]] = []
        while heap or col_heap:
            if heap:
                d, i = heapq.heappop(heap)
                if i in done:
                    continue
                done.add(i)
                order.append((d, i))
                for j, c in out[i]:
                    if col_of.get(i) == j:
                        continue
                    nd = d + c - pot_row[i] - pot_col.get(j, 0.0)
                    if nd < best_col.get(j, float("inf")) - 1e-15:
                        best_col[j], via[j] = nd, i
                        heapq.heappush(col_heap, (nd, j))
            while col_heap and not heap:
                d, j = heapq.heappop(col_heap)
                if d > best_col[j]:
                    continue
                if j not in row_of:
                    reached = (d, j)
                    heap, col_heap = [], []
                    break
                nxt = row_of[j]
                if nxt not in done:
                    dist[nxt] = d
                    heapq.heappush(heap, (d, nxt))
        if reached is None:
            continue
        total, j = reached
        for d, i in order:
            if d < total:
                pot_row[i] += total - d
        for c, d in best_col.items():
            if d < total:
                pot_col[c] = pot_col.get(c, 0.0) - (total - d)
        while True:
            i = via[j]
            before = col_of.get(i)
            col_of[i], row_of[j] = j, i
            if i == start:
                break
            j = before
    return col_of


def _chosen(gen: np.ndarray, ref: np.ndarray, cost: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Which edges the assignments of all parts take; edges are sorted by part, gen and ref.

    Where each row's cheapest edge (the first of equal ones) ends in a column of its own, these edges are the assignment. Only parts where
    rows compete for a column, or where an edge repeats, need the solver.
    """
    n = len(gen)
    order = np.lexsort((ref, cost, gen, part))
    first = np.ones(n, bool)
    first[1:] = (part[order][1:] != part[order][:-1]) | (gen[order][1:] != gen[order][:-1])
    best = order[first]
    by_column = best[np.lexsort((ref[best], part[best]))]
    clash = (part[by_column][1:] == part[by_column][:-1]) & (ref[by_column][1:] == ref[by_column][:-1])
    again = (part[1:] == part[:-1]) & (gen[1:] == gen[:-1]) & (ref[1:] == ref[:-1])
    hard = np.zeros(int(part[-1]) + 1 if n else 0, bool)
    hard[part[by_column][1:][clash]] = hard[part[1:][again]] = True
    taken = np.zeros(n, bool)
    taken[best[~hard[part[best]]]] = True
    for p in np.flatnonzero(hard):
        a, b = np.searchsorted(part, [p, p + 1])
        chosen = assign({(int(i), int(j)): float(c) for i, j, c in zip(gen[a:b], ref[a:b], cost[a:b], strict=True)})
        taken[a:b] = [chosen.get(int(i)) == int(j) for i, j in zip(gen[a:b], ref[a:b], strict=True)]
    return taken


def match_assign(candidates: DataFrame, key: str, window: tuple[int, int] | None = None) -> DataFrame:
    """(key, gen_frame, ref_frame, text_cost, cost, silent) of the least-cost assignment within each key.

    A key's frames are cut where no candidate reaches over, and each part has an assignment of its own. Rows are dealt by key and sorted, and a task
    goes through them in batches of many parts. With *window* (how far candidates reach, as in match_candidates) it holds no more than a batch and
    the part that is still open, however long the key; without it, a key's rows. Rows without key, frames or cost are no candidates.
    """
    names = [key, "gen_frame", "ref_frame", "text_cost", "cost", "silent"]
    kinds = dict(candidates.dtypes)

    def solved(rows: pd.DataFrame, ended: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
        """The assignment of all parts that have ended, and the rows of those that haven't."""
        gen, ref = rows["gen_frame"].to_numpy(np.int64), rows["ref_frame"].to_numpy(np.int64)
        other = np.r_[True, (rows[key].to_numpy()[1:] != rows[key].to_numpy()[:-1])]
        group = np.cumsum(other) - 1
        span = int(ref.max() - ref.min()) + 1
        placed = (ref - ref.min()) + group * span  # later keys lie wholly above earlier ones
        reach = np.maximum.accumulate(placed)
        least = np.minimum.accumulate(placed[::-1])[::-1]
        begins = np.r_[True, (gen[1:] != gen[:-1]) & (reach[:-1] < least[1:])] | other
        end = len(rows)
        if not ended:
            # the last key may go on: with a window, frames from the last one on can't reach below this reference
            begins_last, last = np.flatnonzero(other)[-1], len(rows)
            if window is not None:
                floor = min(gen[-1] + window[0] - ref.min(), span) + group[-1] * span
                sure = np.flatnonzero(begins & (np.r_[-1, reach[:-1]] < floor) & (gen < gen[-1]) & (np.arange(last) > begins_last))
                begins_last = sure[-1] if len(sure) else begins_last
            end = begins_last
        part = np.cumsum(begins[:end]) - 1
        taken = _chosen(gen[:end], ref[:end], rows["cost"].to_numpy(float)[:end], part)
        return rows.iloc[:end][taken][names], rows.iloc[end:]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for rows in batches:
            if not len(rows):
                continue
            if window is None and held and held[-1][key].iat[-1] == rows[key].iat[-1]:
                held.append(rows)  # all of one key so far, joined once when another begins
                continue
            found, rest = solved(pd.concat([*held, rows], ignore_index=True), False)
            held = [rest]
            yield found
        if held:
            yield solved(pd.concat(held, ignore_index=True), True)[0]

    rows = candidates.select(*names).dropna(subset=[key, "gen_frame", "ref_frame", "cost"])
    schema = f"`{key}` {kinds[key]}, gen_frame long, ref_frame long, text_cost double, cost double, silent boolean"
    return rows.repartition(key).sortWithinPartitions(key, "gen_frame", "ref_frame").mapInPandas(run, schema)


def turn_taking(frames: DataFrame, matches: DataFrame, key: list[str], fps: float, threshold: float = 0.5) -> DataFrame:
    """Metrics over all keys: counts, Jaccard index, missing and redundant rates, precision, recall, F1, semantic score, time difference.

    A match counts in these if its score is over *threshold*; the semantic score also takes those at it.
    """
    score = 1 - F.col("text_cost")
    real, kept = ~F.col("silent"), ~F.col("silent") & (score > threshold)
    made = matches.select(
        real.cast("long").alias("before"), kept.cast("long").alias("matched"), F.col("silent").cast("long").alias("redundant"), F.lit(0).cast("long").alias("missed"),
        F.when(real & (score >= threshold), score).alias("sem"), F.when(kept, F.abs(F.col("gen_frame") - F.col("ref_frame")) / fps).alias("diff"),
    )
    missed = frames.filter("ref <> ''").join(matches.select(*key, F.col("ref_frame").alias("frame")), [*key, "frame"], "left_anti")
    every = made.unionByName(missed.select(F.lit(1).cast("long").alias("missed")), allowMissingColumns=True)
    counts = every.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("before", "matched", "missed", "redundant")], F.avg("sem").alias("sem"), F.avg("diff").alias("diff"))
    return turn_taking_ratios(counts)


def turn_taking_ratios(counts: DataFrame) -> DataFrame:
    """The ratios of one or more rows of counts (before, matched, missed, redundant, sem, diff); 0 where nothing is to divide."""
    over = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    m, b, miss, red = (F.col(c) for c in ("matched", "before", "missed", "redundant"))
    p, r = over(m, b + red), over(m, b + miss)
    return counts.select(
        m.alias("num_matched"), (b - m).alias("num_mismatched"), miss.alias("num_missed"), red.alias("num_redundant"), over(m, b + miss + red).alias("jaccard_index"), over(miss, b + miss).alias("missing_rate"), over(red, b + red).alias("redundant_rate"),
        p.alias("precision"), r.alias("recall"), over(2 * p * r, p + r).alias("f1"), F.coalesce("sem", F.lit(0.0)).alias("semantic_score"), F.coalesce("diff", F.lit(0.0)).alias("time_diff"),
    )


def monotonic_alignment(scores: np.ndarray) -> list[int]:
    """Step of each block (rows) that never falls and grows by one at most, from step 0, with the greatest total score; ties stay."""
    n, m = scores.shape
    best = np.full((n, m), -np.inf)
    moved = np.zeros((n, m), bool)
    best[0, 0] = scores[0, 0]
    for i in range(1, n):
        stay = best[i - 1]
        step = np.concatenate([[-np.inf], best[i - 1, :-1]])
        moved[i] = step > stay
        best[i] = np.maximum(stay, step) + scores[i]
    j = int(best[-1].argmax())
    path = [j]
    for i in range(n - 1, 0, -1):
        j -= int(moved[i, j])
        path.append(j)
    return path[::-1]


def greedy_alignment(scores: np.ndarray, backward: bool = False) -> list[int]:
    """Step of each block, from the first block on step 0 (or back from the last on the last step): stay or move by one, whichever scores best."""
    n, m = scores.shape
    j = m - 1 if backward else 0
    path = [j]
    for i in (range(n - 2, -1, -1) if backward else range(1, n)):
        nxt = j + (-1 if backward else 1)
        if 0 <= nxt < m and scores[i, nxt] > scores[i, j]:
            j = nxt
        path.append(j)
    return path[::-1] if backward else path


def align_blocks(scores: DataFrame, key: str, method: str = "dp") -> DataFrame:
    """(key, block, step) from long rows (key, block, step, score): dp, forward or backward."""
    kind = scores.schema[key].dataType.simpleString()
    how = {"dp": monotonic_alignment, "forward": greedy_alignment, "backward": lambda s: greedy_alignment(s, True)}[method]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        table = rows.pivot_table(index="block", columns="step", values="score", fill_value=0.0).sort_index().sort_index(axis=1)
        path = how(table.to_numpy())
        return pd.DataFrame({key: rows[key].iloc[0], "block": table.index, "step": [table.columns[j] for j in path]})

    return fold_groups(scores, key, ["block", "step"], ["score"], run, f"{key} {kind}, block long, step long")


def resolve_conflicts(forward: DataFrame, backward: DataFrame, key: list[str]) -> DataFrame:
    """Where two alignments (step, confidence) disagree the more confident one holds, the forward one on a tie."""
    b = backward.select(*key, F.col("step").alias("_bs"), F.col("confidence").alias("_bc"))
    met = forward.join(b, key)
    take = F.col("_bc") > F.col("confidence")
    return met.select(*key, F.when(take, F.col("_bs")).otherwise(F.col("step")).alias("step"), F.greatest("confidence", "_bc").alias("confidence"), (F.col("step") != F.col("_bs")).alias("conflict"))
