"""Greedy bins of keys that are larger than a task.

A greedy bin starts where the one before it ends, so bins form a chain through the items of a key. Prefix sums turn the end of a bin into a search, every item
becomes a pointer to the first item of the next bin, and pointers are composed: inside a block of items in numpy, between blocks by
pointer doubling with joins. No key is folded by one task, and what is joined is only the items at the head of each block that a bin from before it can end at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.sources.scratch import written

_PER_CELL = 4  # items of a block's head, on average, in one of the cells in which pointers meet them


def _whole_blocks(block: str, work: Callable[[pa.Table], pa.Table]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """*work* on all rows of one block at a time, of batches that are sorted by *block*."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            p = batch.column(block).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(p)) + 1).tolist(), len(p)]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                if a == z:
                    continue
                if held and held[-1].column(block)[0].as_py() != p[a]:
                    yield from work(pa.Table.from_batches(held)).to_batches()
                    held = []
                held.append(batch.slice(a, z - a))
        if held:
            yield from work(pa.Table.from_batches(held)).to_batches()

    return run


class _Block:
    """One block's items: where keys begin, and each item's pointer to the first item of the next bin.

    mark is what a pointer searches: a bin that starts at cost before[i] ends at the first item whose mark is at least before[i] + reach. Costs begin
    at 0 in each key's part of the block; in the search, keys lie too far apart for a bin to pass from one into the next but one.
    """

    def __init__(self, names: pa.ChunkedArray, cost: np.ndarray, reach: int, after: bool) -> None:
        n = len(cost)
        codes = names.combine_chunks().dictionary_encode().indices.to_numpy()
        self.start = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])
        self.end = np.concatenate([self.start[1:], [n]])
        part = np.repeat(np.arange(len(self.start)), self.end - self.start)
        total = np.cumsum(cost)
        self.before = total - cost - (total - cost)[self.start][part]
        self.mark = self.before if after else np.minimum(self.before + cost, self.before + reach - 1)
        base = (total - cost)[self.start][part] + part * (reach + 1)
        self.next = np.minimum(np.searchsorted(self.mark + base, self.before + base + reach), self.end[part])

    def chase(self) -> tuple[np.ndarray, np.ndarray]:
        """For each item: the last bin's first item, and the number of bins, of a chain from it to the end of its key's part."""
        last, bins = np.arange(len(self.next)), np.ones(len(self.next), np.int64)
        jump = np.where(self.next < np.repeat(self.end, self.end - self.start), self.next, last)
        hop = (jump != last).astype(np.int64)
        while hop.any():
            jump, hop = jump[jump], hop + hop[jump]
            if np.array_equal(jump, jump[jump]):
                break
        return jump, bins + hop

    def starts(self, first: int) -> np.ndarray:
        """Which items begin a bin, if the first part's chain enters at item *first* and all other parts' at their first items."""
        at = np.concatenate([[first] if first < self.end[0] else [], self.start[1:]]).astype(np.int64)
        found = np.zeros(len(self.next) + 1, bool)
        ends = np.zeros(len(self.next) + 1, bool)
        ends[self.end] = True
        while len(at):
            found[at] = True
            at = self.next[at]
            at = at[~ends[at] & ~found[at]]
        # an item that ends one part begins another, whose own chain holds it
        return found[:-1]


def _names(df: DataFrame, wanted: str) -> list[str]:
    tail = "_"
    while any(c.lower().endswith(tail) for c in df.columns):
        tail += "_"
    return [w + tail for w in wanted.split()]


def greedy_bins(df: DataFrame, key: str, order: list[str], cost: str | Column, most: int, closes: str = "before", bin: str = "bin", block_rows: int = 1_000_000) -> DataFrame:
    """*df* with *bin* (long, from 0 in each key): consecutive items by *order*, packed greedily, whatever the size of a key.

    closes="before": an item that would bring its bin to *most* or more opens the next one, unless the bin is empty or holds nothing but costs of 0.
    closes="after": the item that brings its bin over *most* is its last. Costs are whole numbers; null counts as 0 and a negative one is an error. A null
    key is a key of its own; nulls come first in *order*, and items that tie in it go by cost, so that ties in both are alike. Repeated rows are items each,
    other columns pass through, and an empty table gives an empty one.

    Rows are sorted into blocks of about *block_rows*; a block is the most that a task holds. Between blocks only heads travel: the items that a bin from the
    block before can end at.
    """
    if most < 1 or closes not in ("before", "after"):
        raise ValueError("most is at least 1, and closes is 'before' or 'after'")
    after = closes == "after"
    reach = most + 1 if after else most
    k, c, p, line = _names(df, "k c p line")
    amount = F.coalesce(F.col(cost) if isinstance(cost, str) else cost, F.lit(0)).cast("long")
    amount = F.when(amount < 0, F.raise_error(F.lit("a cost is negative")).cast("long")).otherwise(F.least(amount, F.lit(reach)))
    named = df.withColumns({k: F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")), c: amount})
    blocks = max(1, -(-named.count() // block_rows))
    rows = written(named.repartitionByRange(blocks, k, *order, c).withColumn(p, F.spark_partition_id()), "chain-rows")

    def heads(block: pa.Table) -> pa.Table:
        b = _Block(block.column(k), block.column(c).to_numpy(), reach, after)
        last, bins = b.chase()
        out = []
        for side in range(min(2, len(b.start))):
            s, e = (b.start[0], b.end[0]) if side == 0 else (b.start[-1], b.end[-1])
            # a bin from before the block ends no further in it than reach
            to = 1 + (min(int(np.searchsorted(b.mark[s:e], reach)), e - s - 1) if side == 0 else 0)
            at = np.arange(s, s + to)
            low = np.concatenate([[-reach - 1], b.mark[at[:-1]]])
            size = int(b.before[e - 1] + block.column(c)[int(e) - 1].as_py())
            fixed = {"p": block.column(p)[0].as_py(), "side": side, "k": block.column(k)[int(s)].as_py(), "total": size, "mark": int(b.mark[e - 1])}
            moving = {"at": at, "low": low, "high": np.minimum(b.mark[at], reach), "out": b.before[last[at]] + reach, "bins": bins[at]}
            out.append(pa.table({n: pa.array([v] * to) for n, v in fixed.items()} | {n: pa.array(v, pa.int64()) for n, v in moving.items()}, schema=head_schema))
        return pa.concat_tables(out)

    head_schema = pa.schema([("p", pa.int32()), ("side", pa.int32()), ("k", pa.string()), ("total", pa.int64()), ("mark", pa.int64())] + [(n, pa.int64()) for n in ("at", "low", "high", "out", "bins")])
    dealt = rows.repartition(p).sortWithinPartitions(p, k, *order, c)
    found = written(dealt.select(p, k, c).mapInArrow(_whole_blocks(p, heads), "p int, side int, k string, total long, mark long, at long, low long, high long, out long, bins long"), "chain-heads")
    entries = _entries(found, reach)
    if entries is None:
        filled = dealt.withColumns({line: F.lit(0).cast("long"), bin: F.lit(0).cast("long")})
    else:
        met = rows.join(entries.select(F.col("p").alias(f"{p}2"), F.col("at").alias(line), F.col("first").alias(bin)), F.col(p) == F.col(f"{p}2"), "left")
        met = met.withColumns({line: F.coalesce(line, F.lit(0).cast("long")), bin: F.coalesce(bin, F.lit(0).cast("long"))}).drop(f"{p}2")
        filled = met.repartition(p).sortWithinPartitions(p, k, *order, c)

    def number(block: pa.Table) -> pa.Table:
        b = _Block(block.column(k), block.column(c).to_numpy(), reach, after)
        enter, first = block.column(line)[0].as_py(), block.column(bin)[0].as_py()
        begun = np.cumsum(b.starts(enter))
        part = np.repeat(np.arange(len(b.start)), b.end - b.start)
        own = begun - begun[b.start][part]
        # the first part may begin with the rest of a bin; *first* is the number of the bin that its chain enters with
        own[: b.end[0]] = begun[: b.end[0]] - 1 + first
        return block.set_column(block.column_names.index(bin), bin, pa.array(own, pa.int64()))

    return filled.mapInArrow(_whole_blocks(p, number), filled.schema).select(*[f"`{x}`" for x in df.columns], bin)


def _entries(heads: DataFrame, reach: int) -> DataFrame | None:
    """(p, at, first): for blocks that go on with a key, the item its chain enters at (one past all where it doesn't) and that bin's number. None: no such block."""
    own = Window.partitionBy("k").orderBy("p", "side")
    pieces = heads.groupBy("p", "side", "k").agg(F.max("total").alias("total"), F.max("mark").alias("mark"), F.min("at").alias("head"))
    start = F.coalesce(F.sum("total").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.withColumns({"start": start, "place": F.row_number().over(own) - 1, "pieces": F.count(F.lit(1)).over(Window.partitionBy("k"))}).filter("pieces > 1")
    pieces = written(pieces.withColumn("gone", F.lag(F.col("start") + F.col("mark")).over(own)), "chain-pieces")
    longest = pieces.agg(F.max("pieces")).first()[0]
    if longest is None:
        return None
    node = F.col("p").cast("long") * (1 << 40) + F.col("at")
    long_heads = heads.drop("total", "mark").join(pieces.select("p", "side", "start", "gone", "place", "head"), ["p", "side"])
    long_heads = long_heads.select("k", "p", "at", "place", "head", node.alias("a"), "bins", *[(F.col(n) + F.col("start")).alias(n) for n in ("low", "high", "out")], "gone")
    long_heads = written(long_heads, "chain-nodes")
    # only items behind the key's first piece are pointed at, by what has come up to "gone" before it
    piece = long_heads.agg(F.count(F.lit(1)) / F.count_distinct("p", "k")).first()[0]
    width = max(1, int(reach * _PER_CELL / max(piece, _PER_CELL)))
    open_ = long_heads.filter("place > 0").select(F.col("k").alias("k2"), F.col("a").alias("b"), F.greatest("low", "gone").alias("low"), F.least("high", F.col("gone") + reach).alias("high")).filter("low < high")
    cell = lambda x: F.floor(x / width)
    open_ = open_.withColumn("cell", F.explode(F.sequence(cell(F.col("low") + 1), cell(F.col("high")))))
    asked = long_heads.select("k", "a", "bins", "out", cell(F.col("out")).alias("c"))
    jumps = asked.join(open_, (F.col("k") == F.col("k2")) & (F.col("c") == F.col("cell")) & (F.col("low") < F.col("out")) & (F.col("out") <= F.col("high"))).select("a", "b", "bins")
    seen = long_heads.filter("place = 0 AND at = head").select("a", F.lit(0).cast("long").alias("first"))

    def level(jump: DataFrame) -> DataFrame:
        """*jump* from the chains' first nodes and from nodes that *jump* itself leads to: the others are passed by no chain that far on. Chains meet, so these grow few."""
        jump = written(jump, "chain-jumps")
        return written(jump.join(jump.select(F.col("b").alias("a")).union(seen.select("a")).distinct(), "a", "left_semi"), "chain-jumps")

    levels = [level(jumps)]
    while 1 << len(levels) < longest:
        one = levels[-1]
        two = one.select(F.col("a").alias("b"), F.col("b").alias("far"), F.col("bins").alias("more"))
        levels.append(level(one.join(two, "b").select("a", F.col("far").alias("b"), (F.col("bins") + F.col("more")).alias("bins"))))
    for jump in reversed(levels):
        seen = written(seen.unionByName(seen.join(jump, "a").select(F.col("b").alias("a"), (F.col("first") + F.col("bins")).alias("first"))), "chain-seen")
    hit = seen.join(long_heads.select("a", "p", F.col("k").alias("k2"), "at", "bins"), "a")
    along = pieces.select("k", "p", "place").join(hit.withColumnRenamed("p", "p2"), (F.col("p") == F.col("p2")) & (F.col("k") == F.col("k2")), "left")
    so_far = F.last(F.col("first") + F.col("bins"), ignorenulls=True).over(Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    along = along.withColumn("carried", so_far).filter("place > 0")
    return along.select("p", F.coalesce("at", F.lit((1 << 40) - 1)).alias("at"), F.coalesce("first", "carried").alias("first"))
