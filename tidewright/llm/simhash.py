"""SimHash near-duplicates found by the generalised pigeonhole principle.

The first 64 bits are grouped into partitions of correlated bits. Partition i gets a threshold t_i; if the sum of
(t_i + 1) exceeds the allowed distance, then two fingerprints within that distance differ in at most t_i
bits of some partition i, so no link is lost whatever the thresholds. A dynamic program chooses the thresholds (and
the number of partitions) that cost least by the candidate counts estimated on a bounded sample of fingerprints.
Fingerprints meet in buckets: each is filed under its partition's bits with up to t_i / 2 of them flipped, from both
sides; where t_i is odd, one more flip is filed to probe with only. Every pair in a bucket is verified on all bits, and a bucket
leaves its verified pairs where there are no more of them than rows, else a spanning forest. Buckets with very many rows are split over tasks. Components
of the links are found by alternating star contraction.

A fingerprint may have more words of 64 bits: the search stays on the first, and the others make the verification sharper, so that
a wide distance on the first doesn't link texts that are unlike. Such links are candidates, and the Jaccard similarity of the
whole shingle sets decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, comb, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.graph import components
from tidewright.llm.ngram_join import DENOMINATOR, NUMERATOR, WordHashes, large_bucket_pairs, parity_sketch, sketched_pairs, token_set, verified_pairs
from tidewright.llm.shared import unused_names, write_table, written
from tidewright.sources.scratch import forget

#: Bits of each byte value, most significant first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
#: Buckets up to this size are compared together, row against row at growing distance; larger ones alone.
_SMALL = 24
#: Rows of a larger bucket that are compared with all others at once.
_BLOCK = 128
#: Rows of a bucket that stay in one task; larger buckets are split.
_HOT = 8192


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 hashes of the words' *width*-word shingles, repeats included; fewer words are one shingle, none give none."""
    from xxhash import xxh64_digest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    cut = map(slice, starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist())
    return np.frombuffer(b"".join([xxh64_digest(joined[s], seed) for s in cut]), ">u8").astype(np.uint64)


def _majority(hashes: np.ndarray) -> int:
    """The word whose bits are set in over half of *hashes*."""
    codes = hashes.astype(">u8").view(np.uint8).reshape(-1, 8) + np.arange(8, dtype=np.int64) * 256
    counts = np.bincount(codes.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(counts.ravel() * 2 > len(hashes)).tobytes(), "big")


def fingerprint_words(text: str | None, width: int = 4, seed: int = 42, words: int = 1) -> list[int]:
    """SimHash of the shingles: *words* numbers of 64 bits. The first is made of the XXH64 hashes, the others of numbers mixed from these."""
    hashes = shingle_hashes(text, width, seed)
    if not len(hashes):
        return [0] * words
    out = [_majority(hashes)]
    for j in range(1, words):
        x = hashes + np.uint64(0x9E3779B97F4A7C15 * j % (1 << 64))  # the splitmix64 step
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(_majority(x ^ (x >> np.uint64(31))))
    return out


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """SimHash of the words' *width*-word shingles: a bit is 1 if it is set in over half of their XXH64 hashes."""
    return fingerprint_words(text, width, seed)[0]


def _word_names(words: int) -> list[str]:
    return ["fp", *[f"fp{j}" for j in range(1, words)]]


def _node(words: list[int]) -> int:
    """What names a fingerprint: its only word, or a hash of all words; as a signed number."""
    from xxhash import xxh64_intdigest

    name = words[0] if len(words) == 1 else xxh64_intdigest(np.array(words, np.uint64).tobytes(), 42)
    return name - (1 << 64) if name >> 63 else name


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, words: int = 1) -> DataFrame:
    """(doc_id, node, fp, fp1, ...): the fingerprint of each whole text as signed longs, and its name. Null and empty texts have fingerprint 0."""
    names = _word_names(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fingerprint_words(t.as_py(), width, seed, words) for t in batch.column(1)]
            fps = np.array(rows, np.uint64).reshape(-1, words).view(np.int64)
            nodes = pa.array(list(map(_node, rows)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), nodes, *[pa.array(fps[:, j]) for j in range(words)]], ["doc_id", "node", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, node long, " + ", ".join(f"{c} long" for c in names))


def _group_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """*m* groups of bits of nearly equal size; each takes, one by one, the free bit that correlates most with it."""
    bits = (sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    x = bits.astype(np.float64) - bits.mean(axis=0)
    norm = np.sqrt((x * x).sum(axis=0))
    norm[norm == 0] = 1
    corr = np.abs((x.T @ x) / np.outer(norm, norm))
    free, groups = set(range(64)), []
    for i in range(m):
        size = 64 // m + (i < 64 % m)
        group = [min(free, key=lambda b: (-corr[b, list(free)].sum(), b))]
        free.remove(group[0])
        while len(group) < size:
            best = min(free, key=lambda b: (-corr[b, group].sum(), b))
            free.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def _near(sample: np.ndarray, group: list[int], most: int) -> np.ndarray:
    """Shares of the sample's pairs that differ in at most 0, 1, ..., *most* bits of *group*."""
    part = sample[:1024] & np.uint64(sum(1 << b for b in group))
    counts = np.bincount(np.bitwise_count(part[:, None] ^ part[None, :]).ravel(), minlength=65)
    counts[0] -= len(part)  # each with itself
    return counts.cumsum()[: most + 1] / max(1, counts.sum())


def plan_partitions(sample: np.ndarray, n: int, distance: int, row_cost: float = 1.0, pair_cost: float = 0.01, most_rows: int = 600) -> list[tuple[list[int], int]]:
    """[(bits, threshold)]: the cheapest set of partitions for *n* fingerprints that files none under more than *most_rows* keys a partition.

    The cost is that of the rows filed plus that of the candidate pairs expected: those that even bits would give and those that
    the sample shows. It decides time only: any plan with sum of (threshold + 1) over *distance* finds every link.
    """
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in range(1, distance + 2):
        groups = _group_bits(sample, m)
        # state: thresholds' sum so far (at most distance + 1) -> (cost, choice)
        state: dict[int, tuple[float, list[tuple[list[int], int]]]] = {0: (0.0, [])}
        for group in groups:
            moves: list[tuple[int, float, int | None]] = [(0, 0.0, None)]
            near = _near(sample, group, distance)
            for t in range(distance + 1):
                kept, rows = (sum(comb(len(group), k) for k in range(r + 1)) for r in (t // 2, (t + 1) // 2))
                if rows > most_rows:
                    break
                share = kept * rows / 2.0 ** len(group) + near[t]
                moves.append((t + 1, rows * n * row_cost + share * n * n / 2 * pair_cost, t))
            after: dict[int, tuple[float, list[tuple[list[int], int]]]] = {}
            for have, (cost, chosen) in state.items():
                for gain, extra, t in moves:
                    to = min(distance + 1, have + gain)
                    new = (cost + extra, chosen if t is None else [*chosen, (group, t)])
                    if to not in after or new[0] < after[to][0]:
                        after[to] = new
            state = after
        if distance + 1 in state and (best is None or state[distance + 1][0] < best[0]):
            best = state[distance + 1]
    assert best is not None
    return best[1]


class _Rows:
    """Rows of buckets: key, node, flip (which bits were flipped: 0 for none, below 0 to probe with only) and the words, sorted by key."""

    def __init__(self, key: np.ndarray, node: np.ndarray, flip: np.ndarray, words: np.ndarray, limits: tuple[int, int]) -> None:
        self.key, self.node, self.flip, self.words, self.limits = key, node, flip, words, limits

    def part(self, at) -> _Rows:
        return _Rows(self.key[at], self.node[at], self.flip[at], self.words[at], self.limits)

    def meet(self, i, j) -> np.ndarray:
        """Whether the rows at *i* and *j* are compared here: not probes with probes, nor what two nodes also meet by.

        Nodes with equal flips meet without any too; nodes with unequal flips meet again with these exchanged, so those count
        that give the smaller node the earlier flip.
        """
        a, b = self.flip[i], self.flip[j]
        first = (self.node[i] < self.node[j]) == (np.abs(a) < np.abs(b))
        return ((a >= 0) | (b >= 0)) & np.where(a == b, a == 0, first)

    def near(self, i, j) -> np.ndarray:
        """Whether the rows at *i* and *j* are linked: by the first word's distance and by that of all words."""
        d = np.bitwise_count(self.words[i] ^ self.words[j])
        return (d[..., 0] <= self.limits[0]) & (d.sum(axis=-1, dtype=np.int64) <= self.limits[1])

    def forest(self) -> list[np.ndarray]:
        """Links that connect what is connected in one bucket: a search that visits each row once."""
        left, out = np.arange(len(self.key)), []
        while len(left) > 1:
            stack, left = [left[0]], left[1:]
            while stack and len(left):
                at = stack.pop()
                near = self.near(at, left) & self.meet(at, left)
                if near.any():
                    found, left = left[near], left[~near]
                    out.append(np.stack([np.full(len(found), at), found], axis=1))
                    stack += found.tolist()
        return out

    def pairs(self) -> np.ndarray | None:
        """All links in one bucket, or None if there are more of them than rows."""
        found, n = [], 0
        for i in range(0, len(self.key), _BLOCK):
            close = np.bitwise_count(self.words[i : i + _BLOCK, None, 0] ^ self.words[None, i:, 0]) <= self.limits[0]
            a, b = np.nonzero(close)
            ahead = a < b
            a, b = a[ahead] + i, b[ahead] + i
            ok = self.meet(a, b)
            a, b = a[ok], b[ok]
            ok = self.near(a, b)
            found.append(np.stack([a[ok], b[ok]], axis=1))
            n += len(found[-1])
            if n > len(self.key):
                return None
        return np.concatenate(found)

    def links(self) -> np.ndarray:
        """Distinct verified links of whole buckets, as pairs of nodes."""
        n = len(self.key)
        start = np.concatenate([[0], np.flatnonzero(np.diff(self.key)) + 1, [n]])
        size = np.diff(start)
        rows, bucket, out = np.flatnonzero(np.repeat(size <= _SMALL, size)), np.repeat(np.arange(len(size)), size), []
        for step in range(1, _SMALL):
            rows = rows[rows + step < n]
            rows = rows[bucket[rows] == bucket[rows + step]]
            if not len(rows):
                break
            close = rows[np.bitwise_count(self.words[rows, 0] ^ self.words[rows + step, 0]) <= self.limits[0]]
            close = close[self.meet(close, close + step)]
            close = close[self.near(close, close + step)]
            out.append(np.stack([close, close + step], axis=1))
        near = np.concatenate(out) if out else np.empty((0, 2), np.int64)
        many = np.bincount(bucket[near[:, 0]], minlength=len(size)) > size
        out = [near[~many[bucket[near[:, 0]]]]]
        for i in np.flatnonzero(many | (size > _SMALL)):
            own = self.part(slice(start[i], start[i + 1]))
            found = None if many[i] else own.pairs()
            out += [x + start[i] for x in (own.forest() if found is None else [found])]
        nodes = self.node[np.concatenate(out)]
        nodes = nodes[nodes[:, 0] != nodes[:, 1]]
        return np.unique(np.sort(nodes, axis=1), axis=0)


def bits_at(similarity: float, bits: int, deviations: float = 0.0) -> int:
    """Bits in which fingerprints of *bits* bits of sets with this Jaccard similarity differ, on average plus so many standard deviations."""
    p = acos(2 * similarity / (1 + similarity)) / pi
    return int(bits * p + deviations * sqrt(bits * p * (1 - p)))


def fingerprint_links(nodes: DataFrame, distance: int = 4, sample_rows: int = 4096, words: int = 1, all_bits: int | None = None) -> DataFrame:
    """(a, b): links between *nodes* (node, fp, fp1, ...; one row each) that connect all that are near.

    Near are nodes whose first words differ in at most *distance* bits and all words together in at most *all_bits*, if that is given.
    The partitions are planned on *sample_rows* nodes at most, those with the smallest hashes.
    """
    names = _word_names(words)
    n = nodes.count()
    sample = nodes.select("fp").orderBy(F.xxhash64("fp", "node")).limit(sample_rows).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    if n < 2:
        return nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    limits = (distance, 64 * words if all_bits is None else all_bits)
    signed = lambda bits: int(np.uint64(sum(1 << b for b in bits)).astype(np.int64))
    filed: list[Column] = []
    for i, (group, t) in enumerate(plan_partitions(sample, n, distance)):
        masked = F.col("fp").bitwiseAND(F.lit(signed(group)))
        flips = [c for r in range((t + 1) // 2 + 1) for c in combinations(group, r)]
        for j, c in enumerate(flips):
            k = F.xxhash64(F.lit(i), masked.bitwiseXOR(F.lit(signed(c))))
            filed.append(F.struct(k.alias("k"), F.lit(j if len(c) <= t // 2 else -j).alias("flip")))
    rows = nodes.select("node", *names, F.explode(F.array(*filed)).alias("f")).select("f.k", "f.flip", "node", *names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # of the last bucket, which may go on in the next batch; it has _HOT rows or a few times that
        for batch in batches:
            k = batch["k"].to_numpy()
            cut = int(np.searchsorted(k, k[-1])) if len(k) else 0
            if cut or held and len(k) and held[-1]["k"].iat[-1] != k[0]:
                yield linked([*held, batch.iloc[:cut]])
                held = []
            held.append(batch.iloc[cut:])
        if held:
            yield linked(held)

    def linked(parts: list[pd.DataFrame]) -> pd.DataFrame:
        whole = pd.concat(parts, ignore_index=True)
        bits = np.stack([whole[c].to_numpy(np.int64).view(np.uint64) for c in names], axis=1)
        found = _Rows(whole["k"].to_numpy(np.int64), whole["node"].to_numpy(np.int64), whole["flip"].to_numpy(np.int64), bits, limits).links()
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    pairs = lambda dealt: dealt.sortWithinPartitions("k").mapInPandas(run, "a long, b long")
    hot = written(rows.groupBy("k").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > _HOT), "hot-buckets")
    if hot.isEmpty():
        return pairs(rows.repartition("k")).distinct()
    # a hot bucket's rows are dealt into chunks, and each pair of chunks is a bucket of its own
    chunks = F.ceil(F.col("_n") / (_HOT // 2)).cast("long")
    split = rows.join(hot, "k").withColumn("_c", F.pmod(F.xxhash64(F.lit(3), F.col("node")), chunks))
    other = F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))
    split = split.withColumn("_o", other).withColumn("k", F.xxhash64("k", F.least("_c", "_o"), F.greatest("_c", "_o"))).select(rows.columns)
    cold = rows.join(hot.select("k"), "k", "left_anti")
    return pairs(cold.select(rows.columns).unionByName(split).repartition("k")).distinct()


def alike_components(docs: DataFrame, nodes: DataFrame, links: DataFrame, width: int, words: int) -> DataFrame:
    """(node, root), as from components(), of all links whose whole shingle sets have a Jaccard similarity of 0.8 or more among what *links* (a, b) connects.

    *nodes*: (node, rep). The links are a forest of candidates, so those that hold leave groups in parts, which other pairs of the group may still link. All
    pairs between the parts of a group are therefore compared by parity sketches, and what these don't rule out by the whole
    sets: of the nodes that *links* connects, no pair with that similarity stays apart. Only texts that stand for a linked node are read again.
    """
    links, links_path = write_table(links, "candidates")
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = written(ends.join(nodes.select("node", "rep"), "node"), "wanted")
    texts, texts_path = write_table(node_texts(docs, wanted, width, words), "candidate-texts")

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                sets = [token_set(t.as_py(), width, hashes) for t in part.column(1).cast(pa.binary())]
                columns = [part.column(0), pa.array(map(len, sets), pa.int32()), pa.array(map(parity_sketch, sets), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "n", "sketch"])

    sketches, sketches_path = write_table(texts.select("node", "text").mapInArrow(sketched, "node long, n int, sketch binary"), "sketches")
    found = written(verified_pairs(sketched_pairs(links, sketches), texts, width), "alike")
    parts = components(found).toDF("n1", "root")
    rows = written(wanted.select("node").join(parts, F.col("node") == F.col("n1"), "left").select("node", F.coalesce("root", "node").alias("part")), "parts")

    def between(pairs: DataFrame) -> DataFrame:
        """(part, root): the components that *pairs* of nodes make of parts."""
        met = pairs.join(rows.toDF("a", "p"), "a").join(rows.toDF("b", "q"), "b").filter("p <> q")
        return components(met.select(F.col("p").alias("a"), F.col("q").alias("b"))).toDF("x", "root")

    failed = links.join(found, ["a", "b"], "left_anti")  # those that hold lie within a part
    groups = between(failed).select("x", F.col("root").alias("s"))
    # a group's smallest part is its name and stands in no row of its own
    groups = groups.unionByName(groups.select(F.col("s").alias("x"), "s").distinct())
    torn = written(rows.join(groups, F.col("part") == F.col("x")).select("s", "node", "part"), "torn")
    more = large_bucket_pairs(torn, sketches, across=True).join(links, ["a", "b"], "left_anti")
    met = rows.join(between(verified_pairs(more, texts, width)), F.col("part") == F.col("x"), "left").select("node", F.coalesce("root", "part").alias("root"))
    roots = written(met.filter("node <> root"), "roots")
    for path in (links_path, texts_path, sketches_path):
        forget(path)
    return roots


def node_texts(docs: DataFrame, wanted: DataFrame, width: int, words: int) -> DataFrame:
    """(node, text): a text for each of *wanted* (node, rep), from the document *rep*. Rows may repeat a doc_id with other texts, so the fingerprint decides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [i for i, (node, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)) if _node(fingerprint_words(t.as_py(), width, 42, words)) == node]
            yield batch.take(pa.array(own, pa.int32()))

    met = docs.select(F.col("doc_id").alias("id"), "text").join(wanted, F.col("id").eqNullSafe(F.col("rep"))).select("node", "text")
    return met.mapInArrow(run, "node long, text string").dropDuplicates(["node"])


def near_duplicates(docs: DataFrame, distance: int = 4, width: int = 4, words: int = 1, alike: bool = False) -> DataFrame:
    """(doc_id, fp, component_id): each document's fingerprint (its first word) and the smallest doc_id reachable over links.

    *docs*: doc_id, text; other columns don't matter. Fingerprints at most *distance* bits apart are linked. With *alike*, those are
    candidates whose first words are at most *distance* bits apart, and all *words* together by the bits that a Jaccard similarity of 0.8 gives
    plus two standard deviations; of what candidates connect, all pairs whose sets of shingles have that similarity or more are linked.

    Texts without words, null ones among them, have fingerprint 0 and are linked like any other. Texts of any length count whole. Repeated
    rows keep a row each. Rows without doc_id belong to their component but never name it, unless it has no other. Whole
    groups of equal fingerprints are one node, so copies are never expanded into pairs. An empty table gives an empty table.
    """
    names = _word_names(words)
    fps = written(fingerprints(docs, width, words=words), "fingerprints")
    classes = written(fps.groupBy("node", *names).agg(F.min("doc_id").alias("rep")), "classes")
    if not alike:
        roots = components(fingerprint_links(classes, distance, words=words))
    else:
        links = fingerprint_links(classes, distance, words=words, all_bits=bits_at(NUMERATOR / DENOMINATOR, 64 * words, 2.0))
        roots = alike_components(docs, classes, links, width, words)
    return name_groups(fps, roots, classes)


def name_groups(fps: DataFrame, roots: DataFrame, classes: DataFrame) -> DataFrame:
    """*fps* (doc_id, node, fp) with component_id by the *roots* of components(); *classes*: (node, rep), the smallest doc_id of each node."""
    rooted = classes.select("node", "rep").join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_node = rooted.join(named, "root").select("node", "component_id")
    return fps.join(by_node, "node").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """*docs* with one document of each group of near-duplicates: the one with the smallest doc_id.

    Groups without any doc_id keep all their rows. Of rows that repeat the kept doc_id one stays.
    """
    return keep_first(docs, near_duplicates(docs, **options))


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """*docs* with the rows that keep_one() keeps of the groups *found* (doc_id, component_id)."""
    own, rows = unused_names(2, docs)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias(rows))
    kept = kept.select(F.col("doc_id").alias(own), rows)
    met = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(own)))
    single = (F.col(rows) == 1) | F.col(own).isNull()
    return met.filter(single).unionByName(met.filter(~single).dropDuplicates([own])).drop(own, rows)
