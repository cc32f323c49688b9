"""Metrics of predictions: confusion counts, alignment accuracy, BLEU and CIDEr, score normalisation."""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.text import words_of
from tidewright.sources.scratch import written

_MIX = np.uint64(0x9E3779B97F4A7C15)  # 2 ** 64 divided by the golden ratio, odd
#: Bits of the map that tells which n-grams may be in a reference.
_BITS = 1 << 23


def _over(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def binary_metrics(df: DataFrame, group: list[str], truth: str, predicted: str) -> DataFrame:
    """Counts, balanced accuracy, precision, recall and F1 of 0/1 columns; 0 where nothing is to divide. Labels below 0 don't count."""
    t, p = F.col(truth), F.col(predicted)
    counts = df.filter(t >= 0).groupBy(*group).agg(
        F.count_if((t == 1) & (p == 1)).alias("tp"), F.count_if((t == 0) & (p == 1)).alias("fp"), F.count_if((t == 1) & (p == 0)).alias("fn"), F.count_if((t == 0) & (p == 0)).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = _over(tp, tp + fp), _over(tp, tp + fn)
    return counts.withColumns({"precision": precision, "recall": recall, "f1": _over(2 * precision * recall, precision + recall), "balanced_accuracy": (recall + _over(tn, tn + fp)) / 2})


def content_metrics(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Accuracy of step, of transition and of both over aligned updates (step, transition, ref_step, ref_transition); nulls are wrong."""
    step = F.coalesce(F.col("step") == F.col("ref_step"), F.lit(False))
    move = F.coalesce(F.col("transition") == F.col("ref_transition"), F.lit(False))
    return pairs.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg(step.cast("int")).alias("step_accuracy"), F.avg(move.cast("int")).alias("transition_accuracy"), F.avg((step & move).cast("int")).alias("exact_accuracy"))


class _WordHashes(dict):
    """64-bit hashes of words, remembered; forgotten when there are very many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[word] = value = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return value


def _gram_counts(text: bytes | None, most: int, hashes: _WordHashes) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
    """The number of words of *text*, and for each n up to *most* its distinct n-grams as sorted 64-bit hashes, with their counts."""
    words = (text or b"").split()  # bytes are split at the white space of words_of()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    out, g = [], np.zeros(len(h), np.uint64)
    for n in range(1, most + 1):
        g = (g[: max(0, len(h) - n + 1)] ^ h[n - 1 :]) * _MIX
        g ^= g >> np.uint64(32)
        out.append(np.unique(g.view(np.int64), return_counts=True))
    return len(words), out


def _shared(grams: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in *grams* and in *ref*, both sorted and distinct, of what both hold."""
    if not len(grams):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(grams, ref), len(grams) - 1)
    found = np.flatnonzero(grams[at] == ref)
    return at[found], found


class _References(OrderedDict):
    """_gram_counts() of the last thousand references met: many pairs may share one."""

    def __init__(self, most: int, hashes: _WordHashes) -> None:
        super().__init__()
        self.most, self.hashes = most, hashes

    def __missing__(self, text: bytes | None) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
        if len(self) >= 1000:
            self.popitem(last=False)
        self[text] = value = _gram_counts(text, self.most, self.hashes)
        return value


def bleu(pairs: DataFrame, key: str, hyp: str, ref: str, most: int = 4) -> DataFrame:
    """Corpus BLEU-1 to BLEU-*most* of one hypothesis and one reference each: clipped counts, brevity penalty, small smoothing terms.

    A pair's n-grams are counted where its row lies, so only sums are shuffled.
    """
    names = [f"{c}{n}" for c in "gc" for n in range(1, most + 1)] + ["hl", "rl"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        refs = _References(most, hashes)
        for batch in batches:
            total = np.zeros(len(names), np.int64)
            for h, r in zip(*(batch.column(i).cast(pa.binary()) for i in (0, 1)), strict=True):
                (h_size, h_grams), (r_size, r_grams) = _gram_counts(h.as_py(), most, hashes), refs[r.as_py()]
                for n, ((g, c), (rg, rc)) in enumerate(zip(h_grams, r_grams, strict=True)):
                    at, found = _shared(g, rg)
                    total[n] += max(h_size - n, 0)
                    total[most + n] += np.minimum(c[at], rc[found]).sum()
                total[-2:] += (h_size, r_size)
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total.tolist()], names)

    counts = pairs.select(F.col(hyp).alias("h"), F.col(ref).alias("r")).mapInArrow(run, ", ".join(f"{c} long" for c in names))
    met = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    tiny, small = 1e-15, 1e-9
    ratio = (F.col("hl") + tiny) / (F.col("rl") + small)
    penalty = F.when(ratio < 1, F.exp(1 - 1 / ratio)).otherwise(1.0)
    out, product = [], F.lit(1.0)
    for n in range(1, most + 1):
        product = product * ((F.col(f"c{n}") + tiny) / (F.col(f"g{n}") + small))
        out.append((F.pow(product, F.lit(1.0 / n)) * penalty).alias(f"bleu_{n}"))
    return met.select(*out)


def _reference_grams(refs: DataFrame, most: int) -> DataFrame:
    """(rid, times, n, gram, c): the n-grams of each of *refs* (rid, times, r) up to *most*, as 64-bit hashes, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for i, text in enumerate(batch.column(2).cast(pa.binary())):
                for n, (g, c) in enumerate(_gram_counts(text.as_py(), most, hashes)[1], 1):
                    own = batch.slice(i, 1).take(pa.array(np.zeros(len(g), np.int32)))
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(np.full(len(g), n, np.int32)), pa.array(g), pa.array(c)], ["rid", "times", "n", "gram", "c"])

    return refs.select("rid", "times", "r").mapInArrow(run, "rid long, times long, n int, gram long, c long")


def _gram_bits(df: DataFrame) -> bytes:
    """A bitmap of 1 MiB with a bit for the hash of each gram of *df*: those of texts whose bit isn't set are in no reference."""
    at = F.pmod("gram", F.lit(_BITS)) + 1
    found = df.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    parts = {r.b: bytes(r.bits) for r in found}
    return b"".join(parts.get(b, bytes(4096)) for b in range(1, _BITS // 32768 + 1))


def cider(pairs: DataFrame, key: str, hyp: str, ref: str, most: int = 4, sigma: float = 6.0) -> DataFrame:
    """(key, cider) of one hypothesis and one reference each: clipped cosine of tf-idf vectors of n-grams, with a length penalty, times 10.

    Document frequencies are those of the references; a length is the number of bigrams. Grams without a frequency weigh the same in all texts, so
    they are summed where the row lies, and only those that may be in a reference, by a bitmap of fixed size, meet the frequencies.
    """
    refs = written(pairs.groupBy(F.col(ref).alias("r")).agg(F.count(F.lit(1)).alias("times")).withColumn("rid", F.xxhash64("r")), "references")
    n_docs = F.log(refs.agg(F.sum("times").cast("double").alias("n")).scalar())
    counted = written(_reference_grams(refs, most), "reference-grams")
    df = written(counted.groupBy("n", "gram").agg(F.sum("times").alias("df")), "gram-frequencies")
    bits = _gram_bits(df)
    idf = n_docs - F.log(F.greatest(F.coalesce("df", F.lit(1)), F.lit(1)).cast("double"))
    each = lambda value, name: [F.sum(F.when(F.col("n") == n, value)).alias(f"{name}{n}") for n in range(1, most + 1)]
    norms = written(counted.join(df, ["n", "gram"]).groupBy("rid").agg(*each(F.col("c") * F.col("c") * idf * idf, "r")), "reference-norms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = _WordHashes(), np.frombuffer(bits, np.uint8)
        own_refs = _References(most, hashes)
        struct = [pa.field(c, kind) for c, kind in (("n", pa.int32()), ("gram", pa.int64()), ("sq", pa.int64()), ("met", pa.int64()))]
        for batch in batches:
            texts, begin, held = [batch.column(i).cast(pa.binary()) for i in (2, 3)], 0, 0
            parts, size, delta, rest = [], [], [], []
            for i in range(batch.num_rows):
                (h_size, h_grams), (r_size, r_grams) = _gram_counts(texts[0][i].as_py(), most, hashes), own_refs[texts[1][i].as_py()]
                size.append(0)
                rest.append([])
                delta.append(max(h_size - 1, 0) - max(r_size - 1, 0))
                for n, ((g, c), (rg, rc)) in enumerate(zip(h_grams, r_grams, strict=True), 1):
                    met, (at, found) = np.zeros(len(g), np.int64), _shared(g, rg)
                    met[at] = np.minimum(c[at], rc[found]) * rc[found]
                    place = g & (_BITS - 1)
                    may = (known[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
                    rest[-1].append(int((c[~may] * c[~may]).sum()))
                    parts.append((np.full(int(may.sum()), n, np.int32), g[may], (c * c)[may], met[may]))
                    size[-1] += len(parts[-1][0])
                held += size[-1]
                if held >= 200_000 or i == batch.num_rows - 1:
                    grams = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], fields=struct)
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *size]), pa.int32()), grams)
                    keys = batch.slice(begin, i + 1 - begin)
                    yield pa.RecordBatch.from_arrays([keys.column(0), keys.column(1), pa.array(delta, pa.int64()), pa.array(rest, pa.list_(pa.int64())), lists], [key, "rid", "delta", "rest", "grams"])
                    begin, held, parts, size, delta, rest = i + 1, 0, [], [], [], []

    schema = f"`{key}` {pairs.schema[key].dataType.simpleString()}, rid long, delta long, rest array<long>, grams array<struct<n: int, gram: long, sq: long, met: long>>"
    counts = pairs.select(key, F.xxhash64(ref).alias("rid"), F.col(hyp).alias("h"), F.col(ref).alias("r")).mapInArrow(run, schema)
    rows = counts.withColumn("row", F.monotonically_increasing_id()).select("row", key, "rid", "delta", "rest", F.inline_outer("grams"))
    # one pass gives both a text's norm and its product with its reference; equal rows of pairs stay apart
    own = ["row", key, "rid", "delta"]
    sums = rows.join(df, ["n", "gram"], "left").groupBy(*own, "rest").agg(*each(F.col("sq") * idf * idf, "h"), *each(F.col("met") * idf * idf, "d")).join(norms, "rid", "left")
    total = F.lit(0.0)
    for n in range(1, most + 1):
        h = F.sqrt(F.coalesce(f"h{n}", F.lit(0.0)) + F.col("rest")[n - 1] * n_docs * n_docs)
        length, dot = h * F.sqrt(F.coalesce(f"r{n}", F.lit(0.0))), F.coalesce(f"d{n}", F.lit(0.0))
        total = total + F.when(length != 0, dot / length).otherwise(dot)
    penalty = F.exp(-(F.col("delta") * F.col("delta")) / F.lit(2 * sigma * sigma))
    return sums.select(key, (total * penalty / most * 10).alias("cider"))


def meteor_of(hyp: list[str], ref: list[str]) -> float:
    """METEOR's first stage, exact matches, of one pair: weighted harmonic mean with recall, less a penalty for many chunks.

    Words are matched from left to right: to the reference's next place where that goes on a chunk, else to the first free place.
    """
    places: dict[str, deque[int]] = {}
    for j, w in enumerate(ref):
        places.setdefault(w, deque()).append(j)
    used, last, matches, chunks = set(), -2, 0, 0
    for w in hyp:
        at = last + 1 if last + 1 < len(ref) and last >= -1 and ref[last + 1] == w and last + 1 not in used else None
        if at is None:
            free = places.get(w, deque())
            while free and free[0] in used:
                free.popleft()
            at = free.popleft() if free else None
            chunks += at is not None
        if at is None:
            last = -2
            continue
        used.add(at)
        matches, last = matches + 1, at
    if not matches:
        return 0.0
    precision, recall = matches / len(hyp), matches / len(ref)
    return 10 * precision * recall / (recall + 9 * precision) * (1 - 0.5 * (chunks / matches) ** 3)


def meteor(pairs: DataFrame, key: str, hyp: str, ref: str) -> DataFrame:
    """(key, meteor) of one hypothesis and one reference each, by meteor_of() on words between white space."""
    kind = pairs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({key: rows[key], "meteor": [meteor_of((h or "").split(), (r or "").split()) for h, r in zip(rows[hyp], rows[ref], strict=True)]})

    return pairs.select(key, hyp, ref).mapInPandas(run, f"`{key}` {kind}, meteor double")


def text_scores(pairs: DataFrame, key: str, hyp: str, ref: str, names: tuple[str, ...] = ("bleu", "cider", "meteor")) -> DataFrame:
    """(metric, value) of the metrics in *names* over all pairs with a reference that isn't blank; unknown names are skipped, and 0 stands for no pairs."""
    valid = pairs.filter(F.size(words_of(F.col(ref))) > 0)
    mean = lambda df, c: df.agg(F.lit(c).alias("metric"), F.avg(c).alias("value"))
    known = {
        "bleu": lambda: bleu(valid, key, hyp, ref).unpivot([], [f"bleu_{n}" for n in range(1, 5)], "metric", "value"),
        "cider": lambda: mean(cider(valid, key, hyp, ref), "cider"),
        "meteor": lambda: mean(meteor(valid, key, hyp, ref), "meteor"),
    }
    parts = [known[name]() for name in dict.fromkeys(names) if name in known]
    if not parts:
        raise ValueError(f"none of {', '.join(names)} is a metric")
    some = F.coalesce(valid.agg((F.count(F.lit(1)) > 0).alias("s")).scalar(), F.lit(False))
    return reduce(lambda a, b: a.unionByName(b), parts).withColumn("value", F.when(some, F.coalesce("value", F.lit(0.0))).otherwise(0.0))


def zscore_fusion(df: DataFrame, group: list[str], first: str, second: str, weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """Weighted sum of two scores, each normalised within its group by mean and population deviation; raw where that is 0."""
    w = Window.partitionBy(*group)
    z = lambda c: F.when(F.stddev_pop(c).over(w) > 0, (F.col(c) - F.avg(c).over(w)) / F.stddev_pop(c).over(w)).otherwise(F.col(c))
    return df.withColumn("fused", weights[0] * z(first) + weights[1] * z(second))


def softmax_confidence(df: DataFrame, group: list[str], score: str, threshold: float) -> DataFrame:
    """(group, confidence, is_clear): the greatest softmax share of a group's scores."""
    top = df.groupBy(*[F.col(g).alias(f"_g{j}") for j, g in enumerate(group)]).agg(F.max(score).alias("_top"))
    met = df.join(top, [F.col(g).eqNullSafe(F.col(f"_g{j}")) for j, g in enumerate(group)])
    total = met.groupBy(*group).agg(F.sum(F.exp(F.col(score) - F.col("_top"))).alias("_total"))
    return total.select(*group, (1 / F.col("_total")).alias("confidence"), (1 / F.col("_total") >= threshold).alias("is_clear"))


def gap_confidence_of(best: Column, second: Column, least: Column) -> Column:
    """Confidence in the best of some scores from its gap to the second and their range, from 0 to 1."""
    span = best - least
    gap = F.when(span > 0, (best - second) / span).otherwise(1.0)
    raw = 0.7 / (1 + F.exp(-5 * gap)) + 0.3 * F.when(span > 0, span / span).otherwise(0.0)
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))


def best_of_groups(df: DataFrame, group: list[str], order: str, score: str) -> DataFrame:
    """(group, best, confidence, n): the place by *order*, from 0, of each group's first greatest score, and the confidence in it; no group is collected."""
    w = Window.partitionBy(*group)
    ranked = df.withColumns({"_pos": F.row_number().over(w.orderBy(order)) - 1, "_rank": F.row_number().over(w.orderBy(F.col(score).desc(), order))})
    found = ranked.groupBy(*group).agg(
        F.max(F.when(F.col("_rank") == 1, F.col("_pos"))).alias("best"), F.max(score).alias("_a"), F.max(F.when(F.col("_rank") == 2, F.col(score))).alias("_b"), F.min(score).alias("_c"), F.count(F.lit(1)).alias("n")
    )
    return found.select(*group, "best", gap_confidence_of(F.col("_a"), F.col("_b"), F.col("_c")).alias("confidence"), "n")


def similarity_statistics(df: DataFrame, confidence: str, clear: str) -> DataFrame:
    """Counts and share of clear rows, and the confidence's mean, population deviation, extremes and median."""
    n, c = F.count(F.lit(1)), F.col(confidence)
    return df.agg(
        n.alias("total"), F.count_if(clear).alias("clear"), (n - F.count_if(clear)).alias("ambiguous"), (F.count_if(clear) * 100 / n).alias("clear_pct"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("least"), F.max(c).alias("most"), F.median(c).alias("median")
    )


def two_level_mean(df: DataFrame, outer: list[str], inner: list[str], value: str) -> DataFrame:
    """Mean over inner groups of their means; nulls don't count, 0 where there are none."""
    one = df.groupBy(*outer, *inner).agg(F.avg(value).alias("_m"))
    return one.groupBy(*outer).agg(F.coalesce(F.avg("_m"), F.lit(0.0)).alias(value))


def validation_summary(df: DataFrame, valid: str, message: str) -> DataFrame:
    """Valid and invalid rows, their rate, and the first three distinct messages in order of text."""
    ok = F.col(valid)
    first = df.filter(~ok & F.col(message).isNotNull()).select(F.col(message).alias("m")).distinct().orderBy("m").limit(3)
    errors = first.agg(F.array_join(F.array_sort(F.collect_list("m")), "; ").alias("errors"))
    counts = df.agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"), _over(F.count_if(ok), F.count(F.lit(1))).alias("rate"))
    return counts.withColumn("errors", errors.scalar())
