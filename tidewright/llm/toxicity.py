"""Toxicity categories by a chain of linear classifiers.

The categories stand in an order. The model of each sees the text's features and the probabilities of the categories before
it. So that it learns from probabilities such as it will meet on new texts, these come from models that were trained
without the row's fold. Features are hashed words and their beginnings, and beginnings that several words share, chosen on the sample by their chi-squared
statistic; a text of any length is scored by the distinct words that it holds.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewright.llm.training import labelled_sample

#: The chain's order. The last one is the label itself.
CATEGORIES = ("explicit", "coded", "toxic")
#: Stands for "holds any feature" where features are named by their hashes.
ANY = 1 << 40
_WORDS = re.compile(r"[^\W\d_]+").findall


def text_words(text: str | None) -> set[str]:
    return set(_WORDS((text or "").lower()))


def word_features(word: str) -> list[int]:
    """32-bit hashes of a word and of its beginnings of 4 to 6 characters.

    There are many words and few telling ones: in a small table clean words would often fall on these.
    """
    return [crc32(f.encode("utf-8", "replace")) - (1 << 31) for f in [f"={word}", *[f"<{word[:n]}" for n in range(4, min(7, len(word)))]]]


#: A text has a beginning's feature at a level if so many of its distinct words share it; the masks keep the levels' hashes apart.
LEVELS = ((1, 0), (2, 0x5BD1E995), (4, 0x2545F491))


def text_features(words: set[str]) -> set[int]:
    """Features of a text: those of its words, and those that several of its words share."""
    shared = Counter(f for w in words for f in word_features(w))
    return {f ^ mask for f, n in shared.items() for least, mask in LEVELS if n >= least}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _fit_linear(rows: np.ndarray, cols: np.ndarray, extra: np.ndarray, y: np.ndarray, n_features: int, l2: float = 0.002, steps: int = 400) -> np.ndarray:
    """Weights (features, extra columns, bias) of a logistic model on presence features (pairs row, column), by Nesterov's method."""
    n, m = len(y), n_features + extra.shape[1] + 1
    w, look, most = np.zeros(m), np.zeros(m), 1.0
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    per_row = np.bincount(rows, minlength=n) if len(rows) else np.zeros(n)
    rate = 1 / (0.25 * float((balance * (per_row + extra.shape[1] + 1)).mean()) + l2)
    for step in range(steps):
        z = np.bincount(rows, look[cols], n) + extra @ look[n_features:-1] + look[-1]
        g = balance * (_sigmoid(z) - y) / n
        grad = np.concatenate([np.bincount(cols, g[rows], n_features), g @ extra, [g.sum()]]) + l2 * look
        new = look - rate * grad
        most, before = (1 + math.sqrt(1 + 4 * most * most)) / 2, most
        look, w = new + (before - 1) / most * (new - w), new
    return w


@dataclass
class ChainModel:
    """features: hash -> column; weights: one vector a category over columns, earlier categories' probabilities and bias."""

    categories: tuple[str, ...]
    features: dict[int, int]
    weights: list[np.ndarray]

    def scorer(self, cache_words: int = 200_000):
        """A function from text to the categories' probabilities."""
        n, features = len(self.features), self.features
        values = np.stack([w[:n] for w in self.weights], axis=1) if n else np.zeros((0, len(self.weights)))
        tails = [w[n:] for w in self.weights]
        telling = {f ^ mask for f in features for _, mask in LEVELS}
        words: dict[str, tuple[int, ...]] = {}

        def score(text: str | None) -> list[float]:
            shared: Counter[int] = Counter()
            for word in text_words(text):
                have = words.get(word)
                if have is None:
                    have = tuple(f for f in word_features(word) if f in telling)
                    if len(word) <= 40:
                        if len(words) >= cache_words:
                            words.clear()
                        words[word] = have
                if have:
                    shared.update(have)
            held = {features[f ^ mask] for f, n in shared.items() for least, mask in LEVELS if n >= least and f ^ mask in features}
            if held:
                held.add(features[ANY])
            sums = values[sorted(held)].sum(axis=0) if held else np.zeros(len(tails))
            p: list[float] = []
            for z, tail in zip(sums, tails, strict=True):
                z += tail[-1] + sum(a * b for a, b in zip(tail, p, strict=False))
                p.append(1 / (1 + math.exp(-min(60.0, max(-60.0, z)))))
            return p

        return score


def fit_chain(features: list[np.ndarray], labels: np.ndarray, categories: tuple[str, ...], folds: int = 5, least_docs: int = 3, chi2: float = 40.0, lift: float = 5.0, most_features: int = 20_000) -> ChainModel:
    """The chain over *labels* (rows by categories, 0 or 1). Row j belongs to fold j modulo *folds*.

    A feature is kept if at least *least_docs* rows have it and for some category the share of them that is in it is at least *lift* times
    the category's own (half of them at most are asked for), with a chi-squared statistic of at least *chi2* and more rows than chance
    gives to any of so many features; at most *most_features* are kept. Common words, which come with length, drop out.
    """
    n = len(features)
    cols = np.concatenate(features).astype(np.int32) if n else np.zeros(0, np.int32)
    rows = np.repeat(np.arange(n, dtype=np.int32), [len(f) for f in features]) if n else cols
    names, have = np.unique(cols, return_counts=True)
    best = np.zeros(len(names))
    for k in range(len(categories) if n else 0):
        in_it = labels[:, k] == 1
        own, counts = np.unique(cols[in_it[rows]], return_counts=True)
        a, p = np.zeros(len(names)), in_it.mean()
        a[np.searchsorted(names, own)] = counts
        with np.errstate(divide="ignore", invalid="ignore"):
            stat = (a - have * p) ** 2 / (have * p * (1 - p) * (1 - have / n))
        # by chance a rows of a feature are all in the category with p ** a; over all features that must stay unlikely
        sure = a * -math.log(max(p, 1e-9)) >= math.log(max(len(names), 1)) + 8
        best = np.fmax(best, np.where(sure & (a >= min(0.5, lift * p) * have), np.nan_to_num(stat, posinf=0.0), 0.0))
    able = np.flatnonzero((best >= chi2) & (have >= least_docs))
    chosen = np.sort(names[able[np.argsort(-best[able], kind="stable")[:most_features]]])
    place = np.searchsorted(chosen, cols).clip(0, max(len(chosen) - 1, 0))
    kept = chosen[place] == cols if len(chosen) else np.zeros(len(cols), bool)
    rows, cols = rows[kept], place[kept]
    some = np.unique(rows)  # one more feature: that a row has any at all, so that a single telling word weighs enough
    rows, cols, size = np.concatenate([rows, some]), np.concatenate([cols, np.full(len(some), len(chosen))]), len(chosen) + 1
    fold, earlier, weights = np.arange(n) % folds, np.zeros((n, 0)), []
    for k in range(len(categories)):
        y = labels[:, k].astype(float)
        weights.append(_fit_linear(rows, cols, earlier, y, size) if n else np.zeros(size + k + 1))
        if k + 1 < len(categories):
            out = np.zeros(n)
            for f in range(folds):
                own, rest = fold[rows] == f, np.flatnonzero(fold != f)
                place = np.full(n, -1)
                place[rest] = np.arange(len(rest))
                if not len(rest):
                    continue
                w = _fit_linear(place[rows[~own]], cols[~own], earlier[rest], y[rest], size)
                z = np.bincount(rows, w[cols], n) + earlier @ w[size : -1] + w[-1]
                out[fold == f] = _sigmoid(z)[fold == f]
            earlier = np.column_stack([earlier, out])
    return ChainModel(categories, {int(f): j for j, f in enumerate(chosen)} | {ANY: size - 1}, weights)


def without_copies(features: list[np.ndarray], labels: list[tuple]) -> list[int]:
    """Places of the rows that stay: copies of a document would make all its words look telling, so the first of them stays.

    A copy has the same label and the same smallest features as a row that stays, and a Jaccard similarity of 0.8 or more to it.
    """
    kept: dict[tuple, list[int]] = defaultdict(list)
    for j, f in enumerate(features):
        alike = kept[labels[j], tuple(f[:4].tolist())]
        shared = (len(np.intersect1d(f, features[i], assume_unique=True)) / max(1, len(f) + len(features[i])) for i in alike)
        if not any(s * 9 >= 4 for s in shared) and not (alike and not len(f)):
            alike.append(j)
    return sorted(j for rows in kept.values() for j in rows)


def explicit_rows(features: list[np.ndarray], toxic: np.ndarray, share: float = 0.5, least_docs: int = 3) -> np.ndarray:
    """1 for the toxic rows that hold one of the most telling features, taken by chi-squared until *share* of the toxic rows hold one."""
    n, total = len(features), int(toxic.sum())
    if not total or total == n:
        return np.zeros(n, np.int64)
    cols = np.concatenate(features)
    rows = np.repeat(np.arange(n), [len(f) for f in features])
    names, have = np.unique(cols, return_counts=True)
    own, counts = np.unique(cols[toxic[rows] == 1], return_counts=True)
    a, p = np.zeros(len(names)), total / n
    a[np.searchsorted(names, own)] = counts
    with np.errstate(divide="ignore", invalid="ignore"):
        stat = np.nan_to_num((a - have * p) ** 2 / (have * p * (1 - p) * (1 - have / n)), posinf=0.0)
    able = np.flatnonzero((have >= least_docs) & (a > have * p))
    held = np.zeros(n, bool)
    for f in names[able[np.argsort(-stat[able], kind="stable")]]:
        if held.sum() >= share * total:
            break
        held[rows[cols == f]] = True
        held &= toxic == 1
    return held.astype(np.int64)


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = 6000, **options) -> ChainModel:
    """The chain of CATEGORIES learnt from about *rows* labelled documents (a documented bound), whole texts.

    *docs*: doc_id, text; *labels*: doc_id, toxic; other columns don't matter. Null texts are empty ones; rows without doc_id or
    label aren't learnt from; repeated labels count once, with the largest. Without any labelled text the probabilities are one half.
    """

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [sorted(text_features(text_words(t.as_py()))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "label", "ids"])

    def fitted(sample: pa.Table) -> pa.Table:
        sample = sample.sort_by("doc_id")
        toxic = np.array([int(y > 0) for y in sample.column("label").to_pylist()], np.int64)
        features = [np.asarray(x.values, np.int32) for x in sample.column("ids")]
        explicit = explicit_rows(features, toxic)
        first = without_copies(features, list(zip(toxic.tolist(), explicit.tolist(), strict=True)))
        features, toxic, explicit = [features[j] for j in first], toxic[first], explicit[first]
        model = fit_chain(features, np.stack([explicit, toxic - explicit, toxic], axis=1), CATEGORIES, **options)
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = labelled_sample(docs, labels, "toxic", rows).mapInArrow(prepared, f"doc_id {kind}, label int, ids array<int>")
    # the sample is bounded by *rows*: it is one group, fitted by one task, and only the model comes to the driver
    models = sample.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(fitted, "model binary").collect()
    return pickle.loads(models[0][0]) if models else fit_chain([], np.zeros((0, len(CATEGORIES)), np.int64), CATEGORIES, **options)


def score_toxicity(docs: DataFrame, model: ChainModel) -> DataFrame:
    """*docs* (text, ...) with p_<category> for each category added, scored on whole texts of any length.

    Null and empty texts get the probabilities of a text without features. Other columns, nulls in them too, pass through, but
    columns named p_<category> are replaced. Rows and their number never change: equal texts score alike, repeated rows stay, and an
    empty table gives an empty table.
    """
    names = [f"p_{c}" for c in model.categories]
    docs = docs.drop(*names)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, *[StructField(name, DoubleType()) for name in names]])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = sent.value.scorer()
        for batch in batches:
            found = [score(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([p[k] for p in found], pa.float64()) for k in range(len(names))]], [*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """*docs* without those whose probability of being toxic is at least *threshold*, under the names and order of its columns.

    The scores stand under names of their own, so columns of any name pass through. Nulls and copies as in score_toxicity().
    """
    model = fit_toxicity(docs, labels, **options)
    held = docs.select("text", F.struct(*[F.col(f"`{c}`").alias(f"c{j}") for j, c in enumerate(docs.columns)]).alias("row"))
    kept = score_toxicity(held, model).filter(F.col("p_toxic") < threshold)
    return kept.select(*[F.col(f"row.c{j}").alias(c) for j, c in enumerate(docs.columns)])
