"""A quality classifier over supervised subword embeddings.

Each word and each of its character n-grams (of lengths 3 and 4, with marked ends) is hashed to a row of a learned
table; a document is the average of its features' rows, and a softmax over it gives the classes. The table is
trained by stochastic gradient descent in numpy, document by document, with a falling rate. As the output is
linear in the average, a trained word is one number: scoring sums these over the words of a text, kept in a bounded table.
Of word pairs one kind is a feature: a word that repeats the one before it counts as one more word, the same for all words.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.training import labelled_sample

_REPEAT = "\x00again"


def word_features(word: str, buckets: int) -> list[int]:
    """Bucket numbers of a word and its character n-grams."""
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in (3, 4) for i in range(len(marked) - n + 1)]
    return [crc32(g.encode("utf-8", "replace")) % buckets for g in [f"={word}", *grams]]


def word_counts(text: str) -> dict[str, int]:
    words = text.split()
    counts = Counter(words)
    if again := sum(map(eq, words, islice(words, 1, None))):
        counts[_REPEAT] = again
    return counts


@dataclass
class SubwordModel:
    """value: what one feature adds to the logit of class 1; bias: the logit of a text without features."""

    value: np.ndarray
    bias: float

    def scorer(self, cache_words: int = 200_000):
        """A function from text to the probability of class 1."""
        value, buckets, words = self.value.tolist(), len(self.value), {}

        def score(text: str | None) -> float:
            total, n = 0.0, 0
            for word, count in word_counts(text or "").items():
                have = words.get(word)
                if have is None:
                    ids = word_features(word, buckets)
                    have = (sum([value[i] for i in ids]), len(ids))
                    if len(word) <= 40:
                        if len(words) >= cache_words:
                            words.clear()
                        words[word] = have
                total += count * have[0]
                n += count * have[1]
            z = self.bias + (total / n if n else 0.0)
            return 1 / (1 + math.exp(-z)) if z > -700 else 0.0

        return score


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], buckets: int, dim: int = 8, epochs: int = 8, rate: float = 10.0, out_rate: float = 0.5, seed: int = 1) -> SubwordModel:
    """SGD on the logarithmic loss over (feature ids, weights that sum to 1, class 0 or 1); the learning rates fall linearly to nothing.

    *rate* is that of the vectors: each gets a small share of a text's gradient, so it is larger than *out_rate*, that of the output
    layer. Without rows every score is one half; with rows of one class only, the scores lean to that class.
    """
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (buckets, dim))
    out, bias = np.zeros((2, dim)), np.zeros(2)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for j in rng.permutation(len(rows)):
            ids, weights, label = rows[j]
            left = 1 - done / steps
            done += 1
            hidden = weights @ table[ids] if len(ids) else np.zeros(dim)
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ out
            out -= out_rate * left * np.outer(p, hidden)
            bias -= 0.1 * out_rate * left * p
            if len(ids):
                table[ids] -= (rate * left * weights)[:, None] * back
    return SubwordModel((table @ (out[1] - out[0])), float(bias[1] - bias[0]))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 3000, buckets: int = 1 << 16, **options) -> SubwordModel:
    """The model learnt from about *rows* labelled documents (a documented bound), whole texts, none of them held out.

    *docs*: doc_id, text; *labels*: doc_id, *label*; other columns don't matter. Null texts are empty ones; rows without doc_id or
    label aren't learnt from; repeated labels count once, with the largest. A document has *buckets* features at most, however long.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, weights = [], []
            for t in batch.column(1):
                sums: Counter[int] = Counter()
                for word, count in word_counts(t.as_py()).items():
                    for i in word_features(word, buckets):
                        sums[i] += count
                n = sum(sums.values()) or 1
                ids.append(list(sums))
                weights.append([c / n for c in sums.values()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float32()))], ["doc_id", "label", "ids", "weights"])

    def fitted(sample: pa.Table) -> pa.Table:
        sample = sample.sort_by("doc_id")
        ids, weights = sample.column("ids"), sample.column("weights")
        data = [(np.asarray(ids[j].values), np.asarray(weights[j].values, np.float64), int(y > 0)) for j, y in enumerate(sample.column("label").to_pylist())]
        model = train(data, buckets, **options)
        return pa.table({"value": pa.array([model.value.tobytes()], pa.binary()), "bias": pa.array([model.bias], pa.float64())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = labelled_sample(docs, labels, label, rows).mapInArrow(features, f"doc_id {kind}, label int, ids array<int>, weights array<float>")
    # the sample is bounded by *rows*: it is one group, fitted by one task, and only the model comes to the driver
    models = sample.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(fitted, "value binary, bias double").collect()
    return SubwordModel(np.frombuffer(models[0][0], np.float64), models[0][1]) if models else SubwordModel(np.zeros(buckets), 0.0)


def score_texts(docs: DataFrame, model: SubwordModel) -> DataFrame:
    """(doc_id, score): the probability of class 1 of each whole text, of any length; null and empty texts get the model's bias alone.

    Equal texts score alike, repeated rows and rows without doc_id have a row each, other columns don't matter, and an empty table
    gives an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.value.astype(np.float32), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = SubwordModel(*sent.value).scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([score(t.as_py()) for t in batch.column(1)], pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
