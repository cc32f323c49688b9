"""Language identification by unigram models over a public vocabulary, summed over all segmentations.

Each language has a probability for every piece of a fixed vocabulary. The probability of a word is the sum over all ways to
cut it into pieces, found by the forward recursion; that of a text is the product over its words, so the words of a text are
counted and each is summed once. The probabilities are learnt by expectation and maximisation: the
backward recursion gives the expected number of times that each piece is used, over all segmentations.
An automaton lists the pieces that a word holds. Many words are worked on together, for all languages at once, in logarithms, so
a word may have any length.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.shared import held_out, written

#: More than the longest piece of any vocabulary.
_LONGEST = 256


def load_vocabulary(path: str) -> dict[str, int]:
    """Pieces of a SentencePiece model without special ones: piece -> row. A word's start is marked as in the model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    return {p: i for i, p in enumerate(pieces)}


def words_of(text: str) -> Iterator[str]:
    """Lower-cased whole words with the start mark; words without a letter don't count."""
    for word in text.lower().split():
        if word.isalpha() or any(map(str.isalpha, word)):
            yield "▁" + word


class Lattice:
    """All places of pieces in *words*. Word w has a node before each of its characters and one after the last."""

    def __init__(self, words: list[str], finder: PieceFinder) -> None:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.first = np.concatenate([[0], np.cumsum(lengths[:-1] + 1)]) if len(words) else lengths
        self.last = self.first + lengths
        self.nodes = int(lengths.sum()) + len(words)
        # joined with line feeds, which no word holds, a character's place is its node
        ends, rows, sizes = finder.find("\n".join(words))
        self.row, self.start, self.end = rows, ends - sizes, ends
        word = np.searchsorted(self.first, self.start, "right") - 1
        self.depth, self.rest = ends - self.first[word], self.last[word] - self.start
        self.word = word


class PieceFinder:
    """Finds every place of every piece of a vocabulary; a character that is no piece counts as one of the row after the last."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, row in vocabulary.items():
            if "\n" not in piece:
                self.automaton.add_word(piece, row * _LONGEST + len(piece))
        if vocabulary:
            self.automaton.make_automaton()
        self.unknown = len(vocabulary)
        self.single = np.array(sorted({ord(p) for p in vocabulary if len(p) == 1} | {10}), np.uint32)

    def find(self, joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ends, rows, lengths) of the places of pieces in *joined*."""
        hits = np.fromiter(chain.from_iterable(self.automaton.iter(joined)) if self.unknown else (), np.int64).reshape(-1, 2)
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        alone = np.flatnonzero(~np.isin(chars, self.single)) + 1
        ends = np.concatenate([hits[:, 0] + 1, alone])
        rows = np.concatenate([hits[:, 1] // _LONGEST, np.full(len(alone), self.unknown)])
        return ends, rows, np.concatenate([hits[:, 1] % _LONGEST, np.ones(len(alone), np.int64)])


def _sums(lattice: Lattice, p: np.ndarray, forward: bool) -> np.ndarray:
    """Logarithms of the sums over the segmentations before each node (or after it): (nodes, languages).

    Steps go by the distance from a word's start (or end), over all words at once. Each sum is taken in proportion to that of
    the neighbouring node, so neither long words nor unlikely ones underflow.
    """
    to, by, step, near = (lattice.end, lattice.start, lattice.depth, -1) if forward else (lattice.start, lattice.end, lattice.rest, 1)
    order = np.lexsort((to, step))
    to, by, row = to[order], by[order], lattice.row[order]
    out = np.zeros((lattice.nodes, p.shape[1]))
    cuts = np.flatnonzero(np.diff(step[order])) + 1
    for a, b in zip([0, *cuts], [*cuts, len(to)], strict=True):
        if a == b:
            continue
        at = to[a:b]
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        parts = np.exp(out[by[a:b]] - out[at + near]) * p[row[a:b]]
        out[at[new]] = out[at[new] + near] + np.log(np.add.reduceat(parts, new, axis=0))
    return out


def _chunks(words: list[str], most_chars: int = 400_000) -> Iterator[slice]:
    """Slices of *words* of about *most_chars* characters."""
    begin = size = 0
    for at, word in enumerate(words):
        size += len(word) + 1
        if size >= most_chars:
            yield slice(begin, at + 1)
            begin, size = at + 1, 0
    if begin < len(words):
        yield slice(begin, len(words))


def _portions(texts: pa.Array, most_chars: int = 2_000_000) -> Iterator[list[str | None]]:
    """Texts in lists of about *most_chars* characters: enough to share the work on new words, few enough to hold their counts."""
    held, size = [], 0
    for t in texts:
        held.append(t.as_py())
        size += len(held[-1] or "") + 100
        if size >= most_chars:
            yield held
            held, size = [], 0
    if held:
        yield held


@dataclass
class LanguageModel:
    """languages in order; p: probability of each piece (rows; then one for an unknown character) by language."""

    languages: list[str]
    p: np.ndarray
    vocabulary: dict[str, int]
    finder: PieceFinder = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.finder = PieceFinder(self.vocabulary)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.zeros((len(words), len(self.languages)))
        for part in _chunks(words):
            lattice = Lattice(words[part], self.finder)
            out[part] = _sums(lattice, self.p, True)[lattice.last]
        return out

    def scorer(self, cache_cells: int = 2_000_000):
        """A function from texts to (language, share of its probability) each; und and 0 where a text has no letter.

        The scores of words are kept in a table of *cache_cells* numbers at most, whatever the number of languages.
        """
        cache_words = max(1, cache_cells // max(1, len(self.languages)))
        rows: dict[str, int] = {}
        table = np.zeros((cache_words, len(self.languages)))

        def known(new: set[str]) -> bool:
            """Whether the table can hold all of *new* at once; then it does."""
            if len(rows) + len(new) > cache_words:
                rows.clear()
                return False
            fresh, at = list(new), len(rows)
            table[at : at + len(fresh)] = self.word_scores(fresh)
            rows.update(zip(fresh, range(at, at + len(fresh)), strict=True))
            return True

        def summed(count: Counter[str]) -> np.ndarray:
            words = list(count)
            if not rows.keys() >= count.keys():  # a text with more words than the table holds
                return sum(np.array([count[w] for w in part]) @ self.word_scores(part) for part in (words[i : i + 50_000] for i in range(0, len(words), 50_000)))
            return np.fromiter(count.values(), float, len(count)) @ table[[rows[w] for w in words]]

        def score(texts: list[str | None]) -> list[tuple[str, float]]:
            counts = [Counter(words_of(t or "")) for t in texts]
            new = {w for count in counts for w in count if w not in rows}
            if new and not known(new):
                known({w for count in counts for w in count})
            found = []
            for count in counts:
                if not count:
                    found.append(("und", 0.0))
                    continue
                z = summed(count)
                e = np.exp(z - z.max())
                best = int(e.argmax())
                found.append((self.languages[best], float(e[best] / e.sum())))
            return found

        return score


def fit_languages(counts: list[Counter[str]], languages: list[str], vocabulary: dict[str, int], rounds: int = 3, smoothing: float = 0.1) -> LanguageModel:
    """Expectation and maximisation over the words' *counts* of each language; every piece keeps *smoothing* of a use."""
    k, n_rows = len(languages), len(vocabulary) + 1
    words = sorted(set().union(*counts)) if counts else []
    weight = np.array([[c[w] for c in counts] for w in words], float).reshape(-1, k)
    model = LanguageModel(languages, np.full((n_rows, k), 1 / n_rows), vocabulary)
    for _ in range(rounds):
        used = np.full((n_rows, k), smoothing)
        for part in _chunks(words):
            lattice = Lattice(words[part], model.finder)
            before, after = _sums(lattice, model.p, True), _sums(lattice, model.p, False)
            whole = before[lattice.last][lattice.word]
            use = np.exp(before[lattice.start] + after[lattice.end] - whole) * model.p[lattice.row] * weight[part][lattice.word]
            for lang in range(k):
                used[:, lang] += np.bincount(lattice.row, use[:, lang], n_rows)
        model.p = used / used.sum(axis=0)
    return model


def fit_on_documents(docs: DataFrame, vocabulary_path: str, per_language: int = 300, rows: int = 30_000, **options) -> LanguageModel:
    """The model learnt from about *per_language* documents of each language, about *rows* of all together at most, none held out.

    Both bounds are parameters; the first gives way to the second, down to one document of a language. Words are counted over
    whole texts, on the executors; the counts of that sample go to the driver. Documents without doc_id or lang aren't learnt from.
    Without any that can be, no language is known.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = written(known.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")), "languages")
    n = sizes.count()
    if n <= 100_000:  # a row per language: with so few it can go to every executor
        sizes = F.broadcast(sizes)
    each = max(1, min(per_language, rows // max(1, n)))
    chosen = F.pmod(F.xxhash64(F.lit(11), F.col("doc_id")), F.col("_n")) < each
    sample = known.select("doc_id", "lang", "text").join(sizes, "lang").filter(chosen).select("lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, Counter[str]] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[lang].update(words_of(text or ""))
        rows = [(lang, w, n) for lang, count in sums.items() for w, n in count.items()]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["lang", "word", "n"])

    found = sample.mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, Counter[str]] = defaultdict(Counter)
    for lang, word, n in zip(*[found.column(c).to_pylist() for c in ("lang", "word", "n")], strict=True):
        counts[lang][word] = n
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((1, 0)), {})
    return fit_languages([counts[x] for x in languages], languages, load_vocabulary(vocabulary_path), **options)


def predict_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score): the likeliest language of each whole text and its share of the probability.

    A text that is null, empty or has no letter is und, with score 0, and so is every text where no language was learnt. Texts of
    any length count whole. Of languages that tie the first by code point is taken. Every row of *docs* (doc_id, text) gives a row,
    repeated ones and those without doc_id too; other columns don't matter, and an empty table gives an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.p.astype(np.float32), model.vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, p, vocabulary = sent.value
        score = LanguageModel(languages, p.astype(np.float64), vocabulary).scorer() if languages else lambda texts: [("und", 0.0)] * len(texts)
        for batch in batches:
            found = [x for part in _portions(batch.column(1)) for x in score(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
