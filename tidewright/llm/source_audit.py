"""How far the sources of a language diverge in what they say: exact differences of smoothed term shares.

Every pair of sources is compared over the whole vocabulary of its language, but never term by term: tiles of terms by sources tally
how many terms have each combination of counts (joint count histograms), the terms that one or both lack follow from the sources' own
histograms, and the difference is taken once per distinct combination and multiplied by how often it occurs.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.shared import written

#: Of UTF-8 bytes: A-Z lower-cased, a-z and all that stands beyond ASCII kept, blanks for the rest.
_LETTERS = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
#: Shares are counted in parts of this number.
SCALE = 1_000_000_000
#: Sources of one side of a tile, and terms of a tile: bounds of one task's arrays.
TILE = (64, 4096)


def term_counts(docs: DataFrame, held: int = 200_000) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and in how many of its documents; null text, lang and source are ''.

    A term is a longest run of ASCII letters and characters beyond ASCII, with A-Z lower-cased. A row is a document, so repeated rows count as often
    as they stand there. Very long texts count whole; texts without terms give no rows. A task counts up to about *held* terms (and those of
    one more text) before it sends them on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: defaultdict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        size = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()))), strict=True):
                n, docs = counts[lang, source]
                size -= len(n)
                terms = text.translate(_LETTERS).split()
                n.update(terms)
                docs.update(set(terms))
                size += len(n)
                if size > held:
                    yield from sent(counts)
                    counts.clear()
                    size = 0
        yield from sent(counts)

    def sent(counts: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            same = lambda x, size=len(n): pa.DictionaryArray.from_arrays(pa.array(np.zeros(size, np.int32)), pa.array([x])).cast(pa.string())
            columns = [same(lang), same(source), pa.array(n.keys(), pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array(map(docs.__getitem__, n), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")]).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least: int = 30) -> DataFrame:
    """(lang, source, term, n): those of term_counts() whose term is in at least *least* documents of its language."""
    held = counts.groupBy("lang", "term").agg(F.sum("docs").alias("held")).filter(F.col("held") >= least)
    return counts.join(held.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 5) / (total + 5 * terms)), in decimals: sums of any corpus fit and nothing is rounded."""
    wide = lambda c: c.cast("decimal(22,0)")
    return F.call_function("div", (wide(count) + F.lit(5)) * F.lit(SCALE), wide(total) + wide(terms) * F.lit(5)).cast("long") + 1


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, place, total, terms): each occurring group, its number in its language, its occurrences and its language's kept terms."""
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    vocabulary = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    met = groups.join(own, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    place = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")
    return met.select("lang", "source", place.alias("place"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"))


def _tile(places: np.ndarray, blocks_of: np.ndarray, terms: np.ndarray, counts: np.ndarray, blocks: tuple[int, int], width: int) -> pd.DataFrame:
    """Distinct (a, b, count of a, count of b) with both counts above 0 and a < b, and how many terms have them.

    A row is a source (its number and block), a term and a count; *blocks* of *width* sources are those that meet, the smaller first.
    """
    of_term = np.unique(terms, return_inverse=True)[1]
    values, of_count = np.unique(counts, return_inverse=True)
    size = len(values) + 1
    sides = []
    for block in blocks:
        here = blocks_of == block
        dense = np.zeros((width, int(of_term.max()) + 1), np.int64)
        dense[places[here] % width, of_term[here]] = of_count[here] + 1  # a count by its rank from 1, 0 for none
        sides.append(dense)
    out = []
    for i in np.flatnonzero(sides[0].any(axis=1)):
        first = i + 1 if blocks[0] == blocks[1] else 0
        held = np.flatnonzero(sides[0][i])
        theirs = sides[1][first:, held]
        j, t = np.nonzero(theirs)
        if len(j):
            key, times = np.unique((j * size + sides[0][i, held[t]]) * size + theirs[j, t], return_counts=True)
            a, b = blocks[0] * width + i, blocks[1] * width + first + key // size // size
            out.append(np.column_stack([np.full(len(key), a), b, values[key // size % size - 1], values[key % size - 1], times]))
    return pd.DataFrame(np.concatenate(out) if out else np.empty((0, 5), np.int64), columns=["a", "b", "count_a", "count_b", "times"])


def joint_histograms(kept: DataFrame, groups: DataFrame, tile: tuple[int, int] = TILE) -> DataFrame:
    """(lang, a, b, count_a, count_b, times): for each pair of sources (numbers, a < b) how many terms have each pair of counts above 0.

    Terms are dealt into buckets, sources into blocks, of the sizes in *tile*: a task sees one bucket of some thousand terms of two blocks, whatever the
    number of terms or sources. What it sends on are distinct combinations, which are summed before they are shuffled.
    """
    most = groups.agg(F.max("terms"), F.max("place")).first()
    buckets, blocks = 1 + (most[0] or 0) // tile[1], 1 + (most[1] or 0) // tile[0]
    rows = kept.join(groups.select("lang", "source", "place"), ["lang", "source"])
    rows = rows.select("lang", F.xxhash64("term").alias("term"), F.pmod(F.hash("term"), F.lit(buckets)).alias("bucket"), "place", F.col("n"), F.expr(f"place div {tile[0]}").alias("block"))
    tiles = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    tiles = tiles.select("lang", "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "term", "place", "n", "block")

    def tally(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        place, block, term, n = (rows[c].to_numpy(np.int64) for c in ("place", "block", "term", "n"))
        out = _tile(place, block, term, n, (int(key[2]), int(key[3])), tile[0])
        out.insert(0, "lang", key[0])
        return out

    found = tiles.groupBy("lang", "bucket", "low", "high").applyInPandas(tally, "lang string, a long, b long, count_a long, count_b long, times long")
    return found.groupBy("lang", "a", "b", "count_a", "count_b").agg(F.sum("times").alias("times"))


def pair_divergence(kept: DataFrame, groups: DataFrame, tile: tuple[int, int] = TILE) -> DataFrame:
    """(lang, source, item, value): for each source and each other of its language, the sum of the differences of their shares over all kept terms.

    The terms that only one source has, and those that neither has, are implied: f(c, 0) is counted for all of a source's terms and taken back
    for those that both have. Sums are whole numbers.
    """
    side = lambda tag: groups.select(F.col("lang").alias(f"lang_{tag}"), F.col("source").alias(f"source_{tag}"), F.col("place").alias(tag), F.col("total").alias(f"total_{tag}"), F.col("terms").alias(f"terms_{tag}"))
    a, b = side("a"), side("b")
    pairs = a.join(b, (F.col("lang_a") == F.col("lang_b")) & (F.col("a") < F.col("b"))).drop("lang_b", "terms_b")
    p = lambda count, tag: share(count, F.col(f"total_{tag}"), F.col("terms_a"))
    zero = F.lit(0)
    apart = lambda x, y: F.abs(p(x, "a") - p(y, "b"))
    both = joint_histograms(kept, groups, tile).withColumnsRenamed({"lang": "l", "a": "x", "b": "y"})
    met = both.join(pairs, (F.col("l") == F.col("lang_a")) & (F.col("x") == F.col("a")) & (F.col("y") == F.col("b")))
    more = apart(F.col("count_a"), F.col("count_b")) - apart(F.col("count_a"), zero) - apart(zero, F.col("count_b"))
    shared = met.groupBy("l", "x", "y").agg(F.sum(more * F.col("times")).alias("more"), F.sum("times").alias("common"))
    # each source's own histogram against the other's share of a term it lacks
    own = kept.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("times")).withColumnsRenamed({"lang": "l", "source": "s"})
    alone = []
    for tag, value in (("a", apart(F.col("n"), zero)), ("b", apart(zero, F.col("n")))):
        matched = own.join(pairs, (F.col("l") == F.col("lang_a")) & (F.col("s") == F.col(f"source_{tag}")))
        alone.append(matched.groupBy(F.col("lang_a").alias("l"), F.col("a").alias("x"), F.col("b").alias("y")).agg(F.sum(value * F.col("times")).alias("more"), (-F.sum("times")).alias("common")))
    parts = shared.unionByName(alone[0]).unionByName(alone[1]).groupBy("l", "x", "y").agg(F.sum("more").alias("more"), F.sum("common").alias("common"))
    out = pairs.join(parts, (F.col("lang_a") == F.col("l")) & (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left")
    # terms that neither has: all, less each source's own, plus those that both have
    value = F.coalesce("more", zero) + (F.col("terms_a") + F.coalesce("common", zero)) * apart(zero, zero)
    out = out.withColumn("value", F.when(F.col("terms_a") == 0, 0).otherwise(value).cast("long"))
    ways = [F.struct(F.col(f"source_{x}").alias("source"), F.col(f"source_{y}").alias("item")) for x, y in ("ab", "ba")]
    return out.select(F.col("lang_a").alias("lang"), "value", F.explode(F.array(*ways)).alias("w")).select("lang", "w.source", "w.item", "value")


def distinctive_terms(kept: DataFrame, groups: DataFrame, top: int = 50) -> DataFrame:
    """(lang, source, item, value, rank): each group's *top* terms whose share exceeds that of the language, by the excess."""
    whole = groups.groupBy("lang").agg(F.sum("total").alias("whole"))
    language = kept.groupBy("lang", "term").agg(F.sum("n").alias("everywhere"))
    met = kept.join(language, ["lang", "term"]).join(groups.join(whole, "lang").select("lang", "source", "total", "terms", "whole"), ["lang", "source"])
    value = share(F.col("n"), F.col("total"), F.col("terms")) - share(F.col("everywhere"), F.col("whole"), F.col("terms"))
    over = met.select("lang", "source", F.col("term").alias("item"), value.alias("value")).filter("value > 0")
    return _ranked(over).filter(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def source_audit(docs: DataFrame, least: int = 30, top: int = 50, tile: tuple[int, int] = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source stands from each other of its language, and its most distinctive terms.

    *docs*: text, lang, source; other columns don't matter. Null text, lang and source count as ''. Terms in fewer than *least* documents
    (rows) of a language are left out. A group's share of a term is share() with 5 added to every count. Part `pair` has each other source
    of the language, by the sum of differences over all kept terms (0 if there are none); part `term` the *top* terms whose share is above the language's.
    Ties go to the smaller item in UTF-8. A group without terms has its pairs; a language with one source has none. An empty table gives no rows.

    The result has as many pairs as sources squared, which is its subject; the work on terms is spread by term.
    """
    docs = docs.select("text", "lang", "source")
    kept = written(kept_terms(written(term_counts(docs), "term-counts"), least), "kept-terms")
    groups = written(group_totals(docs, kept), "groups")
    pairs = _ranked(pair_divergence(kept, groups, tile)).withColumn("part", F.lit("pair"))
    return pairs.unionByName(distinctive_terms(kept, groups, top).withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")
