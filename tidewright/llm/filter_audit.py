"""How document filters interact: what each removes after which others, in every order.

Each document is reduced to five failure flags. A SQL CUBE over the flags and the part of the table gives, in the grouping sets'
rows whose selected flags are all false, how many documents survive each subset of filters. A step of an order takes the survivors
from one subset to the next, so every step is a join of two subsets; no document is looked at once per order.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
_COUNTS = ["docs", "good", "toxic"]


def text_flags(text: Column, words: Column) -> dict[str, Column]:
    """Failure of the filters that look at one text alone; *words* is the array of its words."""
    return {
        "A": F.size(words) < 100,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.char_length(text) * 10,
        "D": text.rlike(r"[#$%&*|]"),
    }


def flag_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, docs, good, toxic): documents by part and failure flags.

    *docs*: doc_id, text, lang; *labels*: doc_id, quality, toxic; other columns don't matter. A null text is empty, a null lang the part ''.
    Flag E marks a text that a smaller doc_id has too. Repeated rows count as often as they stand there, and share their doc_id, so
    none of them is the smaller one; rows without doc_id neither fail E nor make others fail. A document is good (toxic) if any of its label rows says
    quality (toxic) is 1. Very long texts count whole; an empty table gives no rows.

    A document travels as a few dozen bytes: the text's digest stands for the text. Copies are counted before they are shuffled by
    digest, so the largest group of copies is a row for each part and label in each task.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", " " * 5), " "), "")
    cut = docs.select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("t"), words.alias("w"))
    flags = text_flags(F.col("t"), F.col("w"))
    keyed = cut.select("id", "part", F.unhex(F.md5("t")).alias("key"), *[c.alias(name) for name, c in flags.items()])
    rows = keyed.groupBy("id", "part", "key", *flags).agg(F.count(F.lit(1)).alias("n"))

    marked = labels.groupBy(F.col("doc_id").alias("label_id")).agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    # rows without doc_id meet no label: their second key deals them out and matches nothing
    spread = F.when(F.col("id").isNull(), F.xxhash64("key")).otherwise(F.lit(0))
    met = rows.withColumn("deal", spread).join(marked.withColumn("label_deal", F.lit(0).cast("long")), (F.col("id") == F.col("label_id")) & (F.col("deal") == F.col("label_deal")), "left")
    known = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    copies = met.select("id", "part", "key", *flags, "n", *known).groupBy("key", "part", *flags, "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNotNull(), F.col("n")).otherwise(0)).alias("named"), F.min("id").alias("least"), F.min_by("n", "id").alias("firsts")
    )
    # the rows of one text are at most the parts times four
    first = F.min("least").over(Window.partitionBy("key"))
    late = F.col("named") - F.when(F.col("least") == first, F.col("firsts")).otherwise(0)
    split = copies.withColumn("late", late).select(
        "part", *flags, "good", "toxic", F.explode(F.array(F.struct(F.lit(True).alias("E"), F.col("late").alias("m")), F.struct(F.lit(False).alias("E"), (F.col("n") - F.col("late")).alias("m")))).alias("x")
    )
    counts = [F.sum("x.m"), *[F.sum(F.when(F.col(c), F.col("x.m")).otherwise(0)) for c in ("good", "toxic")]]
    found = split.filter("x.m > 0").select("part", *flags, F.col("x.E").alias("E"), "good", "toxic", "x").groupBy("part", *FILTERS)
    return found.agg(*[c.alias(name) for c, name in zip(counts, _COUNTS, strict=True)])


def subset_survivors(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, mask, docs, good, toxic): what passes every subset of *filters*, by part and (part null) over all.

    *counts*: part, a boolean for each filter, and the three counts. Bit i of mask stands for the i-th filter. Subsets that nothing passes have zeros.
    """
    chosen = F.lit(0)
    passed = F.lit(True)
    for i, c in enumerate(filters):
        chosen = chosen + F.when(F.grouping(c) == 0, F.lit(1 << i)).otherwise(0)
        passed = passed & ((F.grouping(c) == 1) | ~F.col(c))
    cube = counts.cube("part", *filters).agg(*[F.sum(c).alias(c) for c in _COUNTS], chosen.cast("int").alias("mask"), passed.alias("passed"), (F.grouping("part") == 0).alias("own"))
    survived = cube.filter("passed").select("part", "own", "mask", *_COUNTS)
    grid = survived.filter("mask = 0").select(F.col("part").alias("p"), F.col("own").alias("o"), F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("m"))
    met = grid.join(survived, F.col("p").eqNullSafe(F.col("part")) & (F.col("o") == F.col("own")) & (F.col("m") == F.col("mask")), "left")
    return met.select(F.col("p").alias("part"), F.col("m").alias("mask"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS])


def _orders(filters: str) -> list[tuple[str, int, str, int, int]]:
    """(filter_order, step, its filter, subset before, subset after) of every step of every order."""
    out = []
    for order in permutations(range(len(filters))):
        before = 0
        for step, i in enumerate(order, 1):
            out.append(("".join(filters[j] for j in order), step, filters[i], before, before | 1 << i))
            before |= 1 << i
    return out


def filter_audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): every step of every order, by part and over all.

    *counts*: as from flag_counts(). The part is null in the rows over the whole table. Per step: what is kept, what its filter removes, what
    fails it but went before, what fails it alone, the good and toxic documents among the removed, and what the filter removes summed over all orders.
    The number of rows is set by filters and parts: with five filters 600 a part. No counts give no rows.
    """
    spark = counts.sparkSession
    survivors = subset_survivors(counts, filters)
    everything = (1 << len(filters)) - 1
    orders = _orders(filters)
    times: dict[tuple[str, int, int], int] = {}
    for _, _, name, before, after in orders:
        times[name, before, after] = times.get((name, before, after), 0) + 1
    # as many moves as subsets times filters: a bound that data doesn't change
    moves = F.broadcast(spark.createDataFrame([(n, b, a, t) for (n, b, a), t in times.items()], "filter string, before int, after int, times int"))
    here = survivors.select(F.col("part").alias("p"), F.col("mask").alias("m"), *[F.col(c).alias(f"{c}_after") for c in _COUNTS])
    from_to = survivors.join(moves, F.col("mask") == F.col("before")).join(here, F.col("part").eqNullSafe(F.col("p")) & (F.col("after") == F.col("m")))
    gone = [(F.col(c) - F.col(f"{c}_after")).alias(f"{c}_gone") for c in _COUNTS]
    pairs = from_to.select("part", "filter", "before", "after", "times", F.col("docs_after").alias("kept"), *gone)
    first, last = F.col("before") == 0, F.col("after") == everything
    own = pairs.groupBy(F.col("part").alias("p"), F.col("filter").alias("f")).agg(
        F.sum(F.when(first, F.col("docs_gone"))).alias("fails"), F.sum(F.when(last, F.col("docs_gone"))).alias("unique_fails"), F.sum(F.col("docs_gone") * F.col("times")).alias("shapley")
    )
    steps = F.broadcast(spark.createDataFrame(orders, "filter_order string, step int, f2 string, b2 int, a2 int"))
    met = pairs.join(own, F.col("part").eqNullSafe(F.col("p")) & (F.col("filter") == F.col("f"))).join(steps, (F.col("before") == F.col("b2")) & (F.col("after") == F.col("a2")))
    return met.select(
        "part", "filter_order", "step", "kept", F.col("docs_gone").alias("removed"), (F.col("fails") - F.col("docs_gone")).alias("redundant"), "unique_fails",
        F.col("good_gone").alias("good_lost"), F.col("toxic_gone").alias("toxic_lost"), "shapley",
    )
