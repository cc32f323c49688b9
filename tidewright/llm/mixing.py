"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

The mix is a sequence of slots. Slot n falls on the source whose stretch of the cumulative
weights holds the n-th golden-ratio point, so every prefix of the sequence is close to the
target shares. Each source's documents, shuffled by a hash, form one stream of words that
is cut into blocks of equal length; a source's k-th slot takes its block k, counted round and round.
A source's slots end when its target is met and the last one is cut to fit it exactly. Documents are taken by the slots
whose blocks hold their words, and come out in the order of these slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.shared import SPACE, unused_names, word_count, written

#: Fractional part of the golden ratio.
GOLDEN = 0.6180339887498949


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """*sizes* (source, source_size: one row a source) with weight and target.

    Sources in code-point order, null last, weigh *weights* in turn and share the sum of all sizes.
    A target stops at *max_repeat* times its source's size; what is over goes to the others by weight
    until none is above. With the sources in the order of cap by weight, those that stop are a prefix,
    so the level where it ends is found from running sums, without iteration.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    total = Window.partitionBy()
    by_ratio = Window.orderBy("_ratio", "_w", F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / (
        F.sum("_w").over(total) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    )
    return (
        sizes.withColumn("_w", weight.cast("long"))
        .withColumn("_cap", F.col("source_size") * max_repeat)
        .withColumn("_all", F.sum("source_size").over(total))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_level", level)
        .withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_w", F.col("source").isNull(), "source", "_level"))).over(total)["_level"])
        .withColumn("target", F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_w")))
        .select("source", "source_size", F.col("_w").alias("weight"), F.coalesce("target", F.lit(0.0)).alias("target"))
    )


def _source_id(source: Column) -> Column:
    """A join key that is never null: sources are compared as whole strings, null apart."""
    return F.concat(F.when(source.isNull(), "0").otherwise("1"), F.coalesce(source, F.lit("")))


def word_streams(docs: DataFrame, buckets: int = 1024, run: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(documents without text, with size, _sid, _key and start: their place in their source's shuffled stream; sizes per source).

    Documents are ordered by the MD5 of their id and their text's MD5. A source is split into *buckets* ranges of that hash and
    only the ranges' sums are added up in one place, so no source, however large, is sorted by one task. Rows that agree in id,
    source and text are one row with a count until they have their places, so copies don't crowd a range either.
    """
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    h = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), text).cast("binary"))
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _source_id(F.col("source")).alias("_sid"), F.col("text").isNull().alias("_null"), h.alias("_key"))
    slim = slim.groupBy("doc_id", "source", "size", "_sid", "_null", "_key").agg(F.count(F.lit(1)).alias("_n"))
    slim = written(slim.withColumn("_b", (F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("int")), "mix-sizes")
    sums = slim.groupBy("_sid", "source", "_b").agg(F.sum(F.col("size") * F.col("_n")).alias("_sum"))
    ahead = Window.partitionBy("_sid").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_sid", "_b", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_sid", "_b").orderBy("_key", "doc_id", "_null").rowsBetween(Window.unboundedPreceding, -1)
    placed = slim.withColumn("_in", F.coalesce(F.sum(F.col("size") * F.col("_n")).over(within), F.lit(0)))
    placed = placed.join(offsets, ["_sid", "_b"]).withColumn("_run", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / run))))
    copy = F.explode(F.sequence(F.col("_run") * run, F.least((F.col("_run") + 1) * run, F.col("_n")) - 1))
    placed = placed.withColumn("_copy", copy).withColumn("start", F.col("_offset") + F.col("_in") + F.col("_copy") * F.col("size"))
    return placed.select("doc_id", "source", "size", "_sid", "_null", "_key", "start"), sums.groupBy("_sid", "source").agg(F.sum("_sum").alias("source_size"))


def schedule(targets: DataFrame, block: int, chunk: int = 4096) -> DataFrame:
    """(slot, _sid, k, b, lo, hi): the k-th slot of a source takes the words lo to hi of its stream, in its block b.

    *targets*: _sid, source_size, target, one row a source. A source needs a slot for each block of each whole pass over
    its stream and then slots for the rest of its target, the last of them cut short. Points that fall on a source which
    has all its slots are passed over; what the points leave out follows at the end. Slots are ranked within chunks of
    the sequence, so the slots of one source are never sorted by one task. Points and sources meet in cells of the unit interval,
    of which there are as many as sources or more, so a point is compared with few sources.
    """
    spark = targets.sparkSession
    goal = F.floor("target").cast("long")
    plan = targets.filter((F.col("source_size") > 0) & (goal > 0)).select(
        "_sid", "source_size", goal.alias("_goal"), F.ceil(F.col("source_size") / block).cast("long").alias("_nb"),
        (goal % F.col("source_size")).alias("_rest"), F.floor(goal / F.col("source_size")).cast("long").alias("_passes"),
    ).withColumn("_need", F.col("_passes") * F.col("_nb") + F.ceil(F.col("_rest") / block).cast("long"))
    plan = written(plan, "mix-plan")
    slots, sources = plan.agg(F.coalesce(F.sum("_need"), F.lit(0)), F.count(F.lit(1))).first()
    cells = max(4096, sources)
    total = F.lit(max(slots, 1))
    before = F.coalesce(F.sum("_need").over(Window.orderBy("_sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = plan.select("_sid", (before / total).alias("_from"), ((before + F.col("_need")) / total).alias("_to"))
    edges = edges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_from") * cells), F.floor(F.col("_to") * cells))))
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") + 1) * F.lit(GOLDEN) % 1).alias("_u"))
    points = points.withColumn("_cell", F.floor(F.col("_u") * cells))
    hits = points.join(edges, "_cell").filter("_from <= _u AND _u < _to").select("slot", "_sid", F.floor(F.col("slot") / chunk).alias("_c"))
    counts = hits.groupBy("_sid", "_c").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("_sid").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_sid", "_c", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    ranked = hits.join(offsets, ["_sid", "_c"]).select(
        "slot", "_sid", (F.col("_before") + F.row_number().over(Window.partitionBy("_sid", "_c").orderBy("slot")) - 1).alias("k")
    )
    got = counts.groupBy("_sid").agg(F.sum("_n").alias("_got"))
    late = plan.join(got, "_sid", "left").withColumn("_got", F.coalesce("_got", F.lit(0))).filter("_got < _need")
    late = late.withColumn("_late", F.coalesce(F.sum(F.col("_need") - F.col("_got")).over(Window.orderBy("_sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    late = late.select("_sid", "_got", "_late", F.explode(F.sequence("_got", F.col("_need") - 1)).alias("k"))
    late = late.select((F.col("k") - F.col("_got") + F.col("_late") + slots).alias("slot"), "_sid", "k")
    used = ranked.unionByName(late).join(plan, "_sid").filter("k < _need")
    b = F.col("k") % F.col("_nb")
    end = F.when(F.col("k") >= F.col("_passes") * F.col("_nb"), F.col("_rest")).otherwise(F.col("source_size"))
    return used.select("slot", "_sid", "k", b.alias("b"), (b * block).alias("lo"), F.least((b + 1) * block, end).alias("hi"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(decisions, schedule) of mixing *docs* (doc_id, source, text, ...) to target weights.

    decisions: one row a document with doc_id, source, size, source_size, target, taken (the words that the mix takes of
    it, repeats counted), start (its first word's place in its source's stream), first_slot (the slot that first takes from
    it, null where none does) and _key, the hash of its id and text (null and empty texts share it). A source's taken words are its target, rounded down. A document
    is taken whole, as often as its source is passed over, but for the one where a source's last slot ends.

    Null texts have no words and are never taken. Documents of a null source are a source of their own, last in order.
    Repeated rows are documents of their own. Texts of any length count whole. Empty tables give empty results. Columns besides
    these three don't matter.
    """
    placed, sizes = word_streams(docs)
    targets = source_targets(sizes.select("source", "source_size"), weights, max_repeat).withColumn("_sid", _source_id(F.col("source")))
    slots = schedule(targets, block)
    uses = slots.groupBy("_sid", "b", "lo", "hi").agg(F.count(F.lit(1)).alias("_uses"), F.min("slot").alias("_first"))
    full = placed.filter("size > 0")
    pieces = full.select("_sid", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("b"))
    overlap = F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), F.col("hi")) - F.greatest("start", "lo"))
    taken = (
        pieces.join(uses, ["_sid", "b"])
        .withColumn("_words", overlap)
        .filter("_words > 0")
        .groupBy("_sid", "start")
        .agg(F.sum(F.col("_words") * F.col("_uses")).alias("taken"), F.min("_first").alias("first_slot"))
    )
    out = full.join(taken, ["_sid", "start"], "left").unionByName(placed.filter("size = 0"), allowMissingColumns=True)
    out = out.join(targets.select("_sid", "source_size", "target"), "_sid")
    out = out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "start", "first_slot", "_key")
    return out, slots


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """*docs* as the mix takes them: each document as often as it is taken whole, and the words of one taken in part.

    The rows lie in files and within them in the order of the slots that first take them. Documents that the mix doesn't take are left
    out. The words of a part are joined by single blanks. Rows that agree in doc_id, source and text are merged into one row (of any
    values in other columns), taken as often as they are together. Other columns, nulls in them and any names too, pass through;
    n_chars, if there is one, is counted again.
    """
    key, k, own, source, sid, taken, size, rows, slot = unused_names(9, docs)
    decided, _ = mix(docs, **options)
    decided = decided.filter("taken > 0").groupBy("doc_id", "source", "_key").agg(F.sum("taken").alias(taken), F.max("size").alias(size), F.count(F.lit(1)).alias(rows), F.min("first_slot").alias(slot))
    decided = decided.select(F.col("doc_id").alias(own), _source_id(F.col("source")).alias(sid), F.col("_key").alias(key), taken, size, rows, slot)
    hashed = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.md5(F.col("text").cast("binary"))).cast("binary"))
    keyed = docs.withColumns({k: hashed, source: _source_id(F.col("source"))})
    met = keyed.join(decided, (F.col(k) == F.col(key)) & (F.col(source) == F.col(sid)) & F.col("doc_id").eqNullSafe(F.col(own)))
    one = met.filter(F.col(rows) == 1).unionByName(met.filter(F.col(rows) > 1).dropDuplicates([own, sid, key]))
    whole = F.floor(F.col(taken) / F.col(size)).cast("int")
    rest = (F.col(taken) % F.col(size)).cast("int")
    cut = F.array_join(F.slice(F.split(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), f"[{SPACE}]+"), F.lit(1), rest), " ")
    copies = F.when(rest > 0, F.concat(F.array_repeat("text", whole), F.array(cut))).otherwise(F.array_repeat("text", whole))
    # partitions are ranges of slots: dealt before the copies are made, so that only single texts are shuffled
    ordered = one.repartitionByRange(slot).sortWithinPartitions(slot)
    mixed = ordered.select(*[F.explode(copies).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
    return mixed.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else mixed
