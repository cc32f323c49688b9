"""Combining annotation sources, and sequence bookkeeping of training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.relations import point_in_interval

#: Label of positions that aren't learnt.
IGNORE = -100


def update_cost(updates: Column) -> Column:
    """Tokens of an array of struct(step_id, transition): one for each id that isn't empty and one for each transition."""
    return F.aggregate(updates, F.lit(0), lambda n, u: n + F.when(F.coalesce(u["step_id"], F.lit("")) != "", 2).otherwise(1))


def goal_by_name(uid: Column) -> Column:
    low = F.lower(uid)
    return F.when(low.contains("assembly"), "Assembly task").when(low.contains("cooking"), "Cooking task").otherwise("Task completion")


def steps_with_mistakes(coarse: DataFrame, fine: DataFrame, mistakes: DataFrame, key: str, verbs: tuple[str, ...], fps: float) -> DataFrame:
    """Coarse steps of keys that all three sources have: narration, mistake message, and how many fine steps begin within each.

    A step takes the first mistake row of its start frame. Fine steps count if they begin with one of *verbs*; one that begins on the
    bound of two steps counts for both. *coarse*: start, end, name. *fine*: start, name. *mistakes*: start, pos, verb, this, that, kind, remark.
    """
    known = coarse.join(fine.select(key).distinct(), key, "left_semi").join(mistakes.select(key).distinct(), key, "left_semi")
    first = mistakes.withColumn("_r", F.row_number().over(Window.partitionBy(key, "start").orderBy("pos"))).filter("_r = 1").drop("_r", "pos")
    met = known.join(first, [key, "start"], "left")
    own = F.concat_ws(" ", "verb", "this", F.when(F.col("verb") == "attach", "to").otherwise("from"), "that")
    wrong = F.concat_ws(" ", F.when(F.col("verb") == "attach", "detach").otherwise("attach"), "this", F.when(F.col("verb") == "attach", "from").otherwise("to"), "that")
    message = F.when(F.col("kind") == "mistake", F.concat(F.lit("mistake: "), "remark")).when(F.col("kind") == "correction", F.concat(F.lit('correction of "'), wrong, F.lit('"'))).otherwise("")
    steps = met.select(key, "start", "end", F.when(F.col("verb").isNotNull(), own).otherwise(F.col("name")).alias("narration"), message.alias("mistake"))
    concrete = fine.filter(F.col("name").rlike("^(" + "|".join(verbs) + ")")).select(key, F.col("start").alias("_at"))
    within = steps.select(key, "start", "end").distinct().join(concrete, key).filter(F.col("_at").between(F.col("start"), F.col("end"))).groupBy(key, "start", "end").agg(F.count(F.lit(1)).alias("substeps"))
    out = steps.join(within, [key, "start", "end"], "left")
    return out.select(key, (F.col("start") / fps).alias("start_ts"), (F.col("end") / fps).alias("end_ts"), "narration", "mistake", F.coalesce("substeps", F.lit(0)).alias("substeps"))


def annotation_state(probes: DataFrame, nodes: DataFrame, key: list[str], at: str, width: float = 3600.0) -> DataFrame:
    """For each probe: the active node (the latest begun that holds the time), how many are completed, and the next to begin.

    Probes of keys without nodes are left out. The active node comes from a join by buckets of *width*; the others from one pass over starts,
    ends and probes sorted together. Probes that repeat share a row.
    """
    spans = nodes.select(*key, "node_id", "start_ts", "end_ts")
    known = probes.join(spans.select(*key).distinct(), key, "left_semi").distinct()
    held = point_in_interval(known, spans.filter("start_ts <= end_ts"), key, at, width)
    active = held.groupBy(*probes.columns).agg(F.max_by("node_id", F.struct("start_ts", "node_id")).alias("active"))
    starts = spans.select(*key, F.col("start_ts").alias("_t"), F.lit(1).alias("_kind"), F.struct(F.col("start_ts").alias("s"), F.col("node_id").alias("n")).alias("_node"))
    ends = spans.select(*key, F.col("end_ts").alias("_t"), F.lit(1).alias("_kind"), F.lit(1).alias("_end"))
    asked = known.withColumns({"_t": F.col(at), "_kind": F.lit(0)})
    # at one time probes come first, so that what ends then isn't completed; and what begins then isn't yet to come
    both = asked.unionByName(ends, allowMissingColumns=True).unionByName(starts.withColumn("_kind", F.lit(-1)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy("_t", "_kind")
    completed = F.count("_end").over(w.rowsBetween(Window.unboundedPreceding, 0))
    later = F.first("_node", ignorenulls=True).over(Window.partitionBy(*key).orderBy("_t", "_kind", F.col("_node.n")).rowsBetween(0, Window.unboundedFollowing))
    seen = both.withColumns({"completed": completed, "upcoming": later["n"]}).filter("_kind = 0").select(*probes.columns, "completed", "upcoming")
    return seen.join(active, probes.columns, "left").select(*probes.columns, "active", "completed", "upcoming")


def bound_mismatches(samples: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """(key, clip, kind) of clips that don't fit their video's frames: its start, its end, or the first bad turn; videos without frames are missing."""
    met = samples.join(frames, key, "left")
    n = F.col("n_frames")
    kind = F.when(n.isNull(), "missing").when(F.col("clip_start") >= n, "clip start").when(F.col("clip_end") > n, "clip end").when(F.exists("turn_ends", lambda e: e > n), "turn")
    return met.select(key, "clip", kind.alias("kind"), F.when(kind == "turn", F.size(F.filter("turn_ends", lambda e: e <= n))).alias("first_bad")).filter("kind IS NOT NULL")


def sequence_length(turns: DataFrame, key: list[str], per_frame: int, special: int, most: int) -> DataFrame:
    """Image, text and all tokens of each key, frames counted as often as turns hold them, and whether they fit *most*."""
    image = F.sum((F.col("end_frame") - F.col("start_frame")) * per_frame)
    text = F.sum(F.greatest(F.floor(F.char_length("text") / 4), F.lit(1)) + 3)
    total = image + text + special + 50
    return turns.groupBy(*key).agg(image.alias("image_tokens"), text.alias("text_tokens"), total.alias("total"), (total <= most).alias("fits"))


def shifted_labels(tokens: Column, learn: Column) -> Column:
    """Labels of an array of tokens: at each place the next token if its flag in *learn* is set, else IGNORE."""
    after = F.concat(F.slice(F.transform(F.arrays_zip(tokens.alias("t"), learn.alias("l")), lambda x: F.when(x["l"] == 1, x["t"]).otherwise(IGNORE)), F.lit(2), F.size(tokens)), F.array(F.lit(IGNORE)))
    return after


def decision_labels(grid: DataFrame, own: str, other: str) -> DataFrame:
    """1 where *own* is set, IGNORE where only *other* is, else 0."""
    return grid.withColumn("label", F.when(F.col(own) == 1, 1).when(F.col(other) == 1, IGNORE).otherwise(0))


def offline_summary(turns: DataFrame, group: list[str], fps: float) -> DataFrame:
    """Means of perplexity, token accuracy and time difference (frames over rate), and the share of turns past the limit."""
    return turns.groupBy(*group).agg(F.avg("ppl").alias("ppl"), F.avg(F.abs("frame_diff") / fps).alias("time_diff"), F.avg("token_acc").alias("token_acc"), F.avg(F.col("overflow").cast("int")).alias("overflow_ratio"))


def split_lists(videos: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(video, splits): names of the splits whose column holds a video, sorted; train only if no other does."""
    long = videos.unpivot(["video"], list(columns), "column", "member").filter("member")
    names = F.create_map(*[F.lit(x) for kv in columns.items() for x in kv])
    found = long.select("video", names[F.col("column")].alias("split")).groupBy("video").agg(F.sort_array(F.collect_set("split")).alias("all"))
    others = F.filter("all", lambda s: s != "train")
    return found.select("video", F.array_join(F.when(F.size(others) > 0, others).otherwise(F.col("all")), ",").alias("splits"))


def count_narration(items: DataFrame, key: str, kind: str, order: str) -> DataFrame:
    """(key, text): "2 cats, 1 dog" of each key's kinds, the kind seen first by *order* leading; a plural is a plain s."""
    each = items.groupBy(key, kind).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    part = F.concat(F.col("n").cast("string"), F.lit(" "), F.col(kind), F.when(F.col("n") > 1, "s").otherwise(""))
    return each.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", part.alias("t")))), lambda x: x["t"]), ", ").alias("text"))
