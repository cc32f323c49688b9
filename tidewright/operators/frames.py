"""Turns on a grid of video frames: assignment styles, clipping, labels per frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def role_rank() -> Column:
    """Order of turns at one time: state updates, then the assistant, then all others."""
    return F.when(F.col("role") == "DST_UPDATE", 0).when(F.col("role") == "assistant", 1).otherwise(2)


def frames_continuous(turns: DataFrame, key: list[str], fps: float, total: Column | None = None, order: list | None = None) -> DataFrame:
    """Each turn gets the frames from the end of the one before to its own time: start_frame to end_frame, end excluded.

    Ends are clamped to *total* and never fall back, so they are running maxima. Turns without time keep null frames.
    """
    w = Window.partitionBy(*key).orderBy(*(order or ["time", role_rank(), "turn"]))
    raw = F.floor(F.col("time") * fps)
    clamped = F.least(raw, total) if total is not None else raw
    ended = turns.withColumn("end_frame", F.when(F.col("time").isNotNull(), F.greatest(F.max(clamped).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))))
    return ended.withColumn("start_frame", F.when(F.col("time").isNotNull(), F.coalesce(F.max("end_frame").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))


def frames_windowed(turns: DataFrame, fps: float, window: int = 4, total: Column | None = None) -> DataFrame:
    """Each turn gets the *window* frames that end at its time, both ends included."""
    end = F.floor(F.col("time") * fps)
    start = F.greatest(end - window + 1, F.lit(0))
    if total is not None:
        end, start = F.least(end, total - 1), F.least(start, total - 1)
    return turns.withColumns({"start_frame": F.least(start, end), "end_frame": end})


def frames_alternating(turns: DataFrame, key: list[str], fps: float, total: Column, order: list[str]) -> DataFrame:
    """Frames that come before each turn, at least one each: ends grow strictly; turns whose frames would pass *total* are cut off.

    An end is the greater of its own frame and the end before it plus one: the running maximum of frame minus rank, plus rank.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    rank = F.row_number().over(w)
    own = turns.withColumns({"_r": rank, "_x": F.floor(F.col("time") * fps)})
    end = F.greatest(F.max(F.col("_x") - F.col("_r")).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) + F.col("_r")
    ended = own.withColumn("end_frame", end).filter(F.col("end_frame") <= total)
    return ended.withColumn("start_frame", F.coalesce(F.lag("end_frame").over(w), F.lit(0))).drop("_r", "_x")


def clip_to(turns: DataFrame, total: Column) -> DataFrame:
    """Drop turns that start at or after *total*, cut ends to it; an unknown total or missing frames leave a turn as it is."""
    known = total.isNotNull() & F.col("start_frame").isNotNull()
    kept = turns.filter(F.coalesce(~known | (F.col("start_frame") < total), F.lit(True)))
    return kept.withColumn("end_frame", F.when(known, F.least("end_frame", total)).otherwise(F.col("end_frame")))


def timestamp_window(time: Column, half: float, fps: float) -> tuple[Column, Column]:
    """(start, end) frames around *time*, truncated toward zero, at least one frame."""
    start = ((time - half) * fps).cast("long")
    return start, F.greatest(((time + half) * fps).cast("long"), start + 1)


def clip_range(turns: DataFrame, key: list[str]) -> DataFrame:
    """First start and last end of each key."""
    return turns.groupBy(*key).agg(F.min("start_frame").alias("clip_start"), F.max("end_frame").alias("clip_end"))


def frame_statistics(turns: DataFrame, key: list[str]) -> DataFrame:
    n = F.col("end_frame") - F.col("start_frame")
    return turns.groupBy(*key).agg(
        F.sum(n).alias("total"), F.avg(n).alias("mean"), F.min(n).alias("least"), F.max(n).alias("most"), F.coalesce(F.try_divide(F.sum(n), F.max("end_frame") - F.min("start_frame")), F.lit(0.0)).alias("coverage")
    )


def event_grid(turns: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per key and frame at which turns start: speaking and state-update flags, joined texts, number of turns."""
    said = F.when(F.col("role") == "assistant", F.struct(order, F.col("text").alias("t")))
    texts = F.transform(F.array_sort(F.collect_list(said)), lambda x: x["t"])
    return turns.groupBy(*key, F.col("start_frame").alias("frame")).agg(
        F.max((F.col("role") == "assistant").cast("int")).alias("speaking"), F.max((F.col("role") == "user").cast("int")).alias("asked"), F.array_join(texts, " ").alias("response"), F.count(F.lit(1)).alias("n_turns")
    )


def frame_labels(bounds: DataFrame, events: DataFrame, key: list[str], label: str) -> DataFrame:
    """A row per frame of each key's clip (clip_start, clip_end excluded): the event's label there, or 0."""
    grid = bounds.select(*key, F.explode(F.sequence("clip_start", F.col("clip_end") - 1)).alias("frame"))
    return grid.join(events, [*key, "frame"], "left").withColumn(label, F.coalesce(label, F.lit(0)))


def talk_ratio(turns: DataFrame, key: list[str]) -> DataFrame:
    """Of the frames before each turn the last one talks and the others don't."""
    n = F.col("end_frame") - F.col("start_frame")
    return turns.filter(n > 0).groupBy(*key).agg(F.count(F.lit(1)).alias("talk"), F.sum(n - 1).alias("no_talk"))


def reply_interval(turns: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Mean time between the assistant's turns of a key."""
    w = Window.partitionBy(*key).orderBy(*order)
    gap = turns.filter("role = 'assistant'").withColumn("_g", F.col("time") - F.coalesce(F.lag("time").over(w), F.lit(0.0)))
    return gap.groupBy(*key).agg(F.avg("_g").alias("mean_interval"), F.count(F.lit(1)).alias("n"))
