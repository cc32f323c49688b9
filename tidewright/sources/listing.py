"""Video listings: which files belong to which video, by data set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where each data set keeps its videos, and which part of the path is the video's id.
LAYOUTS = {
    "holoassist": r"([^/]+)/Export_py/Video_pitchshift\.mp4$",
    "wtag": r"([^/]+)/Video/Video\.mpeg$",
    "epickitchens": r"(?:EK55/videos/[^/]+/[^/]+|EK100/[^/]+/videos)/([^/.]+)\.MP4$",
    "egoexolearn": r"([^/]+)\.mp4$",
    "ego4d": r"([^/]+)\.mp4$",
    "custom": r"P\d+/videos/([^/.]+)\.MP4$",
}
CAMERAS = ("HMC_21110305_mono10bit", "HMC_21179183_mono10bit", "HMC_84355350_mono10bit", "HMC_84358933_mono10bit")


def video_of(path: Column, dataset: str) -> Column:
    """The video id in *path*; null for files that aren't videos of *dataset*."""
    if dataset == "assembly101":
        cameras = "|".join(CAMERAS)
        found = F.regexp_extract(path, rf"([^/]+)/({cameras})\.mp4$", 1)
        return F.when(found != "", F.concat_ws("__", found, F.regexp_extract(path, rf"([^/]+)/({cameras})\.mp4$", 2)))
    return F.nullif(F.regexp_extract(path, LAYOUTS[dataset], 1), F.lit(""))


def list_videos(files: DataFrame, dataset: str, groups: DataFrame | None = None, skip_single: bool = False) -> DataFrame:
    """(video_id, paths): each video with its files in order. *groups* (video, part, pos) concatenates files under the group's first.

    *skip_single* leaves out videos of one file, as one data set's listing does.
    """
    own = files.withColumn("video_id", video_of(F.col("path"), dataset)).filter("video_id IS NOT NULL")
    if groups is None:
        out = own.groupBy("video_id").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    else:
        first = groups.filter("pos = 0").select("video", F.col("part").alias("first"))
        member = groups.join(first, "video").select(F.col("part").alias("video_id"), "first", "pos")
        met = own.join(member, "video_id", "left").select(F.coalesce("first", "video_id").alias("video_id"), F.coalesce("pos", F.lit(0)).alias("pos"), "path")
        out = met.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "path"))), lambda x: x["path"]).alias("paths"))
    return out.filter(F.size("paths") > 1) if skip_single else out
