"""Readers and writers of annotation files. Schemas are stated, never inferred; rows that don't parse go to a column of their own."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CORRUPT = "_corrupt_record"


def limited(df: DataFrame, rows: int | None, order: list | None = None) -> DataFrame:
    """The first *rows* rows by *order*; all of them for None or -1."""
    if rows is None or rows < 0:
        return df
    return (df.orderBy(*order) if order else df).limit(rows)


def read_json_array(spark: SparkSession, path: str, schema: StructType | str, rows: int | None = -1, order: list | None = None) -> DataFrame:
    """Rows of files that hold a JSON array (or one object) each; the first *rows* of them by *order*."""
    return limited(spark.read.schema(schema).option("multiLine", True).json(path), rows, order)


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A row per line; a line that doesn't parse keeps its text in _corrupt_record."""
    full = StructType.fromDDL(schema) if isinstance(schema, str) else StructType(list(schema.fields))
    if CORRUPT not in full.names:
        full = full.add(CORRUPT, "string")
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def read_json_folder(spark: SparkSession, path: str, schema: StructType | str, rows: int | None = -1, order: tuple[str, ...] = ()) -> DataFrame:
    """Every *.json file below *path*, with its name, capped in order of name and then *order*; a folder that doesn't exist is an empty table."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema).withColumn("file", F.lit(None).cast("string"))
    df = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.{json,txt}").json(path)
    return limited(df.withColumn("file", F.input_file_name()), rows, ["file", *order])


def write_json_arrays(df: DataFrame, path: str, chunk: Column, by: tuple[str, ...] = ()) -> None:
    """*df* as JSON arrays, one a file and for each value of *chunk*, which bounds their length; in folders by *by* and chunk."""
    whole = F.to_json(F.collect_list(F.struct(*[c for c in df.columns if c not in by]))).alias("value")
    arrays = df.groupBy(*by, F.lpad(chunk.cast("long").cast("string"), 12, "0").alias("chunk")).agg(whole)
    arrays.write.partitionBy(*by, "chunk").option("maxRecordsPerFile", 1).text(path)


def read_datasets(spark: SparkSession, files: dict[str, str], split: str, schema: StructType | str, rows: int | None = -1, order: list | None = None) -> DataFrame:
    """The split's files of several data sets, one below the other, each row stamped with data set, split and file; the cap is on all together."""
    parts = [read_json_array(spark, path, schema).select("*", F.lit(name).alias("_dataset_name"), F.lit(split).alias("_split"), F.lit(path).alias("_file_path")) for name, path in files.items()]
    return limited(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), rows, order)


def read_videos(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, knowledge, steps) of files that hold one object or an array of them, in either dialect.

    Steps that are missing are made of the user's turns, as "[time] text" lines. Rows without either text are left out. The id is
    the file's path and the object's place in it.
    """
    turn = "struct<role:string,time:double,content:string>"
    shape = f"struct<inferred_knowledge:string,parsed_video_anns:struct<all_step_descriptions:string>,conversation:array<{turn}>>"
    text = spark.read.option("wholetext", True).text(path).withColumn("file", F.input_file_name())
    many = F.from_json("value", f"array<{shape}>")
    rows = text.select("file", F.posexplode(many).alias("i", "v"))
    said = F.array_join(F.transform(F.filter("v.conversation", lambda t: t["role"] == "user"), lambda t: F.concat(F.lit("["), t["time"].cast("string"), F.lit("] "), t["content"])), "\n")
    steps = F.coalesce("v.parsed_video_anns.all_step_descriptions", F.when(said != "", said))
    out = rows.select(F.concat("file", F.lit("#video_"), F.col("i").cast("string")).alias("video_id"), F.col("v.inferred_knowledge").alias("knowledge"), steps.alias("steps"))
    return out.filter("knowledge IS NOT NULL AND steps IS NOT NULL")


def read_table_text(spark: SparkSession, path: str, schema: str, sep: str = "\t", header: bool = True) -> DataFrame:
    """CSV or TSV of a stated schema."""
    return spark.read.schema(schema).option("sep", sep).option("header", header).csv(path)


def ticks_to_seconds(ticks: Column) -> Column:
    """Counts of 100 nanoseconds in seconds."""
    return ticks / F.lit(10_000_000.0)


def ego_actions(actions: DataFrame) -> DataFrame:
    """(video_id, subset, steps): the ego view's steps of each video in order of start."""
    steps = F.array_sort(F.collect_list(F.struct("start", "end", "name")))
    return actions.filter("view = 'ego'").groupBy("video_id", "subset").agg(steps.alias("steps"))


def frame_counts(frames: DataFrame, videos: DataFrame, prefix: str = "grp-") -> DataFrame:
    """Each video with its number of frames; the prefix of group ids doesn't count; null where there are none."""
    n = frames.groupBy(F.col("video_uid").alias("_u")).agg(F.count(F.lit(1)).alias("n_frames"))
    return videos.join(n, F.regexp_replace("video_uid", f"^{prefix}", "") == F.col("_u"), "left").drop("_u")


def speech_points(rows: DataFrame, kind: str, speech: str) -> DataFrame:
    """*rows* (start, end in ticks) with time in seconds: the middle of rows of the kind *speech*, the start of others."""
    middle = F.when(F.col(kind) == speech, (F.col("start") + F.col("end")) / 2).otherwise(F.col("start"))
    return rows.withColumn("time", ticks_to_seconds(middle))


def first_ids_split(df: DataFrame, key: str, n: int = 40) -> DataFrame:
    """*df* with split: train for the *n* smallest ids, val for the others. The ids are found by a top-n, not by sorting all of them."""
    first = df.select(key).distinct().orderBy(key).limit(n).select(F.col(key).alias("_id"))
    return df.join(F.broadcast(first), F.col(key) == F.col("_id"), "left").withColumn("split", F.when(F.col("_id").isNull(), "val").otherwise("train")).drop("_id")


def file_of_each(files: DataFrame, videos: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """*videos* with path: the first of *files* (path) by name whose file name holds the video's id as a part between separators.

    Videos without one have no path; with *strict* they are an error once they are read.
    """
    part = F.explode(F.array_distinct(F.split(F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1), r"[^0-9A-Za-z]+")))
    named = files.select("path", part.alias("_part")).groupBy("_part").agg(F.min("path").alias("path"))
    met = videos.join(named, F.col(key).cast("string") == F.col("_part"), "left").drop("_part")
    if not strict:
        return met
    return met.withColumn("path", F.coalesce("path", F.raise_error(F.concat(F.lit("no annotation file for "), F.col(key).cast("string")))))


def decoded_frames(frames: DataFrame, fps: float) -> DataFrame:
    """(video_uid, frame_idx, time, data) of stored frames: a feature where there is one, else the image, which is base64 text."""
    return frames.select("video_uid", "frame_idx", (F.col("frame_idx") / fps).alias("time"), F.coalesce("feature", F.unbase64("image")).alias("data"))


def checked_clips(frames: DataFrame, clips: DataFrame, strict: bool = False) -> DataFrame:
    """*clips* with n_frames and error: what is wrong with the clip's bounds, or null. With *strict* a wrong one fails once it is read."""
    n = frames.groupBy("video_uid").agg(F.count(F.lit(1)).alias("n_frames"))
    met = clips.join(n, "video_uid", "left").na.fill(0, ["n_frames"])
    wrong = F.when(F.col("clip_end") > F.col("n_frames"), F.concat(F.lit("clip ends at "), F.col("clip_end").cast("string"), F.lit(" of "), F.col("n_frames").cast("string")))
    wrong = wrong.when(F.col("clip_start") >= F.col("clip_end"), F.lit("clip is empty"))
    return met.withColumn("error", F.when(wrong.isNotNull(), F.raise_error(wrong)).otherwise(wrong) if strict else wrong)


def frame_range(frames: DataFrame, clips: DataFrame) -> DataFrame:
    """Frames from clip_start up to, not including, clip_end of each clip, with its number in the clip."""
    met = frames.join(clips, "video_uid").filter((F.col("frame_idx") >= F.col("clip_start")) & (F.col("frame_idx") < F.col("clip_end")))
    return met.withColumn("k", F.col("frame_idx") - F.col("clip_start"))


def sampled_frames(frames: DataFrame, fps: float, target: float) -> DataFrame:
    """Every n-th frame, where n is the rate over the target rate, rounded as whole frames."""
    step = max(1, int((fps + 0.5) // target))
    return frames.filter(F.pmod("frame_idx", F.lit(step)) == 0).withColumn("time", F.col("frame_idx") / fps)


def write_with_manifest(df: DataFrame, path: str, name: str, split: str) -> DataFrame:
    """Write *df* as JSON below *path* and return the manifest (dataset, split, rows, files), which is written beside it."""
    df.write.mode("overwrite").json(f"{path}/{name}/{split}")
    spark = df.sparkSession
    files = F.count_distinct("_file_path") if "_file_path" in df.columns else F.lit(1)
    manifest = spark.read.schema(df.schema).json(f"{path}/{name}/{split}").agg(F.count(F.lit(1)).alias("rows"), files.alias("files")).select(F.lit(name).alias("dataset"), F.lit(split).alias("split"), "rows", "files")
    manifest.write.mode("overwrite").json(f"{path}/{name}/{split}_manifest")
    return manifest


def write_split(df: DataFrame, path: str, ok: Column) -> None:
    """Rows that are *ok* as JSON below done, others below failed: the quarantine."""
    df.filter(ok).write.mode("overwrite").json(f"{path}/done")
    df.filter(~F.coalesce(ok, F.lit(False))).write.mode("overwrite").json(f"{path}/failed")


def write_groups(df: DataFrame, path: str, group: str, rows_per_file: int = 0) -> None:
    """Parquet in a folder per *group*; files roll after *rows_per_file* rows, if that is given."""
    writer = df.write.mode("overwrite").partitionBy(group)
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).parquet(path)


def prepared_name(prefix: str, split: str, length: int, tokens: int, separator: str) -> str:
    """File name of prepared samples: prefix, split, length, tokens an image and separator."""
    return f"{prefix}_{split}_L{length}_I{tokens}_{separator}"


def read_predictions(spark: SparkSession, path: str, schema: str, expected: int | None = None) -> DataFrame:
    """Files (or folders) named by sample number, with that number; fails if *expected* samples aren't all there."""
    df = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("sample_idx", F.regexp_extract(F.input_file_name(), r"(\d+)(\.json|/[^/]*)$", 1).try_cast("long"))
    if expected is not None and (have := df.select("sample_idx").distinct().count()) != expected:
        raise ValueError(f"{have} of {expected} samples are there")
    return df


def still_to_do(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items without a valid output; an output that didn't parse counts as missing."""
    good = done.filter(F.col(CORRUPT).isNull()) if CORRUPT in done.columns else done
    return items.join(good.select(key), key, "left_anti")


def batch_requests(items: DataFrame, key: str, prompt: str, model: str = "stub") -> DataFrame:
    """(request): one JSON line per item."""
    body = F.struct(F.lit(model).alias("model"), F.array(F.struct(F.lit("user").alias("role"), F.col(prompt).alias("content"))).alias("messages"))
    return items.select(F.to_json(F.struct(F.col(key).cast("string").alias("custom_id"), F.lit("POST").alias("method"), body.alias("body"))).alias("request"))


def batch_results(lines: DataFrame) -> DataFrame:
    """(custom_id, ok, text, raw) of result lines: accepted by a success status, code 200 or 201, or a body with choices."""
    shape = "struct<custom_id:string,status:string,response:struct<status_code:int,body:struct<choices:array<struct<message:struct<content:string>>>>>>"
    r = F.from_json("value", shape)
    text = F.try_element_at(r["response"]["body"]["choices"], F.lit(1))["message"]["content"]
    ok = F.coalesce(r["status"].isin("success", "completed"), F.lit(False)) | F.coalesce(r["response"]["status_code"].isin(200, 201), F.lit(False)) | text.isNotNull()
    return lines.select(r["custom_id"].alias("custom_id"), (ok & text.isNotNull()).alias("ok"), text.alias("text"), F.when(~(ok & text.isNotNull()), F.col("value")).alias("raw"))


def dialogue_turns(first: DataFrame, second: DataFrame) -> DataFrame:
    """(video_id, time, text): the assistant's turns of all conversations; videos without any take those of the other dialect (from, value, timestamp)."""
    a = first.select("video_id", F.explode("conversations").alias("c")).select("video_id", F.explode("c.conversation").alias("t")).filter("t.role = 'assistant'").select("video_id", F.col("t.time").alias("time"), F.col("t.content").alias("text"))
    b = second.select("video_id", F.explode("turns").alias("t")).filter("t.from IN ('assistant', 'gpt')").select("video_id", F.col("t.timestamp").alias("time"), F.col("t.value").alias("text"))
    return a.unionByName(b.join(a.select("video_id").distinct(), "video_id", "left_anti"))


def tree_rows(trees: DataFrame, key: str) -> DataFrame:
    """(key, type, id, start_ts, end_ts, name) of three-level trees; ids are places: 1, 1.2, 1.2.3."""
    place = lambda *p: F.concat_ws(".", *[(F.col(x) + 1).cast("string") for x in p])
    row = lambda df, kind, node, *p: df.select(key, F.lit(kind).alias("type"), place(*p).alias("id"), f"{node}.start_ts", f"{node}.end_ts", f"{node}.name")
    steps = trees.select(key, F.posexplode("steps").alias("i", "s"))
    subs = steps.select(key, "i", F.posexplode("s.substeps").alias("j", "u"))
    actions = subs.select(key, "i", "j", F.posexplode("u.actions").alias("k", "a"))
    return row(steps, "STEP", "s", "i").unionByName(row(subs, "SUBSTEP", "u", "i", "j")).unionByName(row(actions, "ACTION", "a", "i", "j", "k"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def schema_json(schema: str) -> str:
    """A DDL schema as JSON text, to be kept with a data set."""
    return json.dumps(json.loads(StructType.fromDDL(schema).json()))
