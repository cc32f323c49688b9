"""Rendering and cleaning of dialogue text, prompts and names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Match windows in seconds by data set; the first name found in the data set's name wins.
MATCH_WINDOWS = (
    ("narration", -2.5, 2.5),
    ("ego4d", -4.0, 8.5),
    ("epickitchens", -1.5, 3.0),
    ("holoassist", -1.5, 2.5),
    ("egoexolearn", -2.0, 3.5),
    ("assembly101", -2.0, 4.0),
    ("wtag", -3.0, 6.0),
)
DEFAULT_WINDOW = (-2.5, 2.5)
# Marks of the chat format, and marks that generated text may hold.
BEGIN, HEAD, HEAD_END, TURN_END = "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>\n\n", "<|eot_id|>"
ARTIFACTS = ("<image>", "<|image|>", "<|endoftext|>", "<|end|>")
TASKS = (("coffee", "Make pour-over coffee"), ("tortilla", "Make pinwheels"))
DEFAULT_TASK = "Make mug cake"
OVERVIEW, PERSONA, STATE_TITLE = (
    "DST Task Overview:",
    "You are a proactive assistant. Pay close attention to the user's actions and provide relevant information proactively.",
    "Dialogue State:",
)


def round_time(t: Column) -> Column:
    """One decimal, halves to even."""
    return F.bround(t, 1)


def clean_annotation(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.trim(text), F.lit("_"), F.lit(" ")), F.lit("student"), F.lit("user")), F.lit("*unintelligible*"), F.lit(""))


def merge_narrations(items: Column) -> Column:
    """The first two narrations that begin with "#C C" and aren't unsure, as one sentence; a second mark inside one ends it."""

    def one(t: Column, i: Column) -> Column:
        again = F.instr(F.substring(t, 2, 2147483647), "#C C")
        cut = F.when(again > 0, F.trim(F.substring(t, F.lit(1), again))).otherwise(t)
        return F.replace(cut, F.lit("#C C"), F.when(i == 0, "C").otherwise("and"))

    first = F.slice(items, 1, 2)
    fit = F.filter(F.transform(first, lambda t, i: F.when(t.startswith("#C C") & ~F.lower(t).contains("#unsure"), one(t, i))), lambda t: t.isNotNull())
    joined = F.trim(F.array_join(fit, " "))
    return F.when((joined != "") & ~joined.endswith("."), F.concat(joined, F.lit("."))).otherwise(joined)


def task_of(text: Column) -> Column:
    low, out = F.lower(text), None
    for word, task in TASKS:
        out = F.when(low.contains(word), task) if out is None else out.when(low.contains(word), task)
    return out.otherwise(DEFAULT_TASK)


def goal_of(text: Column) -> Column:
    """First line without asterisks."""
    return F.trim(F.replace(F.split(text, "\n")[0], F.lit("*"), F.lit("")))


def describe_updates(updates: Column) -> Column:
    """A sentence for each of an array of struct(step_id, transition)."""

    def one(u: Column) -> Column:
        step, move = F.concat(F.lit("Step "), u["step_id"]), u["transition"]
        return F.when(move == "start", F.concat(step, F.lit(" has been started."))).when(move == "complete", F.concat(step, F.lit(" has been completed."))).otherwise(F.concat(step, F.lit(" state changed to "), move, F.lit(".")))

    return F.when(F.size(updates) == 0, "Dialogue state updated.").otherwise(F.array_join(F.transform(updates, one), " "))


def system_prompt(steps: Column, states: Column) -> Column:
    """Prompt of an array of struct(step_id, name) and a map of states: overview, persona, states in order of step numbers."""
    known = F.transform(steps, lambda s: F.struct(F.substring(s["step_id"], 2, 2147483647).try_cast("int").alias("n"), s["step_id"].alias("s"), F.coalesce(F.try_element_at(states, s["step_id"]), F.lit("not_started")).alias("v")))
    line = F.array_join(F.transform(F.array_sort(known), lambda s: F.concat(F.lit("Step "), s["s"], F.lit(": "), s["v"])), ", ")
    overview = F.concat(F.lit(OVERVIEW + "\n"), F.array_join(F.transform(steps, lambda s: F.concat(s["step_id"], F.lit(": "), s["name"])), "\n"), F.lit("\n\n"))
    return F.concat(F.when(F.size(steps) > 0, overview).otherwise(""), F.lit(f"{PERSONA}\n\n{STATE_TITLE}\nCurrent step states - "), line)


def chat_message(role: Column, content: Column, frames: Column | None = None, image: str = "<image>") -> Column:
    """A turn in the chat format; a turn of frames is as many image marks."""
    said = F.concat(F.lit(HEAD), role, F.lit(HEAD_END), F.trim(content), F.lit(TURN_END))
    return said if frames is None else F.when(role == "frames", F.repeat(F.lit(image), frames)).otherwise(said)


def clean_generated(text: Column) -> Column:
    """struct(text, role): what was generated before the turn's end, without marks; a role that leads it is split off; a lone dot is empty."""
    t = F.replace(F.trim(F.substring_index(text, TURN_END, 1)), F.lit(BEGIN), F.lit(""))
    for mark in ARTIFACTS:
        t = F.replace(t, F.lit(mark), F.lit(""))
    header = t.contains(HEAD_END)
    role = F.when(header, F.replace(F.substring_index(t, HEAD_END, 1), F.lit(HEAD), F.lit("")))
    body = F.when(header, F.regexp_replace(t, r"(?s)^.*?<\|end_header_id\|>\n\n", "")).otherwise(t)
    lead = F.lower(F.trim(F.substring_index(body, ":", 1)))
    named = body.contains(":") & lead.isin("assistant", "user", "system")
    final = F.when(named, F.trim(F.regexp_replace(body, r"(?s)^[^:]*:", ""))).when(body == ".", "").otherwise(body)
    return F.struct(final.alias("text"), F.when(named, lead).otherwise(role).alias("role"))


def clean_summary(text: Column, prompt: str) -> Column:
    """What follows the last "Assistant:", without the prompt."""
    t = F.when(text.contains("Assistant:"), F.trim(F.substring_index(text, "Assistant:", -1))).otherwise(text)
    return F.when(t.contains(prompt), F.trim(F.replace(t, F.lit(prompt), F.lit("")))).otherwise(t) if prompt else t


def fill_template(template: str, **values: Column) -> Column:
    """*template* with each {name} replaced by a column; a null drops to an empty text."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def match_window(dataset: Column) -> Column:
    """struct(left, right) seconds."""
    out = None
    for name, left, right in MATCH_WINDOWS:
        value = F.struct(F.lit(left).alias("left"), F.lit(right).alias("right"))
        out = F.when(dataset.contains(name), value) if out is None else out.when(dataset.contains(name), value)
    return out.otherwise(F.struct(F.lit(DEFAULT_WINDOW[0]).alias("left"), F.lit(DEFAULT_WINDOW[1]).alias("right")))


def parse_setups(text: Column) -> Column:
    """Array of struct(dataset, runner, max_len, threshold, context) of comma-separated "dataset|runner|4k|0.3|method"; a method counts for streams only."""

    def one(s: Column) -> Column:
        p = F.split(s, r"\|")
        length = F.regexp_replace(p[2], ".$", "").cast("int") * 1024
        return F.struct(p[0].alias("dataset"), p[1].alias("runner"), length.alias("max_len"), p[3].cast("double").alias("threshold"), F.when(p[1] == "stream", p[4]).alias("context"))

    return F.transform(F.split(text, ","), one)


def resolve_dataset(name: Column, root: str) -> Column:
    """struct(folder, file, repeat, short) of "folder/file[@repeat]"; the short name goes up to val or test."""
    path = F.substring_index(name, "@", 1)
    folder, item = F.substring_index(path, "/", 1), F.substring_index(path, "/", -1)
    repeat = F.when(name.contains("@"), F.substring_index(name, "@", -1).try_cast("int"))
    short = F.when(path.contains("val"), F.concat(F.substring_index(path, "val", 1), F.lit("val"))).when(path.contains("test"), F.concat(F.substring_index(path, "test", 1), F.lit("test"))).otherwise(path)
    return F.struct(F.concat(F.lit(root + "/"), folder).alias("folder"), F.concat(F.lit(root + "/"), folder, F.lit("/prepared/"), item, F.lit(".jsonl")).alias("file"), F.coalesce(repeat, F.lit(1)).alias("repeat"), short.alias("short"))


def feature_folder(model: Column, layer: int = -2) -> Column:
    return F.concat(F.lit("features/"), F.replace(model, F.lit("/"), F.lit("___")), F.lit(f"@{layer}"))


def video_id(stem: Column) -> Column:
    """The first part of a file's name, split at underscores, that looks like a video id; null without one."""
    parts = F.filter(F.split(stem, "_"), lambda p: (p.contains("-") & (F.length(p) < 20)) | (p.startswith("P") & (F.length(p) < 10)) | p.rlike(r"^T\d+$"))
    return F.when(stem.contains("_"), F.try_element_at(parts, F.lit(1)))


def run_name(dataset: Column, threshold: Column, length: Column) -> Column:
    return F.concat_ws("_", dataset, F.concat(F.lit("t"), threshold.cast("string")), F.concat(F.lit("len"), length.cast("string")))


def simple_tokens(text: Column) -> Column:
    """Lower-cased words and numbers, without punctuation; an approximation of a treebank tokenizer."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:'[\p{L}]+)?"), F.lit(0))


def token_range(offsets: Column, start: Column, stop: Column) -> Column:
    """struct(first, last) of tokens for a range of characters, from the tokens' start offsets; null past the last token."""
    at = lambda x: F.size(F.filter(offsets, lambda o: o < x))
    return F.when(start <= F.array_max(offsets), F.struct(at(start).alias("first"), at(stop).alias("last")))


def marker_grid(first: Column, last: Column, frames: int = 20) -> Column:
    """A text of *frames* marks: # where a frame lies from *first* to *last*, else a dot."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda i: F.when(i.between(first, last), "#").otherwise(".")), "")
