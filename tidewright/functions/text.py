"""Parsers and formatters of annotation text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword lists that decide labels and durations. The first list with a word in the text wins.
SPEAK_LABELS = (
    ("feedback", ("good", "well done", "excellent", "correct")),
    ("info_sharing", ("information", "explain", "because", "since")),
    ("correction", ("actually", "wait", "correction", "sorry")),
    ("initiation", ("start", "begin", "initiate")),
    ("completion", ("complete", "finish", "done")),
)
USER_LABELS = (
    ("help_request", ("help", "assist", "support")),
    ("question", ("what", "how", "why", "where")),
    ("action_request", ("do", "perform", "execute")),
    ("gratitude", ("thank", "thanks")),
)
DURATIONS = (
    (6.0, ("screw", "tighten", "unscrew")),
    (10.0, ("attach", "place", "insert", "connect", "remove", "detach")),
    (12.0, ("demonstrate", "show", "roll", "inspect")),
)
DEFAULT_DURATION = 8.0
INTENTIONS = (("instruction", "instruction"), ("correction", "correction"), ("info", "info_sharing"), ("feedback", "feedback"))
STOP_VERBS = ("hold", "touch", "rotate", "inspect")
TRANSITION_CODES = {"start": 0, "complete": 1, "pause": 2, "resume": 3, "cancel": 4, "reset": 5}
STATE_CODES = {"not_started": 0, "in_progress": 1, "completed": 2, "paused": 3, "cancelled": 4, "failed": 5}
ROLE_CODES = {"user": 0, "assistant": 1, "system": 2, "speak": 1, "dst_update": 3}


def holds_any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def first_keyword(text: Column, table: tuple, default: object = None) -> Column:
    """The value of the first row of *table* (value, words) with a word in *text*, which is lower-cased."""
    low, out = F.lower(text), None
    for value, words in table:
        out = F.when(holds_any(low, words), F.lit(value)) if out is None else out.when(holds_any(low, words), F.lit(value))
    return out.otherwise(F.lit(default))


def infer_duration(text: Column) -> Column:
    """Seconds that a point event is taken to last; a word counts inside others, as in "unscrew"."""
    return first_keyword(text, DURATIONS, DEFAULT_DURATION)


def speak_labels(text: Column) -> Column:
    return F.concat_ws(",", F.lit("initiative|instruction"), first_keyword(text, SPEAK_LABELS))


def user_labels(text: Column) -> Column:
    return F.concat_ws(",", F.lit("user|input"), first_keyword(text, USER_LABELS))


def turn_labels(role: Column, text: Column) -> Column:
    """Labels by role; assistant and SPEAK turns are the same, and so are user and USER turns."""
    kind = F.lower(role)
    return F.when(kind.isin("assistant", "speak"), speak_labels(text)).when(kind == "user", user_labels(text)).otherwise(F.concat(kind, F.lit("|generic")))


def update_labels(transitions: Column, step_ids: Column) -> Column:
    """Labels of a state update from its transitions and step ids, both arrays."""
    start, done = F.array_contains(transitions, "start"), F.array_contains(transitions, "complete")
    kind = F.when(start & done, "dst_multiple").when(start, "dst_start").when(done, "dst_complete").otherwise("dst_state_change")
    n = F.size(F.array_distinct(step_ids))
    return F.concat_ws(",", F.lit("initiative|dst_update"), kind, F.when(n > 0, F.concat(F.lit("steps_"), n.cast("string"))))


def initiativity(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.contains("initiative"), "initiative").when(low.contains("responsive"), "responsive")


def intention(text: Column) -> Column:
    """All intentions named in *text*, in fixed order; other where none is."""
    low = F.lower(text)
    joined = F.concat_ws(",", *[F.when(low.contains(word), name) for word, name in INTENTIONS])
    return F.when(joined == "", "other").otherwise(joined)


def code_of(name: Column, codes: dict[str, int], default: int) -> Column:
    """Integer code of a lower-cased name."""
    pairs = [x for k, v in codes.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(name)), F.lit(default))


def approximate_tokens(text: Column) -> Column:
    """A quarter of the characters, at least one; none for an empty text."""
    return F.when(F.coalesce(F.char_length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(F.floor(F.char_length(text) / 4), F.lit(1))).cast("int")


def words_of(text: Column) -> Column:
    """Words between white space; an empty array for a blank or null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r\f\x0b]+"), lambda w: w != "")


def capitalize(text: Column) -> Column:
    """First character upper-cased, the rest lower-cased."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2147483647)))


def caption(text: Column) -> Column:
    """A capitalised sentence that ends with a full stop unless it ends with one of .?! already."""
    t = F.trim(text)
    return capitalize(F.when(F.substring(t, -1, 1).isin(".", "?", "!"), t).otherwise(F.concat(t, F.lit("."))))


def case_connect(a: Column, b: Column) -> Column:
    """Join two texts: after a comma or colon the second begins in lower case, else in upper case."""
    lowered = F.concat(F.lower(F.substring(b, 1, 1)), F.substring(b, 2, 2147483647))
    raised = F.concat(F.upper(F.substring(b, 1, 1)), F.substring(b, 2, 2147483647))
    return F.concat(a, F.lit(" "), F.when(F.substring(a, -1, 1).isin(",", ":"), lowered).otherwise(raised))


def format_size(n: Column) -> Column:
    """Counts in K, M or G with one decimal, base 1000."""
    one = lambda x, unit: F.concat(F.bround(x, 1).cast("decimal(20,1)").cast("string"), F.lit(unit))
    d = n.cast("double")
    return F.when(n < 1000, n.cast("string")).when(n < 10**6, one(d / 1e3, "K")).when(n < 10**9, one(d / 1e6, "M")).otherwise(one(d / 1e9, "G"))


def seconds_of(stamp: Column) -> Column:
    """HH:MM:SS.fraction in seconds."""
    p = F.split(stamp, ":")
    return p[0].cast("double") * 3600 + p[1].cast("double") * 60 + p[2].cast("double")


def frame_of(seconds: Column, fps: float, rounding: str = "round") -> Column:
    """Frame number of a time; halves are rounded to even."""
    x = seconds * fps
    return {"round": F.rint(x), "floor": F.floor(x), "ceil": F.ceil(x)}[rounding].cast("long")


def frame_of_stamp(stamp: Column, fps: float, rounding: str = "round") -> Column:
    """Frame number of HH:MM:SS.m, where m counts milliseconds: .5 is five of them."""
    p = F.split(stamp, "[:.]")
    s = p[0].cast("int") * 3600 + p[1].cast("int") * 60 + p[2].cast("int") + p[3].cast("int") / 1000
    return frame_of(s, fps, rounding)


def stamp_of_frame(frame: Column, fps: int) -> Column:
    """HH:MM:SS of a frame; a started second counts, without carry into the minutes. Hours from 100 on keep all their digits."""
    total = frame / F.lit(float(fps))
    digits = lambda x: x.cast("long").cast("string")
    two = lambda x: F.lpad(digits(x), F.greatest(F.length(digits(x)), F.lit(2)), F.lit("0"))
    part = F.floor((total % 1) * 1000)
    return F.concat(two(F.floor(total / 3600)), F.lit(":"), two(F.floor(total % 3600 / 60)), F.lit(":"), two(F.floor(total % 60) + F.when(part > 0, 1).otherwise(0)))


def frame_file(frame: Column, prefix: str = "", digits: int = 10, extension: str = "jpg") -> Column:
    return F.concat(F.lit(prefix), F.lpad(frame.cast("string"), digits, "0"), F.lit(f".{extension}"))


def parse_block(line: Column) -> Column:
    """struct(text, start_ts, end_ts) of "[a s-b s] text" or "[a s] text"; end_ts is null for a point, all of it where nothing parses."""
    pattern = r"\[(\d+\.?\d*)s?(?:-(\d+\.?\d*)s?)?\](.*)$"
    start = F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")).cast("double")
    end = F.nullif(F.regexp_extract(line, pattern, 2), F.lit("")).cast("double")
    text = F.trim(F.regexp_replace(F.trim(F.regexp_extract(line, pattern, 3)), r"^[-•]\s*", ""))
    return F.when(start.isNotNull() & (text != ""), F.struct(text.alias("text"), start.alias("start_ts"), end.alias("end_ts")))


def parse_block_trailing_unit(line: Column) -> Column:
    """As parse_block() for the dialect with one unit after the range, "[a-b s]"; a point lasts its inferred duration."""
    pattern = r"^\s*(?:[-•]\s*)?\[(\d+\.?\d*)(?:-(\d+\.?\d*))?s\]\s*(.+)$"
    start = F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")).cast("double")
    end = F.nullif(F.regexp_extract(line, pattern, 2), F.lit("")).cast("double")
    text = F.trim(F.regexp_replace(F.regexp_extract(line, pattern, 3), r"^[-•]\s*", ""))
    return F.when(start.isNotNull(), F.struct(text.alias("text"), start.alias("start_ts"), F.coalesce(end, start + infer_duration(text)).alias("end_ts")))


def step_name(line: Column) -> Column:
    """The name in a numbered line "3. name"; null elsewhere."""
    return F.nullif(F.trim(F.regexp_extract(F.trim(line), r"^\d+\.\s+(.+)$", 1)), F.lit(""))


def parse_turn(line: Column) -> Column:
    """struct(time, role, content, labels) of "[t s] Role: text [a|b]"; null for other roles, bad times and asides in brackets.

    The text may have several lines.
    """
    pattern = r"^\[(.*?)s\] (.*?): ((?s:.*))"
    time = F.regexp_extract(line, pattern, 1).try_cast("double")
    role = F.lower(F.regexp_extract(line, pattern, 2))
    raw = F.trim(F.regexp_extract(line, pattern, 3))
    tag = r"\[(.*?)\|(.*?)\]"
    tagged = F.regexp_extract(raw, tag, 0) != ""
    labels = F.when(tagged, F.concat_ws("|", initiativity(F.regexp_extract(raw, tag, 1)), intention(F.regexp_extract(raw, tag, 2)))).otherwise("initiative|other")
    content = F.trim(F.regexp_replace(raw, r"\[.*?\|.*?\]", ""))
    return F.when(time.isNotNull() & role.isin("user", "assistant") & ~raw.startswith("("), F.struct(time.alias("time"), role.alias("role"), content.alias("content"), F.when(role == "assistant", labels).otherwise("").alias("labels")))


def parse_update(text: Column) -> Column:
    """struct(step_id, transition) of "S1 -> start", cut at the first arrow."""
    at = F.instr(text, "->")
    return F.when(at > 0, F.struct(F.trim(F.substring(text, F.lit(1), at - 1)).alias("step_id"), F.trim(F.substring(text, at + 2, F.char_length(text))).alias("transition")))


def is_garbage(text: Column, most: int) -> Column:
    """More than *most* words, all equal."""
    w = words_of(text)
    return (F.size(w) > most) & (F.size(F.array_distinct(w)) == 1)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two texts' lower-cased word sets; 0 where both are empty."""
    x, y = F.array_distinct(words_of(F.lower(a))), F.array_distinct(words_of(F.lower(b)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def letters_to_number(letters: Column) -> Column:
    """a = 1, b = 2, ... aa = 27; -1 for anything but small letters."""
    value = F.aggregate(F.split(letters, ""), F.lit(0).cast("long"), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 96))
    return F.when(letters.rlike("^[a-z]+$"), value).otherwise(F.lit(-1).cast("long"))


def uuid5_dns(name: Column) -> Column:
    """Version-5 UUID of *name* in the DNS namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8")), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def json_object_text(text: Column) -> Column:
    """The outermost {...} of *text*, without code fences and trailing commas."""
    bare = F.regexp_replace(text, r"```(?:json)?", "")
    return F.regexp_replace(F.regexp_extract(bare, r"(?s)\{.*\}", 0), r",(\s*[}\]])", "$1")


def cosine(a: Column, b: Column, epsilon: float = 0.0) -> Column:
    """Cosine of two arrays of numbers; *epsilon* is added to the norms' product."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + epsilon)
