"""Sequential passes over one conversation at a time: packing into budgets, time repair, chunking.

Each is a fold whose state resets on data it has seen, so it runs per key in pandas. Conversations are short; a key's turns
fit a task by far.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.grouped import fold_groups


def _per_key(df: DataFrame, key: str, order: str, columns: list[str], fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """*fold* over each key's rows in *order*; *schema* adds to the key's and the order's columns."""
    kinds = dict(df.dtypes)
    return fold_groups(df, key, [order], columns, fold, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, {schema}")


def turn_cost(frames: Column, text: Column, per_frame: int, extra: int = 10) -> Column:
    """Estimated tokens of a turn: its frames, a quarter of its characters, and a fixed part."""
    return F.coalesce(frames, F.lit(0)) * per_frame + F.greatest(F.floor(F.char_length(text) / 4), F.lit(1)) + extra


def cut_parts(role: list[str], price: list[int], most: int, opening: Callable[[int | None], int] = lambda reply: 0) -> list[tuple[int, int]]:
    """(first, last) place of each part of a conversation, cut after the last assistant turn that fits, whenever the running cost passes *most*.

    A part starts with the cost *opening* of the last reply before it (None for the first). What has no assistant turn is dropped
    from the part's start until the rest fits; a tail without one is dropped too.
    """
    parts: list[tuple[int, int]] = []
    begin = at = 0
    used = opening(None)
    while at < len(role):
        used += price[at]
        if used > most and at > begin:
            reply = next((i for i in range(at - 1, begin - 1, -1) if role[i] == "assistant"), None)
            if reply is None:
                while begin < at and used > most:
                    used -= price[begin]
                    begin += 1
            else:
                parts.append((begin, reply))
                begin, at, used = reply + 1, reply, opening(reply)
        at += 1
    if "assistant" in role[begin:]:
        parts.append((begin, len(role) - 1))
    return parts


def split_by_budget(turns: DataFrame, key: str, order: str, cost: str, most: int) -> DataFrame:
    """(key, order, segment): the parts of cut_parts(); turns in none are left out."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        segment = [-1] * len(rows)
        for k, (a, b) in enumerate(cut_parts(rows["role"].tolist(), rows[cost].tolist(), most)):
            segment[a : b + 1] = [k] * (b + 1 - a)
        return rows.assign(segment=segment)[[key, order, "segment"]].query("segment >= 0")

    return _per_key(turns, key, order, ["role", cost], fold, "segment int")


def _tokens(text: str | None) -> int:
    return max(1, len(text) // 4) if text else 0


def prepare_clips(turns: DataFrame, key: str, order: str, cost: str, most: int, prompts: tuple[str, ...], per_frame: int = 1, longest_summary: int = 768, summaries: bool = True, context: tuple[int, int] = (0, 0), fps: float = 2.0) -> DataFrame:
    """(key, clip, first, last, start_frame, end_frame, system_prompt, progress): training clips of each conversation.

    *turns*: role, progress (a reply's summary so far, or null), knowledge, start_frame, end_frame, n_frames. With *summaries* the longest
    of a conversation's ten wordiest summaries is kept free, with a frame and 20 tokens; conversations that would need more than
    *longest_summary* are left out. A clip opens with a system prompt, picked by a hash; later ones add the progress of the last reply before
    them and the knowledge. A clip that doesn't reach the end of the video closes with the progress of its last reply. Later clips
    keep some seconds of frames from before them, picked from *context* by a hash. Clips without frames are left out.
    """
    kind, place = dict(turns.dtypes)[key], dict(turns.dtypes)[order]
    schema = f"`{key}` {kind}, clip int, first {place}, last {place}, start_frame long, end_frame long, system_prompt string, progress string"
    names = [key, "clip", "first", "last", "start_frame", "end_frame", "system_prompt", "progress"]

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        name, role = rows[key].iloc[0], rows["role"].tolist()
        said = [None if pd.isna(p) else p for p in rows["progress"]]
        known = rows["knowledge"].iloc[0]
        known = "" if pd.isna(known) else f"Task knowledge: {known}"
        room = most
        if summaries:
            top = sorted((p for p in said if p is not None), key=lambda p: -len(p.split()))[:10]
            reserve = max(map(_tokens, top), default=0) + per_frame + 20
            if reserve > longest_summary:
                return pd.DataFrame([], columns=names)
            room -= reserve
        pick = lambda n, what: crc32(f"{name}/{n}/{what}".encode()) % len(what)

        def prompt(n: int, reply: int | None) -> str:
            before = next((said[i] for i in range(-1 if reply is None else reply, -1, -1) if said[i] is not None), None)
            return " ".join(x for x in (prompts[pick(n, prompts)], before, known if reply is not None else "") if x)

        parts = cut_parts(role, rows[cost].tolist(), room, lambda reply: _tokens(prompt(0, reply)))
        frames, out = rows[["start_frame", "end_frame"]].to_numpy(), []
        for n, (a, b) in enumerate(parts):
            start, end = int(frames[a, 0]), int(frames[b, 1])
            if n:
                seconds = range(context[0], context[1] + 1)
                start = max(0, start - int(seconds[pick(n, seconds)] * fps))
            if end <= start or end > rows["n_frames"].iloc[0]:
                continue
            reply = max((i for i in range(a, b + 1) if role[i] == "assistant"), default=None)
            progress = said[reply] if summaries and reply is not None and end + 1 < rows["n_frames"].iloc[0] else None
            out.append([name, len(out), rows[order].iloc[a], rows[order].iloc[b], start, end, prompt(len(out), parts[n - 1][1] if n else None), progress])
        return pd.DataFrame(out, columns=names)

    return fold_groups(turns, key, [order], ["role", "progress", "knowledge", "start_frame", "end_frame", "n_frames", cost], fold, schema)


def split_with_overlap(turns: DataFrame, key: str, order: str, cost: str, most: int, fill: float = 0.9, context: float = 5.0) -> DataFrame:
    """(key, order, segment, is_context): turns added until the cost would pass *fill* of *most* with two turns or more.

    A new segment begins with the turns of the last *context* seconds before it, as context.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        out, segment, used, held = [], 0, 0, 0
        for i, r in enumerate(rows.itertuples(index=False)):
            price = getattr(r, cost)
            if held >= 2 and used + price > fill * most:
                segment, used, held = segment + 1, 0, 0
                for b in rows.iloc[:i].itertuples(index=False):
                    if b.time >= r.time - context:
                        out.append((getattr(b, key), getattr(b, order), segment, True))
                        used += getattr(b, cost)
            out.append((getattr(r, key), getattr(r, order), segment, False))
            used, held = used + price, held + 1
        return pd.DataFrame(out, columns=[key, order, "segment", "is_context"])

    return _per_key(turns, key, order, ["time", cost], fold, "segment int, is_context boolean")


def pack(df: DataFrame, key: str, order: str | list[str], cost: str, most: int, keep_last: bool = True, place: str | None = None) -> DataFrame:
    """(key, order, bin): items in order, a new bin whenever the next one would reach *most*. *keep_last* False drops the last item.

    With *place* that column, an item's number in its key from 1, stands in for those of *order*. A task holds one batch of rows, however many keys or
    items of one key it has.
    """
    orders, kinds = [order] if isinstance(order, str) else order, dict(df.dtypes)
    names = [key, *([place] if place else orders)]
    schema = ", ".join(f"`{c}` {'long' if c == place else kinds[c]}" for c in names) + ", bin int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, at, used, n = None, 0, 0, 0  # the last row so far, which opens or goes on with the next batch's first key
        for rows in batches:
            if not len(rows):
                continue
            k = rows[key]
            before = k.shift(fill_value=k.iat[0] if held is None else held[key].iat[0])
            first = ~((k == before) | (k.isna() & before.isna())).to_numpy(bool)
            first[0] |= held is None
            bins, places = [], []
            for opens, price in zip(first.tolist(), rows[cost].tolist(), strict=True):
                if opens:
                    at, used, n = 0, 0, 0
                elif used and used + price >= most:
                    at, used = at + 1, 0
                used, n = used + price, n + 1
                bins.append(at)
                places.append(n)
            out = rows.assign(bin=bins, **({place: places} if place else {}))[[*names, "bin"]]
            if keep_last:
                yield out
            elif held is None:
                yield out.iloc[:-1][~first[1:]]
            else:
                yield pd.concat([held, out.iloc[:-1]], ignore_index=True)[~first]
            held = out.iloc[-1:]

    wanted = list(dict.fromkeys([key, *orders, cost]))
    return df.select(*wanted).repartition(key).sortWithinPartitions(key, *orders).mapInPandas(run, schema)


def adjust_times(turns: DataFrame, key: str, order: str, least: float = 0.5, shift: float = 1.0) -> DataFrame:
    """(key, order, role, time): turns that follow another within *least* seconds, but for replies to a user, are moved.

    Such a turn goes to *shift* seconds after the one before, with those after it that lie closer than that; repeated until none is left.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        time, role, n = rows["time"].tolist(), rows["role"].tolist(), len(rows)
        moved = True
        while moved:
            moved = False
            for i in range(1, n):
                if time[i] - time[i - 1] < least and (role[i - 1], role[i]) != ("user", "assistant"):
                    last = i
                    while last + 1 < n - 1 and time[last + 1] - time[i] < shift:
                        last += 1
                    time[i : last + 1] = [time[i - 1] + shift] * (last + 1 - i)
                    moved = True
        return rows.assign(time=time)

    return _per_key(turns, key, order, ["role", "time"], fold, "role string, time double")


def chunk_by_weight(df: DataFrame, key: str, order: str, weight: str, most: int) -> DataFrame:
    """(key, order, chunk): consecutive items; a chunk closes with the item that brings its weight over *most*."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        chunk, at, used = [], 0, 0
        for w in rows[weight]:
            chunk.append(at)
            used += w
            if used > most:
                at, used = at + 1, 0
        return rows.assign(chunk=chunk)[[key, order, "chunk"]]

    return _per_key(df, key, order, [weight], fold, "chunk int")


def segment_summary(turns: DataFrame, key: list[str]) -> DataFrame:
    """Per segment: turns, assistant turns, first and last time."""
    return turns.groupBy(*key, "segment").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "assistant").alias("replies"), F.min("time").alias("begins"), F.max("time").alias("ends"))
