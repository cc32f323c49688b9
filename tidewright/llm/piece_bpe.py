"""SentencePiece (merge type) encoding by a prefix table, and decoding.

A merge-type encoding is unique, and so is that of every prefix of a text. The table stores one number per prefix: the
last token of its encoding. It is filled from left to right: an automaton over the vocabulary lists the tokens that end
at a place, and the one that belongs there is the one that is compatible with the last token of the
prefix before it, that is, whose pair with it encodes to just these two. The ids are then read backwards from the end.

No piece of these vocabularies crosses from a word into a following blank, or holds a line feed, so a text is
encoded word by word and the words' ids are kept in a bounded table. Words of any length, blank runs and characters that no
piece holds all go through the table. The merges themselves run only on pairs of pieces, to test whether they are compatible.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: What stands for a blank.
MARK = "▁"


class PieceModel:
    """Vocabulary of a SentencePiece model of merge type with byte fallback, identity normalisation and dummy prefix."""

    def __init__(self, path: str, cache_words: int = 300_000) -> None:
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.byte_ids = {int(p[1:-1], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        special = {i for i in range(len(self.pieces)) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.special = special
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.scores = [model.get_score(i) for i in range(len(self.pieces))]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("a piece goes on after a word's end, so words can't be encoded one by one")
        self.bytes_of = {i: bytes([b]) for b, i in self.byte_ids.items()} | {i: p.replace(MARK, " ").encode() for p, i in self.ids.items()}
        self.bytes_named = {str(i): b for i, b in self.bytes_of.items()}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if self.merge(p) == [i]:  # other pieces are never the outcome of merges
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.words: dict[str, str] = {}
        self.cache_words = cache_words

    def merge(self, text: str) -> list[int]:
        """Ids of *text* (blanks already marked) by the merges themselves: best score first, leftmost of equals."""
        n = len(text)
        part, left, right = list(text), list(range(-1, n - 1)), [*range(1, n), -1]
        queue: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (i := self.ids.get(joined := part[a] + part[b])) is not None:
                heapq.heappush(queue, (-self.scores[i], a, b, joined))

        for a in range(n - 1):
            offer(a, a + 1)
        while queue:
            _, a, b, joined = heapq.heappop(queue)
            if not part[a] or not part[b] or right[a] != b or part[a] + part[b] != joined:
                continue
            part[a], part[b], right[a] = joined, "", right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        out = []
        for p in part:
            if p:
                out += [self.ids[p]] if p in self.ids else [self.byte_ids[b] for b in p.encode("utf-8", "replace")]
        return out

    def _compatible(self, a: int, b: int) -> bool:
        fits = self.fits.get((a, b))
        if fits is None:
            if len(self.fits) > 400_000:
                self.fits.clear()
            fits = self.fits[a, b] = self.merge(self.pieces[a] + self.pieces[b]) == [a, b]
        return fits

    def unit(self, unit: str) -> list[int]:
        """Ids of a word with the blanks before it, by the prefix table. A character that no piece holds stands alone, as bytes."""
        n, fits = len(unit), self.fits
        last: list[int | None] = [None] * (n + 1)  # None at the start and after a character that no piece holds: nothing merges across it
        size = [1] * (n + 1)
        for end, (length, i) in self.automaton.iter(unit):
            before = last[end + 1 - length]
            ok = before is None or fits.get((before, i))
            if ok is None:
                ok = self._compatible(before, i)
            if ok:
                last[end + 1], size[end + 1] = i, length
        out: list[int] = []
        at = n
        while at > 0:
            i = last[at]
            if i is None:
                out += [self.byte_ids[b] for b in reversed(unit[at - 1].encode("utf-8", "replace"))]
                at -= 1
            else:
                out.append(i)
                at -= size[at]
        out.reverse()
        return out

    def units(self, text: str) -> list[str]:
        return _UNITS(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str | None) -> list[int]:
        """Ids of *text*, without begin and end; null and empty texts have none."""
        return [i for unit in self.units(text or "") for i in self.unit(unit)]

    def encode_joined(self, text: str | None) -> str:
        """The ids in decimal, joined by commas; words met before are looked up."""
        words, parts = self.words, self.units(text or "")
        out = list(map(words.get, parts))
        if None in out:
            for at, have in enumerate(out):
                if have is None:
                    unit = parts[at]
                    out[at] = words.get(unit) or ",".join(map(str, self.unit(unit)))
                    if len(unit) <= 40:
                        if len(words) >= self.cache_words:
                            words.clear()
                        words[unit] = out[at]
        return ",".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of *ids*: pieces joined, marks as blanks, the dummy prefix's blank dropped, byte runs read as UTF-8."""
        return self._read(map(self.bytes_of.__getitem__, ids))

    def decode_joined(self, joined: str) -> str:
        """decode() of ids in decimal, joined by commas."""
        return self._read(map(self.bytes_named.__getitem__, joined.split(","))) if joined else ""

    @staticmethod
    def _read(parts: Iterable[bytes]) -> str:
        return b"".join(parts).decode("utf-8", "replace").removeprefix(" ")


_UNITS = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+").findall
_models: dict[str, PieceModel] = {}


def load_model(path: str) -> PieceModel:
    """The model at *path*, one per process."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def piece_encode(docs: DataFrame, model_path: str) -> DataFrame:
    """*docs* (text, ...) with the columns ids (array of int) and decoded (text) added.

    Null and empty texts give no ids and an empty decoded text. Texts of any length are encoded whole. Rows are independent, so
    repeated rows and ties stay as they are, and an empty table gives an empty table. Other columns, nulls in them too, pass
    through, but columns named ids or decoded are replaced. *model_path* must be readable on every executor (the vocabulary files are installed with Python).
    """
    docs = docs.drop("ids", "decoded")
    schema = StructType([*docs.schema.fields, StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])
    at, names = docs.columns.index("text"), [*docs.columns, "ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(model_path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = [[int(x) for x in s.split(",")] if (s := model.encode_joined(t.as_py())) else [] for t in part.column(at)]
                decoded = pa.array([model.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32())), decoded], names)

    return docs.mapInArrow(run, schema)


def piece_digests(docs: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """*keep* columns with n_tokens, ids_sha256 and decoded_sha256 of each whole text's encoding and its decoding.

    Null and empty texts have no tokens, and the digests of an empty string. Columns that aren't in *keep* don't matter.
    """
    from hashlib import sha256

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(model_path)
        for batch in batches:
            rows = []
            for t in batch.column(len(keep)):
                joined = model.encode_joined(t.as_py())
                decoded = model.decode_joined(joined)
                n = joined.count(",") + 1 if joined else 0
                rows.append((n, sha256(joined.encode()).hexdigest(), sha256(decoded.encode()).hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], [*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(*keep, "text").mapInArrow(run, f"{fields}, n_tokens long, ids_sha256 string, decoded_sha256 string")
