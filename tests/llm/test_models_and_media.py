"""Trained operators, encodings, archives and media, on messy tables."""

from __future__ import annotations

import random
from base64 import b32encode
from collections import Counter
from hashlib import sha1, sha256
from itertools import product
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import mpeg_audio, piece_language, subword_quality, toxicity
from tidewright.llm.block_search import block_search, search_tile
from tidewright.llm.piece_bpe import PieceModel, piece_digests, piece_encode
from tidewright.llm.queries import op4_subword_quality, op10_piece_language, tokenizer_path
from tidewright.llm.training import bounded_sample
from tidewright.llm.warc import CaptureIndex, build_index, look_up, read_ranges, url_key, write_archives

MODEL = tokenizer_path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [None, "", " ", "\n\n", "a", "漢字 and ▁ marks", "x" * 5000, "  spaces   everywhere  ", "É é\x00", "word " * 3000, "🙂🙂", "...", "12 34"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i if i else None, t, "en", "a", 1) for i, t in enumerate([*TEXTS, *TEXTS])], SCHEMA)


def test_pieces_match_the_library(spark, docs):
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), PieceModel(MODEL)
    r = random.Random(3)
    texts = [t or "" for t in TEXTS] + [a + " " * k + b for k in range(1, 70) for a in ("", "x", "\n") for b in ("", "foo", "漢", "{\r")]
    texts += ["".join(r.choice(letters) for _ in range(n)) for letters in ("abc", "漢字日本語文", "नमस्तेदुनिया") for n in (200, 201, 3000)]
    texts += ["".join(r.choice("ab theing.\n\t ▁é漢<>0xA") for _ in range(r.randint(1, 50))) for _ in range(800)]
    for t in texts:
        ids = library.encode(t)
        assert own.encode(t) == ids and own.encode_joined(t) == ",".join(map(str, ids))
        assert own.decode(ids) == own.decode_joined(own.encode_joined(t)) == library.decode(ids)
    got = Counter(tuple(x) for x in piece_digests(docs, MODEL).collect())
    want = Counter()
    for row in docs.collect():
        ids = library.encode(row.text or "")
        want[row.doc_id, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert got == want
    for row in piece_encode(docs, MODEL).collect():
        assert row.ids == library.encode(row.text or "") and row.decoded == library.decode(row.ids)


def test_every_piece_pair_by_the_table_and_by_merges():
    own = PieceModel(MODEL)
    r = random.Random(4)
    pieces = [p for p in own.ids if "▁▁" not in p]
    for _ in range(3000):
        word = r.choice(pieces).lstrip("▁") + "".join(r.choice(pieces).replace("▁", "") for _ in range(r.randint(0, 3)))
        assert own.unit("▁" + word) == own.merge("▁" + word)


def test_scores_of_messy_texts(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(1, 40)], "doc_id long, quality int, toxic int")
    model = subword_quality.fit_quality(docs, labels, epochs=1)
    scores = subword_quality.score_texts(docs, model).collect()
    assert len(scores) == len(TEXTS) * 2 and all(0 <= x.score <= 1 for x in scores)
    chain = toxicity.fit_toxicity(docs, labels)
    rows = toxicity.score_toxicity(docs, chain).collect()
    assert len(rows) == len(TEXTS) * 2 and all(0 <= x.p_toxic <= 1 for x in rows)
    language = piece_language.predict_language(docs, piece_language.fit_on_documents(docs, MODEL)).collect()
    want = Counter("und" if not any(map(str.isalpha, t or "")) else "en" for t in TEXTS * 2)
    assert Counter(x.lang_pred for x in language) == want
    none = docs.limit(0)
    assert subword_quality.score_texts(none, subword_quality.fit_quality(none, labels)).count() == 0
    assert toxicity.reject_toxic(none, labels).count() == 0
    assert {r.lang_pred for r in piece_language.predict_language(docs, piece_language.fit_on_documents(none, MODEL)).collect()} == {"und"}
    clash = docs.withColumns({"ids": F.lit(1), "decoded": F.lit("x"), "score": F.lit(0)})
    assert piece_encode(clash, MODEL).columns == [*docs.columns, "score", "ids", "decoded"] and piece_encode(none, MODEL).count() == 0
    assert subword_quality.score_texts(clash, subword_quality.fit_quality(clash, labels.withColumn("toxic", F.lit(None)))).columns == ["doc_id", "score"]


def test_word_sums_equal_averaging_the_vectors():
    rng = np.random.default_rng(1)
    value = rng.normal(size=1 << 12)
    text = "one two two Three, three " * 3
    total, n = 0.0, 0
    for w, c in subword_quality.word_counts(text).items():
        for i in subword_quality.word_features(w, len(value)):
            total += c * value[i]
            n += c
    assert subword_quality.SubwordModel(value, 0.5).scorer()(text) == pytest.approx(1 / (1 + np.exp(-(0.5 + total / n))))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for row in (rows := op4_subword_quality(spark, sf).collect()):
        assert row.held_out == (crc32(str(row.doc_id).encode()) % 5 == 0)
    held = [(r.predicted, labels[r.doc_id].quality) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) > 0.95
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in op10_piece_language(spark, sf).collect() if r.held_out]) > 0.97


def test_words_of_any_length_are_summed_over_all_segmentations():
    """Against a plain recursion with the whole vocabulary: long words, scripts without blanks, unknown characters."""
    vocabulary = piece_language.load_vocabulary(MODEL)
    assert max(map(len, vocabulary)) == 16 and len(vocabulary) > 31_000
    rng, r = np.random.default_rng(8), random.Random(8)
    p = rng.random((len(vocabulary) + 1, 2)) * 1e-4
    model = piece_language.LanguageModel(["x", "y"], p, vocabulary)

    def plain(word, k):
        a = [0.0]
        for j in range(1, len(word) + 1):
            terms = [a[i] + np.log(p[vocabulary.get(word[i:j], len(vocabulary)), k]) for i in range(max(0, j - 16), j) if word[i:j] in vocabulary or j == i + 1]
            a.append(max(terms) + np.log(sum(np.exp(t - max(terms)) for t in terms)))
        return a[-1]

    words = ["▁" + "".join(r.choice("abcdeinrst漢字日é🙂ǝ") for _ in range(n)) for n in (1, 7, 23, 24, 25, 60, 300, 2000)] + ["▁internationalization" * 5]
    assert np.allclose(model.word_scores(words), [[plain(w, k) for k in (0, 1)] for w in words])
    assert list(piece_language.words_of("Ab 12 " + "x" * 30)) == ["▁ab", "▁" + "x" * 30]
    text = " ".join(w[1:] for w in words if w[1:].isalpha())
    small, large = model.scorer(cache_cells=4)([text] * 2), model.scorer()([text, None, ""])
    assert small[0] == small[1] and small[0][0] == large[0][0] and small[0][1] == pytest.approx(large[0][1]) and large[1:] == [("und", 0.0)] * 2


def test_chain_catches_toxic_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    p = {r.doc_id: r.p_toxic for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()}
    held = [(p[r.doc_id] >= 0.5, r.toxic) for r in labels.collect() if crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([x for x, y in held if y]) > 0.85 and np.mean([x for x, y in held if not y]) < 0.01


def test_scores_are_those_of_the_formula(spark):
    """score_toxicity() against a plain restatement of the chain, on texts with nulls, clashing columns and repeated rows."""
    r = random.Random(9)
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}word" for i in range(40)] + ["badness", "badly", "awful"]
    rows = [(i, " ".join(r.choice(words[:40] if i % 3 else words) for _ in range(12)), "clash") for i in range(200)]
    rows += [(None, None, "a"), (7, "", None), (8, "badly " * 50_000, "b"), (8, "badly " * 50_000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p_toxic string")
    labels = spark.createDataFrame([(i, int("bad" in t or "awful" in t)) for i, t, _ in rows[:200]], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels, chi2=5.0)

    def plain(text):
        held = {model.features[f] for f in toxicity.text_features(toxicity.text_words(text)) if f in model.features}
        held |= {model.features[toxicity.ANY]} if held else set()
        p = []
        for w in model.weights:
            z = sum(w[j] for j in held) + sum(a * b for a, b in zip(w[len(model.features) :], p)) + w[-1]
            p.append(1 / (1 + np.exp(-z)))
        return p

    got = toxicity.score_toxicity(docs, model).collect()
    assert sorted(str(x.doc_id) for x in got) == sorted(str(i) for i, *_ in rows)
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append([x.p_explicit, x.p_coded, x.p_toxic])
    for i, t, _ in rows:
        assert any(np.allclose(plain(t), p) for p in by[i])
    assert len(model.features) > 1
    kept = toxicity.reject_toxic(docs, labels, chi2=5.0)
    assert kept.columns == docs.columns and kept.filter("p_toxic = 'clash'").count() > 50


def test_explicit_rows_hold_the_most_telling_features():
    features = [np.array(f, np.int32) for f in ([1, 5], [1, 6], [1, 7], [2, 5], [2, 6], [2, 7], [3, 5], [5], [6], [7], [5, 6], [6, 7])]
    toxic = np.array([1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0])
    assert toxicity.explicit_rows(features, toxic, 0.4).tolist() == [1, 1, 1] + [0] * 9
    assert toxicity.explicit_rows(features, toxic, 0.8).tolist() == [1] * 6 + [0] * 6
    assert not toxicity.explicit_rows(features, toxic * 0).any() and not toxicity.explicit_rows([], toxic[:0]).any()


def test_chain_learns_from_out_of_fold_probabilities():
    rng = np.random.default_rng(2)
    first, noise = rng.integers(0, 2, 600), rng.integers(0, 2, (600, 3))
    second = first  # told by the first category alone: its own words are noise
    features = [np.array([7] * a + [20 + j for j in np.flatnonzero(b)], np.int64) for a, b in zip(first, noise, strict=True)]
    model = toxicity.fit_chain(features, np.stack([first, second], axis=1), ("one", "two"), chi2=1e9)
    assert model.features == {toxicity.ANY: 0} and len(model.weights[1]) == 3
    model = toxicity.fit_chain(features, np.stack([first, second], axis=1), ("one", "two"))
    assert list(model.features) == [7, toxicity.ANY] and model.weights[1][2] > 0.5


def test_segmentations_are_summed():
    vocabulary = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4}
    rng = np.random.default_rng(3)
    p = np.vstack([rng.random((6, 2)), np.zeros((1, 2))])
    model = piece_language.LanguageModel(["x", "y"], p, vocabulary)

    def total(word, k):
        if not word:
            return 1.0
        return sum((p[vocabulary[word[:j]], k] if word[:j] in vocabulary else p[5, k] if j == 1 else 0.0) * total(word[j:], k) for j in range(1, len(word) + 1))

    words = ["▁ab", "▁aab", "▁bcab", "▁a"]
    assert np.allclose(np.exp(model.word_scores(words)), [[total(w, k) for k in (0, 1)] for w in words])


def test_expectation_raises_the_likelihood():
    counts = [Counter({"▁abab": 5, "▁ab": 3}), Counter({"▁baba": 4})]
    vocabulary = {"▁": 0, "a": 1, "b": 2, "ab": 3, "ba": 4}
    scores = []
    for rounds in (1, 2, 4):
        model = piece_language.fit_languages(counts, ["x", "y"], vocabulary, rounds=rounds, smoothing=1e-9)
        scores.append(sum(n * model.word_scores([w])[0, k] for k, c in enumerate(counts) for w, n in c.items()))
    assert scores == sorted(scores)


VECTORS = "vec_id long, embedding array<float>, label int"


def test_block_search_against_brute_force(spark):
    r = random.Random(6)
    rows = [(i, [r.choice([-1.0, 0.5, 2.0]) for _ in range(6)], 1) for i in range(300)]
    rows += [(i, rows[0][1], 1) for i in range(300, 320)] + [rows[100], rows[100]]
    bad = [(400, None, 1), (500, [0.0] * 6, 1), (600, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (700, [float("nan")] * 6, 1), (800, [float("inf")] * 6, 1), (None, [1.0] * 6, 1), (900, [], 1)]
    odd = [(1000, [1.0, 2.0], 1), (1001, [1.0, 3.0], 1)]
    table = spark.createDataFrame(rows + bad + odd, VECTORS)
    got = {}
    for x in block_search(table, table.filter("vec_id % 100 = 0"), group_rows=40, query_rows=2).collect():
        got.setdefault(x.query_id, {})[x["rank"]] = (x.score, x.vec_id)
    good, want = rows + odd, {}
    for q in {(i, tuple(v)) for i, v, _ in good if i % 100 == 0}:
        near, own = [], False
        for i, v, _ in good:
            if (i, tuple(v)) == q and not own:
                own = True
            elif len(v) == len(q[1]):
                near.append((float(np.sqrt(((np.array(v, float) - np.array(q[1], float)) ** 2).sum())), i))
        want[q[0]] = dict(enumerate(sorted(near)[:10], 1))
    assert got.keys() == want.keys() and got[1000] == {1: (1.0, 1001)}
    for q in want:
        assert [i for _, (_, i) in sorted(got[q].items())] == [i for _, (_, i) in sorted(want[q].items())]
        assert np.allclose([s for _, (s, _) in sorted(got[q].items())], [s for _, (s, _) in sorted(want[q].items())])
    assert block_search(table.limit(0), table.limit(0)).count() == 0
    assert block_search(spark.createDataFrame(rows[:1], VECTORS), spark.createDataFrame(rows[:1], VECTORS)).count() == 0


def test_bounds_never_exclude_a_neighbour():
    rng = np.random.default_rng(7)
    for scale in (1e-6, 1.0, 1e6):
        points, queries = rng.normal(size=(500, 16)) * scale, rng.normal(size=(20, 16)) * scale
        points[:50] += 1000 * scale
        got = search_tile(queries, points, np.arange(500), 5)
        for i, q in enumerate(queries):
            assert [x for j, x, _ in got if j == i] == list(np.argsort(((points - q) ** 2).sum(axis=1), kind="stable")[:5])


def test_search_loses_no_row_to_large_or_tiny_numbers(spark):
    rows = [(i, [float(i), 1.0, 2.0]) for i in range(1, 30)] + [(100, [1e200, 0.0, 0.0]), (200, [1.0, 1.0, 1.0]), (300, [1e-200, 0.0, 0.0]), (301, [3e-200, 0.0, 0.0]), (400, [1.7e308, 1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for x in block_search(table, table.filter("vec_id % 100 = 0")).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    assert {q: len(v) for q, v in got.items()} == {100: 10, 200: 10, 300: 10, 400: 10}
    near = sorted(got[300])
    assert near[0][1] == 301 and near[0][2] == pytest.approx(2e-200)
    assert all(s == pytest.approx(1e200) for _, _, s in got[100])
    few = block_search(spark.createDataFrame(rows[:3] + rows[29:30], "vec_id long, embedding array<double>"), table.filter("vec_id = 200")).collect()
    assert len(few) == 4


def test_audio_of_other_makers():
    frame = bytes([0xFF, 0xFB, 0x90, 0x00]).ljust(417, b"\0")
    lame = b"LAME3.100".ljust(21, b"\0") + (576 << 12 | 1000).to_bytes(3, "big")
    xing = (frame[:36] + b"Xing" + (15).to_bytes(4, "big") + (4).to_bytes(4, "big") + (5 * 417).to_bytes(4, "big") + bytes(range(100)) + bytes(4) + lame).ljust(417, b"\0")
    info = mpeg_audio.parse_audio(xing + frame * 4)
    assert info.table[:2] == (4, 5 * 417) and (info.delay, info.padding) == (576, 1000) and info.duration == pytest.approx((4 * 1152 - 1576) / 44100)
    vbri = (frame[:36] + b"VBRI" + bytes.fromhex("0001" "0100" "004b") + (2085).to_bytes(4, "big") + (4).to_bytes(4, "big") + bytes.fromhex("0004" "0001" "0002" "0001") + bytes(range(8))).ljust(417, b"\0")
    info = mpeg_audio.parse_audio(vbri + frame * 4)
    assert info.table == (4, 2085, bytes(range(8))) and info.delay == 256 and len(info.offsets) == 4
    closing = (b"TAG" + b"A title".ljust(30, b"\0") + b"Someone".ljust(30, b"\0")).ljust(128, b"\0")
    old = b"ID3\x02\0\0" + bytes([0, 0, 0, 13]) + b"TT2" + (7).to_bytes(3, "big") + b"\0Naming"
    info = mpeg_audio.parse_audio(old + frame * 3 + closing)
    assert info.tags == {"TT2": "Naming", "title": "A title", "artist": "Someone"} and len(info.offsets) == 3 and not info.skipped
    info = mpeg_audio.parse_audio(frame * 3 + frame[:200])
    assert len(info.offsets) == 3 and info.cut == 200 and not info.skipped
    other = bytes([0xFF, 0xF3, 0x80, 0xC0])  # another version's header is no frame of this stream
    assert mpeg_audio.parse_audio(frame * 2 + b"xx" + other + frame * 2).skipped == 6
    head = bytes([0xFF, 0xFE, 0x10, 0xC0])  # layer I, 32 kbit/s, one channel, with a checksum
    body = bytes(range(16))
    size = mpeg_audio.parse_header(head).length
    one = (head + mpeg_audio.crc16(head[2:] + body).to_bytes(2, "big") + body).ljust(size, b"\0")
    assert (mpeg_audio.parse_audio(one * 3).checked, mpeg_audio.parse_audio(one * 3).damaged) == (3, 0)
    broken = bytearray(one * 3)
    broken[size + 8] ^= 1
    assert mpeg_audio.parse_audio(bytes(broken)).damaged == 1


def test_digests_of_null_and_foreign_streams(spark):
    frame = bytes([0xFF, 0xFB, 0x90, 0x00]).ljust(417, b"\0")
    rows = mpeg_audio.audio_digests(spark.createDataFrame([(1, None), (None, b""), (2, frame * 2), (3, b"noise")], "doc_id long, media binary")).collect()
    assert [r.n_bytes for r in rows] == [None] * 4 and [r.media_bytes for r in rows] == [0, 0, 834, 5]
    mixed = spark.createDataFrame([(1, "x", b"old")], "doc_id long, text string, media binary")
    assert mpeg_audio.audio_digests(mpeg_audio.texts_to_audio(mixed)).first().n_bytes == 1


def test_audio_round_trip_and_damage(spark, docs):
    for raw in [b"", b"a", b"b" * 192, b"c" * 193, bytes(range(256)) * 50, b"\xff\xfa\x64\xc0" * 3000]:
        media = mpeg_audio.write_audio(raw)
        info = mpeg_audio.parse_audio(media)
        payload = mpeg_audio.audio_payload(media, info)
        assert payload[: len(raw)] == raw and set(payload[len(raw) :]) <= {32} and payload and len(payload) % 192 == 0
        assert int(info.tags["bytes"]) == len(raw) and not info.damaged and not info.skipped
        frames, size, points = info.table
        start = len(media) - size
        assert frames == len(info.offsets) and media[start : start + 2] == b"\xff\xfb" and len(points) == 100
        assert info.samples == 1152 * frames and info.duration == pytest.approx(frames * 0.024)
    media = mpeg_audio.write_audio(b"x" * 10_000)
    info = mpeg_audio.parse_audio(media)
    cut = info.offsets[3]
    hurt = mpeg_audio.parse_audio(media[:cut] + b"junk\xff\xfbjunk" + media[cut:])
    assert hurt.skipped > 0 and hurt.offsets[-1] == info.offsets[-1] + 10
    flipped = bytearray(media)
    flipped[info.offsets[2] + 8] ^= 1
    assert mpeg_audio.parse_audio(bytes(flipped)).damaged == 1
    assert mpeg_audio.parse_audio(b"").samples == mpeg_audio.parse_audio(b"no frames here \xff").samples == 0
    assert mpeg_audio.parse_audio(media + b"TAG" + bytes(125)).samples == info.samples
    rows = mpeg_audio.audio_digests(mpeg_audio.texts_to_audio(docs)).collect()
    want = Counter()
    for d in docs.collect():
        raw = (d.text or "").encode()
        full = raw + b" " * (-len(raw) % 192 if raw else 192)
        want[d.doc_id, len(raw), len(full), sha256(full).hexdigest(), crc32(full[-16:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    probed = mpeg_audio.probe_audio(spark.createDataFrame([(1, None), (2, media)], "doc_id long, media binary")).orderBy("doc_id").collect()
    assert probed[0].frames == 0 and probed[1].offsets == info.offsets and probed[1].tags == info.tags


def test_headers_of_known_streams():
    head = mpeg_audio.parse_header(bytes([0xFF, 0xFB, 0x90, 0x00]))  # the usual 128 kbit/s, 44.1 kHz frame
    assert (head.length, head.samples, head.channels, head.side, head.protected) == (417, 1152, 2, 32, False)
    assert mpeg_audio.parse_header(bytes([0xFF, 0xF3, 0x80, 0xC0])).samples == 576
    assert [mpeg_audio.parse_header(bytes(x)) for x in ([0xFF, 0xFB, 0xF0, 0], [0xFF, 0xEB, 0x90, 0], [0, 0, 0, 0], [0xFF])] == [None] * 4


PAGES = "page_id long, url string, html string"


def test_archives_and_index(spark):
    rows = [(i, f"http://site{i % 3}.example.org/p{i % 7}?q={i % 2}", f"<p>{i % 5}</p>" * (1 + i % 4)) for i in range(60)]
    rows += [(100, None, None), (101, "", ""), (102, "http://[bad", "é" * 50_000), (103, "no scheme", "x"), (-5, "http://A.B/ c", "x"), (None, "http://n/", "only"), (None, "http://n/", "only")]
    pages = spark.createDataFrame(rows, PAGES)
    folder = write_archives(pages, archive_bytes=2000)
    index = build_index(spark, folder, block_lines=4, part_lines=10)
    got = Counter(tuple(r) for r in read_ranges(spark, folder, look_up(pages, index)).drop("url").collect())
    largest = {}
    for p, _, h in rows:
        if p is not None:
            largest[h or ""] = max(p, largest.get(h or "", p))
    want = Counter()
    for p, _, h in rows:
        raw, keeper = (h or "").encode(), largest.get(h or "")
        own = p == keeper
        want[p, len(raw), b32encode(sha1(raw).digest()).decode(), "response" if own else "revisit", None if own else keeper] += 1
    assert got == want
    site = CaptureIndex(spark, index)
    url = "http://site1.example.org/p1?q=1"
    assert sorted(r.page_id for r in site.captures(url)) == sorted(p for p, u, _ in rows if u == url)
    assert site.captures("http://nowhere.example/") == []
    assert url_key("https://WWW.Example.com:8080/a?b=c") == "com,example,www:8080)/a?b=c"
    assert Counter(tuple(r) for r in read_ranges(spark, folder, look_up(pages, index), direct=False).drop("url").collect()) == want
    empty = pages.limit(0)
    folder = write_archives(empty)
    assert read_ranges(spark, folder, look_up(empty, build_index(spark, folder))).count() == 0


def test_damaged_archives_lose_the_damaged_records_only(spark, tmp_path):
    from tidewright.llm.warc import members, record_bytes

    parts = [record_bytes(i, f"http://a.example/{i}", b"x" * 50 * i, None) for i in range(6)]
    at = len(parts[0]) + len(parts[1])
    whole = bytearray(b"".join(parts))
    whole[at + 14] ^= 255
    whole[at + 15] ^= 255
    data = bytes(whole[:-7])  # and the last one is cut off
    assert [o for o, _, _ in members(data)] == [sum(map(len, parts[:i])) for i in (0, 1, 3, 4)]
    (tmp_path / "part-0.txt").write_bytes(data)
    index = build_index(spark, str(tmp_path), block_lines=2, part_lines=2)
    asked = spark.createDataFrame([(i, f"http://a.example/{i}", "") for i in range(6)], PAGES)
    assert sorted(r.page_id for r in read_ranges(spark, str(tmp_path), look_up(asked, index)).collect()) == [0, 1, 3, 4]


def test_captures_of_one_key_are_split_over_parts(spark):
    pages = spark.createDataFrame([(None, "http://one.example/", f"t{i}") for i in range(60)] + [(5, None, "x")], PAGES)
    folder = write_archives(pages, archive_bytes=3000)
    index = build_index(spark, folder, block_lines=4, part_lines=10)
    assert spark.read.parquet(f"{index}/blocks").select("part").distinct().count() > 3
    found = read_ranges(spark, folder, look_up(pages, index)).collect()
    assert Counter(r.page_id for r in found) == {None: 60, 5: 1}


def test_bounded_sample_is_stable_and_bounded(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    first = {r[0] for r in bounded_sample(df, 500).collect()}
    assert first == {r[0] for r in bounded_sample(df.repartition(5), 500).collect()} and 350 < len(first) < 650
    assert bounded_sample(df, 9000).count() == 5000


def test_pipeline_stages_hold_what_they_promise(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(stage(spark, seen[-1], sf).cache())
        assert seen[-1].columns == columns
    ids = [Counter(r.doc_id for r in df.select("doc_id").collect()) for df in seen]
    assert ids[1] <= ids[0] and ids[2] == ids[1] and ids[3] <= ids[2] and set(ids[4]) <= set(ids[3])
    final = corpus_pipeline.run(spark, sf).collect()
    texts = {(r.doc_id, sha256(r.text.encode()).hexdigest()) for r in seen[4].collect()}
    assert Counter(r.doc_id for r in final) == ids[4] and {(r.doc_id, r.decoded_sha256) for r in final} == texts
    library = PieceModel(MODEL)
    assert Counter(r.n_tokens for r in final) == Counter(len(library.encode(r.text)) for r in seen[4].collect())
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_only_copies_with_the_same_label_leave_the_toxicity_sample():
    from tidewright.llm.toxicity import without_copies

    a = np.arange(20, dtype=np.int32)
    other = np.concatenate([a[:4], np.arange(100, 116, dtype=np.int32)])  # the same smallest features, another text
    near = np.concatenate([a[:18], np.array([50, 51], np.int32)])
    none = np.empty(0, np.int32)
    rows = [(a, (0, 0)), (other, (0, 0)), (near, (0, 0)), (a, (1, 0)), (a, (1, 0)), (none, (0, 0)), (none, (0, 0))]
    assert without_copies([f for f, _ in rows], [y for _, y in rows]) == [0, 1, 3, 5]


def test_products_of_codes_are_exact():
    from tidewright.llm.block_search import _product

    a = np.array(list(product([-127, 127], repeat=3)), np.int8).repeat(600, axis=1)
    assert (_product(a, a) == a.astype(np.int64) @ a.astype(np.int64).T).all()
