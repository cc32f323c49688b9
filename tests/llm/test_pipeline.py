"""The whole pipeline against a brute-force version that uses none of its stages, on rows with nulls, copies, ties and shared lines."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from hashlib import md5, sha256

import pytest

import corpus_pipeline
from tidewright.llm import toxicity
from tidewright.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SHARED = "This line is shared by a number of documents"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def fixture():
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefghinorst") for _ in range(r.randint(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(1, 90):
        said = [r.choice(vocabulary) for _ in range(r.choice([30, 80, 200]))]
        if i % 6 == 0:
            said[3:5] = ["zvilebad", "grotnasty"]
        text = " ".join(said[: len(said) // 2]) + "\n" + " ".join(said[len(said) // 2 :])
        if i % 4 == 0:
            text += f"\n  {SHARED}  "
        rows.append((i, text, "en", "abc"[i % 3], len(text)))
        labels.append((i, int(i % 6 == 0)))
    for i in (7, 20, 43):  # a near copy and two exact ones of each
        base = rows[i][1].split(" ")
        base[1] = "altered"
        rows += [(200 + i, " ".join(base), "en", "b", 1), (300 + i, rows[i][1], "en", "c", 1), (300 + i, rows[i][1], "en", "c", 1)]
    rows += [(400, None, None, None, None), (401, "", "en", "a", 0), (None, "no id " * 20, "en", None, 1), (None, "no id " * 20, "en", None, 1), (402, "short text", "de", "d", 1), (402, "short text", "de", "d", 1)]
    return rows, labels


def without_lines(rows):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(d)
    out = []
    for d, text, lang, source, _ in rows:
        kept = [x for x in (text or "").split("\n") if len(holders.get(key(x), ())) < 3 or d == max((h for h in holders[key(x)] if h is not None), default=None) and d is not None]
        out.append((d, "\n".join(kept), lang, source, len("\n".join(kept))))
    return out


def one_of_each(rows):
    def shingles(text):
        w = words(lower(text or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t, *_ in rows]
    left, out = set(range(len(rows))), []
    while left:
        group, stack = [], [min(left)]
        left.discard(stack[0])
        while stack:
            x = stack.pop()
            group.append(x)
            near = {y for y in left if sets[x] == sets[y] or 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])}
            left -= near
            stack += near
        ids = [rows[x][0] for x in group if rows[x][0] is not None]
        out += [next(rows[x] for x in group if rows[x][0] == min(ids))] if ids else [rows[x] for x in group]
    return out


def mixed(rows):
    sizes = Counter()
    for _, t, _, source, _ in rows:
        sizes[source] += len(words(t))
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight, total, stopped = {s: i % 3 + 1 for i, s in enumerate(order)}, sum(sizes.values()), set()
    while True:
        level = (total - sum(3 * sizes[s] for s in stopped)) / max(sum(w for s, w in weight.items() if s not in stopped), 1e-9)
        more = {s for s in order if s not in stopped and level * weight[s] > 3 * sizes[s]}
        if not more:
            break
        stopped |= more
    taken = Counter()
    for s in order:
        goal, start = int((3 * sizes[s] if s in stopped else level * weight[s]) + 1e-9), 0
        name = lambda row: md5(f"{'' if row[0] is None else row[0]}/{md5((row[1] or '').encode()).hexdigest()}".encode()).hexdigest()
        for row in sorted((x for x in rows if x[3] == s), key=name):
            n = len(words(row[1]))
            if n:
                taken[row[0], row[3], row[1]] += n * (goal // sizes[s]) + max(0, min(start + n, goal % sizes[s]) - start)
            start += n
    out = []
    for (d, source, text), t in taken.items():
        w = words(text)
        out += [(d, source, text)] * (t // len(w)) + ([(d, source, " ".join(w[: t % len(w)]))] if t % len(w) else [])
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    import sentencepiece

    rows, labels = fixture()
    sf = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet"))

    def toxic(text):
        held = {model.features[f] for f in toxicity.text_features(toxicity.text_words(text)) if f in model.features}
        held |= {model.features[toxicity.ANY]} if held else set()
        p = []
        for w in model.weights:
            z = sum(w[j] for j in held) + sum(a * b for a, b in zip(w[len(model.features) :], p)) + w[-1]
            p.append(1 / (1 + pow(2.718281828459045, -z)))
        return p[-1] >= 0.5

    clean = [x for x in rows if not toxic(x[1])]
    assert {x[0] for x in rows} - {x[0] for x in clean} == {x[0] for x in rows if "zvilebad" in (x[1] or "")}
    last = mixed(one_of_each(without_lines(clean)))
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    want = Counter()
    for d, source, text in last:
        ids = library.encode(text)
        want[d, source, tuple(ids), sha256(library.decode(ids).encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.source, tuple(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect())
    assert len(want) > 50 and got == want


@pytest.mark.parametrize("name", ["_lost", "_rows", "row", "node"])
def test_stages_keep_columns_of_any_name(spark, tmp_path, name):
    rows, labels = fixture()
    sf = str(tmp_path)
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.createDataFrame([(*x, f"own {x[0]}") for x in rows], f"{SCHEMA}, {name} string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, sf)
        assert found.columns == docs.columns
        assert all(r[name] == f"own {r.doc_id}" for r in found.collect())
