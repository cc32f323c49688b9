"""The audits of sources and of filters, against plain restatements on messy tables."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import pytest

from tidewright.llm import source_audit as audit
from tidewright.llm.filter_audit import filter_audit, flag_counts
from tidewright.llm.source_audit import source_audit

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, part string"


def messy() -> list[tuple]:
    rng = random.Random(11)
    rows = []
    words = ["Alpha", "beta", "GAMMA", "été", "Ünder", "zeta9eta", "x", "1", "don't", "日本語", "a#b", "naïve\x7fend"]
    for i in range(150):
        k = rng.choice([0, 3, 30, 110, 160])
        text = rng.choice([" ", "\n", "\t"]).join(rng.choice(words) if rng.random() < 0.5 else f"w{rng.randrange(400)}" for _ in range(k))
        rows.append((i, text, rng.choice(["en", "en", "fr", None]), rng.choice(["s1", "s2", "s3", None, ""]), 7, "clash", "clash"))
    rows += [rows[5], rows[5], rows[70]]  # repeated rows
    rows += [(500 + i, rows[20][1], rng.choice(["en", "fr"]), "s1", 7, "clash", "clash") for i in range(6)]  # copies
    rows += [(None, rows[20][1], "en", "s1", None, None, None), (None, None, None, None, None, None, None), (None, None, "en", "s9", None, None, None)]
    rows += [(-4, rows[20][1], "fr", "s2", 1, None, None), (-4, rows[20][1], "en", "s2", 1, None, None), (900, "", "de", "only", 1, None, None)]
    rows += [(901, "UPPER " * 20000, "en", "s3", 1, None, None)]
    return rows


def brute_sources(rows: list[tuple], least: int, top: int) -> Counter:
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for _, text, lang, source, *_ in rows]
    held, counts, groups = Counter(), Counter(), sorted({(a, b) for a, b, _ in docs})
    for lang, source, terms in docs:
        held.update({(lang, t) for t in terms})
        counts.update((lang, source, t) for t in terms)
        counts.update((lang, None, t) for t in terms)
    out = Counter()
    for lang in {a for a, _ in groups}:
        kept = sorted((t for a, t in held if a == lang and held[a, t] >= least), key=lambda t: t.encode())
        p = {}
        for source in [s for a, s in groups if a == lang] + [None]:
            n = sum(counts[lang, source, t] for t in kept)
            p[source] = {t: 1 + 10**9 * (counts[lang, source, t] + 5) // (n + 5 * len(kept)) for t in kept}
        for source in [s for a, s in groups if a == lang]:
            pairs = [(-sum(abs(p[source][t] - p[o][t]) for t in kept), o.encode(), o) for o in p if o is not None and o != source]
            terms = [(p[None][t] - p[source][t], t.encode(), t) for t in kept if counts[lang, source, t] and p[source][t] > p[None][t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out.update((lang, source, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1))
    return out


@pytest.mark.parametrize(("tile", "held"), [(audit.TILE, 200_000), ((2, 5), 3)])
def test_sources_against_brute_force(spark, tile, held, monkeypatch):
    counts = audit.term_counts  # with small tiles a source meets others of its own block and of later ones
    monkeypatch.setattr(audit, "term_counts", lambda docs: counts(docs, held))
    rows = messy()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for least, top in ((30, 50), (2, 3), (10**6, 50)):
        got = Counter(map(tuple, source_audit(docs, least, top, tile).collect()))
        assert got == brute_sources(rows, least, top)


def brute_filters(rows: list[tuple], labels: list[tuple]) -> Counter:
    label = lambda d, i: any(x[0] == d and x[i] == 1 for x in labels if d is not None)
    docs = []
    for d, text, lang, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": d is not None and any(o is not None and o < d and (u or "") == t for o, u, *_ in rows),
        }
        docs.append((lang or "", {f for f in fails if fails[f]}, label(d, 1), label(d, 2)))
    out = Counter()
    for part in {x[0] for x in docs}:
        own, steps = [x for x in docs if x[0] == part], []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                failing = sum(f in x[1] for x in own)
                steps.append((part, order, step, len(left), len(gone), failing - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)))
        total = Counter()
        for s in steps:
            total[s[1][s[2] - 1]] += s[4]
        out.update((*s, total[s[1][s[2] - 1]]) for s in steps)
    return out


def test_filters_against_brute_force(spark):
    rng = random.Random(3)
    rows = messy()
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(-5, 600, 2)] + [(6, 1, 0), (6, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("n", "good").repartition(3)
    found = filter_audit(flag_counts(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS part")))
    got = found.filter("part is not null").collect()
    assert Counter(map(tuple, got)) == brute_filters(rows, labels)
    whole = brute_filters([(*r[:2], "all", *r[3:]) for r in rows], labels)
    assert Counter(("all", *r[1:]) for r in map(tuple, found.filter("part is null").collect())) == whole


def test_audits_of_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert source_audit(none).count() == 0
    assert filter_audit(flag_counts(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0
