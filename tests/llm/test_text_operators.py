"""Operators over documents, on messy tables: nulls, empty and very long texts, ties, repeated rows, clashing columns, no rows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm.line_dedup import line_dedup
from tidewright.llm.mixing import mix, mixed_documents, source_targets
from tidewright.llm import simhash
from tidewright.llm.simhash import components, fingerprint, fingerprint_links, keep_one, near_duplicates, plan_partitions

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SHARED = "This line is shared by very many documents"


def messy() -> list[tuple]:
    long = "\n".join(f"line number {i} of the long text" for i in range(3000)) + "\n" + SHARED
    rows = [
        (1, SHARED + "\nown", "en", "a", 1),
        (2, f"  {SHARED.upper()}\t\nÉtoile", "fr", "b", 1),
        (3, f"{SHARED}\r\n{SHARED}\nx", "en", "a", 1),
        (4, None, None, None, None),
        (5, "", "en", "a", 0),
        (6, "short\nshort", "en", "c", 1),
        (7, long, "en", "a", 1),
        (7, long, "en", "a", 1),
        (8, "a\n\nb\n", "de", "b", 1),
        (None, SHARED + "\nno id", "en", None, 1),
        (None, SHARED + "\nno id", "en", None, 1),
        (-9, "short", "en", "c", 1),
    ]
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "éta", "zeta"]
    return rows + [(100 + i, " ".join(r.choice(words) for _ in range(r.randint(0, 40))), "en", r.choice(["a", "b", "z"]), 1) for i in range(60)]


def key_of(line: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute_lines(rows: list[tuple]) -> Counter:
    holders = defaultdict(set)
    for d, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= 20:
                holders[key_of(line)].add(d)
    out = Counter()
    for d, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            have = holders.get(key_of(line), set())
            ids = [x for x in have if x is not None]
            if not (len(have) >= 3 and d != (max(ids) if ids else None)):
                kept.append(line)
        out[d, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def test_line_dedup_against_brute_force(spark):
    rows = messy()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n_lines", F.lit("clash"))
    got = Counter(tuple(r) for r in line_dedup(docs).select("doc_id", "n_lines", "n_dropped", "kept_text").collect())
    assert got == brute_lines(rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert line_dedup(none).count() == 0
    assert near_duplicates(none).count() == 0
    assert keep_one(none).count() == 0
    decided, slots = mix(none)
    assert decided.count() == 0 and slots.count() == 0
    assert mixed_documents(none).count() == 0


def test_columns_of_any_name_pass_through(spark):
    """Names that an operator uses inside must neither crash nor be lost or overwritten."""
    clash = ["_lost", "_a", "_split", "_id", "_rows", "_key", "_taken", "_k", "_0_", "_1_", "_2_", "row", "start", "size", "_sid"]
    rows = [(i, f"{SHARED}\nown {i} words of a text number {i}", "en", "a", 1) for i in range(5)] + [(None, None, None, None, None), (1, f"{SHARED}\nown 1 words of a text number 1", "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.concat(F.lit(c), F.coalesce("doc_id", F.lit(-1)).cast("string")) for c in clash})
    for found in (line_dedup(docs), keep_one(docs), mixed_documents(docs)):
        assert set(docs.columns) <= set(found.columns)
        got = found.collect()
        assert got and all(r[c] == f"{c}{-1 if r.doc_id is None else r.doc_id}" for r in got for c in clash)
    assert keep_one(docs).columns == mixed_documents(docs).columns == docs.columns


def test_mix_does_not_depend_on_the_order_of_rows(spark):
    rows = [(1, "a b c", "en", "s", 1), (1, "d e f", "en", "s", 1), (None, "g h i", "en", "s", 1), (None, "j k l", "en", "s", 1), (None, "j k l", "en", "s", 1), (2, "m n", "en", "t", 1)]
    seen = set()
    for shift in range(3):
        docs = spark.createDataFrame(rows[shift:] + rows[:shift], SCHEMA).repartition(shift + 1)
        seen.add(str(sorted(map(str, mixed_documents(docs, block=4).collect()))))
    assert len(seen) == 1


def test_mixed_documents_come_in_slot_order(spark):
    rows = [(i, "w " * 40, "en", f"s{i % 3}", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    decided, _ = mix(docs, block=64)
    slot = {r.doc_id: r.first_slot for r in decided.collect()}
    order = [slot[r.doc_id] for r in mixed_documents(docs, block=64).collect()]
    assert order == sorted(order) and len(set(order)) > 50


def test_mix_places_many_copies_of_one_row(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 1)] * 50 + [(2, "c", "en", "t", 1)], SCHEMA)
    from tidewright.llm.mixing import word_streams

    placed, _ = word_streams(docs, run=8)
    assert sorted(r.start for r in placed.filter("doc_id = 1").collect()) == list(range(0, 100, 2))
    assert mix(docs)[0].count() == 51


def size_of(text: str | None) -> int:
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix_meets_its_targets(spark):
    rows = messy()
    decided, slots = mix(spark.createDataFrame(rows, SCHEMA), block=16)
    got = decided.collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, size_of(t)) for d, t, *_ in rows)
    sizes = Counter()
    for _, t, _, source, _ in rows:
        sizes[source] += size_of(t)
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        level = (total - sum(3 * sizes[s] for s in stopped)) / max(sum(w for s, w in weight.items() if s not in stopped), 1e-9)
        more = {s for s in order if s not in stopped and level * weight[s] > 3 * sizes[s]}
        if not more:
            break
        stopped |= more
    target = {s: 3 * sizes[s] if s in stopped else level * weight[s] for s in order}
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == int(target[s] + 1e-9) for s in order)
    seen = slots.orderBy("slot").collect()
    assert len({r.slot for r in seen}) == len(seen)
    by = defaultdict(list)
    for r in seen:
        by[r["_sid"]].append(r.k)
    assert all(ks == list(range(len(ks))) for ks in by.values())
    again, _ = mix(spark.createDataFrame(rows, SCHEMA).repartition(7), block=16)
    assert Counter(map(tuple, again.drop("first_slot").collect())) == Counter(map(tuple, decided.drop("first_slot").collect()))


def test_schedule_prefixes_stay_near_the_shares(spark):
    rows = [(i, "w " * 50, "en", f"s{i % 3}", 1) for i in range(300)]
    _, slots = mix(spark.createDataFrame(rows, SCHEMA), block=10)
    order = [r["_sid"] for r in slots.orderBy("slot").collect()]
    whole = Counter(order)
    for n in range(50, len(order), 97):
        part = Counter(order[:n])
        assert all(abs(part[s] - n * whole[s] / len(order)) < 8 for s in whole)


def test_mixed_documents_repeat_as_taken(spark):
    rows = messy()
    docs = spark.createDataFrame(rows, SCHEMA)
    decided, _ = mix(docs)
    want = Counter()
    for r in decided.collect():
        want[r.doc_id] += r.taken
    got = Counter()
    for r in mixed_documents(docs).collect():
        got[r.doc_id] += size_of(r.text)
    assert +got == +want


def test_all_targets_stop(spark):
    out = source_targets(spark.createDataFrame([("a", 0), (None, 0)], "source string, source_size long")).collect()
    assert [r.target for r in out] == [0.0, 0.0]


def brute_components(fps: dict[int, int | None], distance: int) -> dict[int, set[int]]:
    left, groups = set(fps), {}
    while left:
        stack, seen = [left.pop()], set()
        while stack:
            x = stack.pop()
            seen.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= distance}
            left -= near
            stack += near
        groups |= {x: seen for x in seen}
    return groups


def test_near_duplicates_against_brute_force(spark):
    rows = messy()
    base = " ".join(f"word{i}" for i in range(400))
    rows += [(1000 + i, base.replace(f"word{i * 7} ", "changed "), "en", "a", 1) for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA)
    own = [(d, fingerprint(t)) for d, t, *_ in rows]
    groups = brute_components({f: None for _, f in own}, 4)
    names = {f: min((d for d, g in own if g in groups[f] and d is not None), default=None) for _, f in own}
    got = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in near_duplicates(docs).collect())
    assert got == Counter((d, f, names[f]) for d, f in own)
    kept = keep_one(docs).collect()
    # a group without any doc_id keeps its rows: here the two that repeat each other
    assert Counter(r.doc_id for r in kept) == Counter({n: 2 if n is None else 1 for n in names.values()})


def test_near_copies_against_brute_force(spark):
    import corpus_pipeline

    rng = random.Random(5)
    rows = messy() + [(1000, "a b c d", "en", "a", 1), (1001, "A  b\nc D", "en", "a", 1), (1002, "a b c e", "en", "a", 1)]
    for base in range(12):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.choice([40, 200, 600]))]
        for k in range(8):
            edited = list(words)
            for i in rng.sample(range(len(words)), k * len(words) // 200):
                edited[i] = f"x{rng.randrange(60)}"
            rows.append((2000 + 10 * base + k, " ".join(edited), "en", "a", 1))

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])

    docs = spark.createDataFrame(rows, SCHEMA)
    got = near_duplicates(docs, distance=14, width=5, words=2, alike=True).collect()
    groups = defaultdict(list)
    sets = defaultdict(list)
    for d, t, *_ in rows:
        sets[d].append(shingles(t))
    for r in got:
        groups[r.component_id].append(r.doc_id)
    assert Counter(r.doc_id for r in got) == Counter(d for d, *_ in rows)
    alike = lambda x, y: 5 * len(x & y) >= 4 * len(x | y)
    for name, members in groups.items():  # every group hangs together by links of the stated similarity
        left, stack = {s for d in members for s in sets[d]}, [sets[name][0]]
        while stack:
            x = stack.pop()
            found = {y for y in left if alike(x, y)}
            left -= found
            stack += found
        assert not left
    of = {r.doc_id: r.component_id for r in got}
    pairs = [(a, b) for a in sets for b in sets if a is not None and b is not None and a < b and any(alike(x, y) for x in sets[a] for y in sets[b])]
    assert np.mean([of[a] == of[b] for a, b in pairs]) > 0.95
    kept = Counter(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert kept == Counter({n: sum(m is None for m in members) if n is None else 1 for n, members in groups.items()})


def test_dense_groups_of_near_copies_keep_every_link(spark):
    """Groups in which half of the texts are 0.94 alike and the others fail with these: components must be those of all pairs."""
    rng = random.Random(8)
    rows = []
    for group in range(6):
        base = [f"g{group}w{i}" for i in range(600)]
        for k in range(40):
            edited = list(base)
            for i in rng.sample(range(len(base)), 2 if k % 2 else 19):
                edited[i] = f"x{rng.randrange(10**6)}"
            rows.append((1000 * group + k, " ".join(edited), "en", "a", 1))
    sets = {d: frozenset(zip(*(t.split()[j:] for j in range(5)), strict=False)) for d, t, *_ in rows}
    found: dict[int, int] = {}
    for d in sorted(sets):  # every group's pairs
        if d not in found:
            stack = [d]
            while stack:
                x = stack.pop()
                found[x] = d
                stack += [y for y in sets if y // 1000 == d // 1000 and y not in found and 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), distance=14, width=5, words=2, alike=True)
    assert {r.doc_id: r.component_id for r in got.collect()} == found


def test_fingerprint_is_a_majority_of_shingle_hashes():
    from xxhash import xxh64_intdigest

    def brute(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        h = [xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for _, text, *_ in messy():
        assert fingerprint(text) == brute(text)


@pytest.mark.parametrize(("dense", "hot"), [(False, 8192), (True, 8192), (True, 100)])
def test_links_of_dense_and_scattered_fingerprints(spark, dense, hot, monkeypatch):
    monkeypatch.setattr(simhash, "_HOT", hot)  # with few rows a task even these buckets are split
    r = random.Random(2)
    centre = r.getrandbits(64)
    fps = set()
    while len(fps) < 6000:
        x = centre if dense else r.getrandbits(64) & ~0xFFFFFFFF | centre & 0xFFFFFFFF
        for _ in range(r.randint(0, 6) if dense else r.randint(0, 1)):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    signed = [(int(np.uint64(x).astype(np.int64)),) for x in fps]
    links = fingerprint_links(spark.createDataFrame([x * 2 for x in signed], "node long, fp long"), 4).collect()
    assert hot < 8192 or len(links) < 40 * len(fps)
    mask = (1 << 64) - 1
    assert all(((a & mask) ^ (b & mask)).bit_count() <= 4 for a, b in links)
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a & mask)] = find(b & mask)
    groups = brute_components(dict.fromkeys(fps), 4)
    assert len({find(x) for x in fps}) == len({id(g) for g in groups.values()})


@pytest.mark.parametrize("n", [10, 10**6, 10**10])
def test_any_plan_covers_the_distance(n):
    sample = np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64)
    for distance in (4, 7):
        plan = plan_partitions(sample, n, distance)
        assert sum(t + 1 for _, t in plan) > distance
    bits = [b for group, _ in plan for b in group]
    assert len(bits) == len(set(bits))


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(400)] + [(1000, 2000), (2000, 3000), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 401)}, 2000: 1000, 3000: 1000}


def test_queries_with_sql_match_duckdb(spark, sf_dir):
    import duckdb

    from tidewright.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for name in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    for name, sql in SQL.items():
        got = QUERIES[name](spark, sf_dir)
        want = con.execute(sql)
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert Counter(map(tuple, got.select(*columns).collect())) == Counter(want.fetchall()), name
