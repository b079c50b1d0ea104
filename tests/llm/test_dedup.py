"""Exact and near duplicates against brute force, with nulls, empty texts, ties and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash

from folio.llm import common, exact_dedup, simhash
from folio.llm.components import components

CASES = [
    (1, "Same Text"),
    (2, "same text"),
    (3, None),
    (4, ""),
    (5, "ÄÖ same"),
    (6, "äö same"),
    (None, "SAME TEXT"),
    (None, "only null id"),
    (None, "only null id"),
    (7, "w " * 50_000),
    (7, "w " * 50_000),
    (8, " \n\t "),
]


@pytest.fixture
def cases(spark):
    """Extra columns whose names clash with those that the operators use."""
    rows = [(i, i, t, "x", "y", 1.5) for i, t in CASES]
    return spark.createDataFrame(rows, "c0 long, doc_id long, text string, TEXT string, keep_id string, fp double")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_decisions_on_cases(cases):
    got = sorted(map(tuple, exact_dedup.decide(cases).collect()), key=str)
    want = []
    for i, t in CASES:
        group = [k for k, u in CASES if lowered(u) == lowered(t)]
        best = max((k for k in group if k is not None), default=None)
        want.append((i, best, len(group), i == best, hashlib.sha256(lowered(t).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_unique_rows_keeps_one_row_a_text_and_all_columns(cases):
    out = exact_dedup.unique_rows(cases)
    assert out.columns == cases.columns
    texts = [lowered(r[2]) for r in out.collect()]
    assert sorted(texts) == sorted({lowered(t) for _, t in CASES})


@pytest.mark.parametrize("settings", [dict(bits_per_row=1), dict(bits_per_row=64), dict(block=8), dict(block=1, bits_per_row=1)])
def test_filter_has_no_false_dismissals(spark, settings):
    rng = random.Random(5)
    rows = [(i, f"text {rng.randrange(400)}") for i in range(600)]
    keys = exact_dedup.stored(exact_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)), "keys")
    marked = keys.select("h", exact_dedup.repeats(keys, **settings).column("part", "h").alias("maybe")).collect()
    times = Counter(r["h"] for r in marked)
    assert len(marked) == 600 and all(r["maybe"] for r in marked if times[r["h"]] > 1)
    if settings == dict(bits_per_row=64):
        assert sum(r["maybe"] for r in marked if times[r["h"]] == 1) < 20


@pytest.mark.parametrize("hot", [common.HOT, 2])
def test_hot_group(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    df = spark.range(5000).selectExpr("id as doc_id", "if(id % 3 = 0, 'Hot', 'text ' || id) as text")
    rows = exact_dedup.decide(df).where("group_size > 1").collect()
    assert len(rows) == 1667 and {r["keep_id"] for r in rows} == {4998} and sum(r["kept"] for r in rows) == 1
    assert exact_dedup.unique_rows(df).count() == 5000 - 1666


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.decide(none).count() == exact_dedup.unique_rows(none).count() == 0
    assert simhash.near_groups(none).count() == simhash.first_of_groups(none).count() == 0


def slow_fingerprint(text, size=3, draw=0):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    h = [slow_mix(xxhash.xxh64_intdigest(s.encode(), 42), draw) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def slow_mix(x, draw):
    if draw:
        x = (x + draw * 0x9E3779B97F4A7C15) % 2**64
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        x ^= x >> 31
    return x


def slow_groups(prints):
    """prints: (id, fingerprint or those of some draws); the smallest id reachable by links of at most three bits."""
    prints = [(k, f if isinstance(f, list) else [f]) for k, f in prints]
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if any((x ^ y).bit_count() <= 3 for x, y in zip(prints[i][1], prints[j][1])):
                a, b = sorted((find(i), find(j)), key=lambda k: prints[k][0])
                root[b] = a
    out = {}
    for i, (k, _) in enumerate(prints):
        out.setdefault(find(i), []).append(k)
    return {k: min(v) for v in out.values() for k in v}


def near_texts(n):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            base = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, 1, 2])):
                base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(base))
        else:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 400]))))
    return texts


@pytest.mark.parametrize("bucket", [4096, 3])
def test_groups_against_brute_force(spark, bucket):
    rows = list(enumerate([*near_texts(220), "", " \t ", None, "One", "one"]))
    got = {r["doc_id"]: r for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), bucket=bucket).collect()}
    prints = [(i, slow_fingerprint(t)) for i, t in rows]
    assert [got[i]["fps"][0] & (2**64 - 1) for i, _ in rows] == [f for _, f in prints]
    want = slow_groups(prints)
    assert len(set(want.values())) < len(rows) - 30
    assert {i: got[i]["component_id"] for i, _ in rows} == want


def test_more_draws_against_brute_force(spark):
    rows = list(enumerate([*near_texts(120), "", None, "a b c d", "a b c"]))
    got = {r["doc_id"]: r for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5, draws=4).collect()}
    prints = [(i, [slow_fingerprint(t, 5, k) for k in range(4)]) for i, t in rows]
    assert [[x & (2**64 - 1) for x in got[i]["fps"]] for i, _ in rows] == [f for _, f in prints]
    want = slow_groups(prints)
    assert len(set(want.values())) < len(set(slow_groups([(i, f[:1]) for i, f in prints]).values()))
    assert {i: got[i]["component_id"] for i, _ in rows} == want


@pytest.mark.parametrize("bucket", [4096, 5])
def test_links_of_fingerprints_that_differ_a_little(spark, bucket):
    rng = random.Random(bucket)
    prints = []
    for _ in range(30):
        f = rng.getrandbits(64)
        for _ in range(8):
            g = f
            for b in rng.sample(range(64), rng.randrange(6)):
                g ^= 1 << b
            prints.append(g)
            f = rng.choice([f, g])
    prints = list(enumerate(dict.fromkeys(prints)))
    signed = [(f - (1 << 64) if f >> 63 else f, i) for i, f in prints]
    stars = simhash.links(spark.createDataFrame([(0, *x) for x in signed], "draw int, fp long, rep long"), bucket)
    got = {i: i for i, _ in prints} | {r["node"]: r["component"] for r in components(stars).collect()}
    assert got == slow_groups(prints)


def test_near_cases(cases):
    rows = simhash.near_groups(cases).collect()
    assert len(rows) == len(CASES)
    assert {r["component_id"] for r in rows if r["doc_id"] in (3, 4, 8)} == {3} and all(r["fps"] == [0] for r in rows if r["doc_id"] in (3, 4, 8))
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    out = simhash.first_of_groups(cases)
    assert out.columns == cases.columns and sorted(r[1] for r in out.collect() if r[1] is not None) == [1, 3, 5, 6, 7, 7]


def test_components_of_long_chains(spark):
    chain = spark.range(200).selectExpr("id * 7 % 200 as a", "(id + 1) * 7 % 200 as b").where("a <> 0")
    assert {r["component"] for r in components(chain).collect()} == {0}
