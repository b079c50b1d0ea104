"""Blocked matching against all pairs, and the cascade of rules on lines by hand."""

from __future__ import annotations

import random

import pytest

from folio.functions import cascade, fuzzy
from folio.operators import matching


def names(spark, words):
    return spark.createDataFrame([(w,) for w in words], "name string")


@pytest.mark.parametrize("above", [75, 80, 85])
def test_best_matches_are_those_of_all_pairs(spark, above):
    rng = random.Random(above)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    words = sorted({w[:k] + rng.choice("abcde ") + w[k:] for w in base for k in (0, len(w) // 2, len(w))} | set(base) | {"Ab cd", "cd Ab e", "x"})
    words = [w for w in words if w.strip()]
    left, right = words[::2], words[1::3] + words[:5]
    got = {r["name"]: (r["known"], r["score"]) for r in matching.best_match(names(spark, left), names(spark, right), above).collect()}
    want = {}
    for a in left:
        scored = [(-fuzzy.token_set_ratio(a, b), b) for b in right if a != b and fuzzy.token_set_ratio(a, b) > above]
        if scored:
            want[a] = (min(scored)[1], -min(scored)[0])
    assert got == want and len(want) > 10


def syllables(seed, n):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(["en", "er", "th", "on", "an", "sch", "i"]) for _ in range(rng.randint(1, 7))) for _ in range(n)})


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_only_pairs_that_may_pass_are_scored(spark):
    words = [w for w in syllables(1, 500) if len(w) < 15]
    df = names(spark, words)
    got = {tuple(r) for r in matching.candidates(df, df, 80).collect()}
    want = {(a, b) for a in words for b in words if 200 * fuzzy.common(a, b) > 80 * (len(a) + len(b))}
    assert got == want and len(want) > len(words)


@pytest.mark.parametrize("most", [0, 20, matching.MOST])
def test_keys_meet_for_all_pairs_that_pass(monkeypatch, most):
    monkeypatch.setattr(matching, "MOST", most)
    words = syllables(2, 150)
    rules = [(matching.distance_under(5), lambda a, b: 5 * distance(a, b) < max(len(a), len(b)))]
    rules.append((matching.ratio_over(80), lambda a, b: 200 * fuzzy.common(a, b) > 80 * (len(a) + len(b))))
    for rule, passes in rules:
        own, other = ({w: set(matching.keys(w, rule, first)) for w in words} for first in (True, False))
        assert all(own[a] & other[b] for a in words for b in words if passes(a, b))


def test_names_of_one_table_meet_as_those_of_two(spark):
    words = [*syllables(4, 400), "Anth", "anth", "th en", "En th", "er th en", "th ern"]
    got, want = (sorted(map(tuple, matching.best_match(names(spark, words), right).collect())) for right in (None, names(spark, words)))
    assert got == want and len(want) > 50


@pytest.mark.parametrize("most", [0, 20, matching.MOST])
def test_names_of_one_table_take_half_of_the_keys(monkeypatch, most):
    monkeypatch.setattr(matching, "MOST", most)
    words = syllables(5, 150)
    rules = [(matching.distance_under(5), lambda a, b: 5 * distance(a, b) < max(len(a), len(b)))]
    rules.append((matching.ratio_over(80), lambda a, b: 200 * fuzzy.common(a, b) > 80 * (len(a) + len(b))))
    for rule, passes in rules:
        keyed = lambda r, first: {w: set(matching.keys(w, r, first)) for w in words}
        (longer, shorter), whole = matching.halves(rule), [keyed(rule, True), keyed(rule, False)]
        own, other = keyed(longer, True), keyed(shorter, False)
        assert all(own[a] & other[b] for a in words for b in words if len(a) <= len(b) and passes(a, b))
        assert sum(len(x) for d in (own, other) for x in d.values()) < 0.7 * sum(len(x) for d in whole for x in d.values())


@pytest.mark.parametrize("rule", [matching.ratio_over(80), matching.distance_under(5)], ids=["ratio", "distance"])
def test_keys_are_not_sent_to_the_driver(spark, rule):
    forms = names(spark, syllables(3, 300)).selectExpr("name", "name form")
    pairs = matching.meeting(forms, forms.withColumnRenamed("name", "known"), rule)
    assert pairs.collect()
    plan = pairs._jdf.queryExecution().executedPlan().toString()  # the last, by the sizes of what has run
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_names_that_lines_hold(spark):
    lines = spark.createDataFrame([(1, 1, "Ann met Annabel"), (1, 2, "an ANN"), (1, 3, ""), (1, 4, "Al"), (1, 5, None), (2, 1, "nobody")], "conv_id long, turn long, text string")
    got = {(r["conv_id"], r["turn"]): (r["name"], r["score"]) for r in matching.name_contains(lines, names(spark, ["Ann", "Annabel", "Al", "", "Zed"])).collect()}
    assert got == {(1, 1): ("Ann", 0.85), (1, 2): ("Ann", 0.7), (1, 4): ("Al", 0.85)}


CASES = [
    ('"Go there now," John said.', ["John"], ("John", 0.9, "tag")),
    ('"Go there now," Jon said.', ["John"], ("John", 0.8, "tag")),
    ('"Go there now," Peter said.', ["John"], ("Peter", 0.7, "tag")),
    ('"Go," Peter said.', [], ("Go", 0.7, "tag")),  # the first group that looks like a name counts
    ('"Go there now!" Mary Ann whispered.', [], ("Mary Ann", 0.7, "tag")),
    ('Mary replied, "Yes."', ["Mary"], ("Mary", 0.9, "tag")),
    ('"Go there now," said Peter', ["Peter"], ("Peter", 0.9, "tag")),
    ("JOHN: come here", ["John"], ("John", 1.0, "script")),
    ("First Citizen: speak", [], ("First Citizen", 1.0, "script")),
    ("Chapter: one", [], ("narrator", 0.85, "narrative")),
    ('"The tall John," it read', ["John"], ("John", 0.6, "presence")),
    ("John paused. 'Well then.'", [], ("John", 0.65, "action")),
    ("Mary was thinking of it", ["Mary"], ("Mary", 0.8, "thought")),
    ("Mary believed it", ["Marry"], ("Marry", 0.7, "thought")),
    ("Nobody came. The rain fell", ["Mary"], ("narrator", 0.85, "narrative")),
    ('"And now?"', ["Mary"], ("AMBIGUOUS", 0.3, "dialogue")),
    ("x" * 201, [], ("narrator", 0.6, "other")),
    (None, [], ("narrator", 0.6, "other")),
]


@pytest.mark.parametrize(("text", "known", "want"), CASES)
def test_cascade(text, known, want):
    assert cascade.attribute(text, known) == want


def test_cascade_as_a_column(spark):
    df = spark.createDataFrame([(t, k) for t, k, _ in CASES], "text string, known array<string>")
    got = [tuple(r["a"]) for r in df.select(cascade.attributed()("text", "known").alias("a")).collect()]
    assert got == [w for _, _, w in CASES]
