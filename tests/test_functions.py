import random

from hypothesis import given, settings
from hypothesis import strategies as st

from folio.functions import fuzzy, splitting
from folio.operators.sequential import Breaker, merged_profiles
from folio.plans.sql import SqlOperator, full_text


def test_ratio_counts_shared_characters_in_order():
    assert fuzzy.ratio("John", "John") == 100
    assert fuzzy.ratio("John", "") == 0
    assert fuzzy.ratio("abcd", "abxd") == 75
    assert fuzzy.partial_ratio("john", "said john quietly") == 100
    assert fuzzy.token_set_ratio("John Smith", "smith john") == 100
    assert fuzzy.token_set_ratio("John", "John Smith") == 100


@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_common_subsequence_against_a_table(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    assert fuzzy.common(a, b) == rows[-1][-1]


def test_sentences_do_not_end_inside_quotations():
    text = '"Stop. Go on," she said. Then she left. He stayed.'
    assert splitting.sentences(text) == ['"Stop. Go on," she said.', "Then she left.", "He stayed."]


@settings(max_examples=60)
@given(st.lists(st.sampled_from(["One two three four.", 'He said "no way." ', "Then it rained!", "why not?", "\n"]), max_size=60))
def test_splitting_loses_no_characters(parts):
    text = " ".join(parts)
    assert "".join("".join(splitting.split_segment(text)).split()) == "".join(text.split())


def test_packing_respects_the_limit():
    out = splitting.packed(["x" * 40] * 20, 100)
    assert all(len(p) <= 100 for p in out) and sum(p.count("x") for p in out) == 800


def test_breaker_opens_waits_and_closes():
    b = Breaker()
    assert [b.step(i, False) for i in range(5)][-2:] == ["CLOSED", "OPEN"]
    assert b.step(1_000_000, True) == "OPEN"
    after = 4 + Breaker.WAIT_US
    assert [b.step(after + i, True) for i in range(3)] == ["HALF_OPEN", "HALF_OPEN", "CLOSED"]
    for i in range(5):
        b.step(after + 10 + i, False)
    late = after + 20 + Breaker.WAIT_US
    assert b.step(late, False) == "OPEN"


def test_breaker_goes_on_from_its_state():
    rng = random.Random(1)
    steps = [(i * 7_000_000, rng.random() < 0.4) for i in range(300)]
    whole, cut = Breaker(), Breaker()
    for us, ok in steps:
        cut = Breaker(*cut.held())
        assert whole.step(us, ok) == cut.step(us, ok)


def test_profiles_that_are_alike_merge():
    import pandas as pd

    out = merged_profiles(pd.DataFrame({"conv_id": [1] * 4, "name": ["Johnny", "John", "Mary", "Marie"], "n": [5, 3, 2, 1]}))
    assert dict(zip(out["name"], out["n"])) == {"Johnny": 8, "Mary": 2, "Marie": 1}


def test_views_become_common_table_expressions():
    text, tables = full_text("select * from {names}", 1)
    assert tables == {"conversations"} and text.startswith("with utterances as")


def test_operators_take_frames(spark):
    rows = spark.createDataFrame([("a", "User", "Hello there, said the man who was here before.")], "segment_id string, speaker string, text string")
    op = SqlOperator("x", "select segment_id, length(text) as n from {segments}")
    assert op.on(segments=rows).first()["n"] == 46


GOLDEN = [
    ("USER: Hello there", "User", "script"),
    ('"Hello there," User said.', "User", "tag"),
    ("The room was quiet.", "narrator", "narrative"),
    ("User thought about it. Fine", "User", "thought"),
    ('"Who is there?"', "AMBIGUOUS", "dialogue"),
]


def test_rules_on_known_lines(spark):
    from folio.operators.attribution import C

    lines = spark.createDataFrame([(1, i, "user", "User", t) for i, (t, _, _) in enumerate(GOLDEN)], "conv_id long, turn long, role string, speaker string, text string")
    got = {r["turn"]: (r["speaker"], r["rule"]) for r in C["rule_attribution"].on(utterances=lines).collect()}
    assert [got[i] for i in range(len(GOLDEN))] == [(s, r) for _, s, r in GOLDEN]
