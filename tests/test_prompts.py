"""Prompts, the ladder and answers by hand."""

from __future__ import annotations

import pytest

from folio.functions import prompts
from folio.plans import structuring


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ('["Ann", "Bob"]', ["Ann", "Bob"]),
        ('thinking [1] then FINAL ANSWER: ["Ann", "unknown"]', ["Ann", "AMBIGUOUS"]),
        ('```json\n{"speakers": ["Ann", "Bob",]}\n```', ["Ann", "Bob"]),
        ("['Ann', 'O'Neil']", ["Ann", "O'Neil"]),
        ("[“Ann”, “Bob”", ["Ann", "Bob"]),
        ("[Ann, Mary Ann]", ["Ann", "Mary Ann"]),
        ("1. Ann: yes\n# note\n2. Bob", ["Ann", "Bob"]),
        ("[null, 3]", ["AMBIGUOUS", "AMBIGUOUS"]),
        ("I cannot say; there are too many of them, and (so on).", []),
        ("", []),
        (None, []),
    ],
)
def test_answers(answer, want):
    assert prompts.parsed(answer) == want


def test_every_family_numbers_the_lines():
    for family in prompts.FAMILIES:
        text = prompts.prompt(family, ["one", "two"], ["Bob", "Ann"], "first")
        assert "\n1. one\n2. two\n" in text and "Known: Ann, Bob." in text and "{" not in text
    assert "first person" in prompts.prompt("pov", ["x"], pov="first")


def test_families_by_complexity():
    assert [prompts.first_family(["x"] * n) for n in (1, 12, 22, 40)] == ["standard", "pov", "reasoning", "agentic"]


def test_ladder_halves_and_gives_up():
    asked = []

    def model(text):
        asked.append(text.splitlines()[0])
        n = sum(x[:1].isdigit() for x in text.splitlines())
        return '["Ann"]' if n == 1 and "bad" not in text else "no idea, sorry; none (of them)."

    assert prompts.through(model)(["a", "bad", "c"]) == ["Ann", "AMBIGUOUS", "Ann"]
    assert asked[:4] == [prompts.FAMILIES[f][0].format(n=3, known="") for f in prompts.LADDER]


def test_ladder_as_a_scorer_over_lines(spark):
    lines = spark.createDataFrame([(1, i, f"line {i}") for i in range(5)], "conv_id long, turn long, text string")
    scorer = prompts.through(lambda text: str(["Ann"] * sum(x[:1].isdigit() for x in text.splitlines())))
    assert {(r["answer"], r["error"]) for r in structuring.ask(lines, scorer).collect()} == {("Ann", None)}
