"""Recovery of segments by hand, a strategy at a time, and over a table."""

from __future__ import annotations

from folio.functions import recovery
from folio.operators import sequential


def near(*pairs):
    return [{"speaker": s, "text": t} for s, t in pairs]


def habit(speaker, words=(), size=500.0, talk=0.0):
    return {"speaker": speaker, "words": list(words), "size": size, "talk": talk}


def test_strategies_in_their_order():
    known = [habit("Mary"), habit("John")]
    assert recovery.recover('"Go now," Mary said.', [], [], known) == ("Mary", "name")
    assert recovery.recover('"Go now," Marry said.', [], [], known) == ("Mary", "name")
    assert recovery.recover("and John's voice rose", [], [], known) == ("John", "name")
    talk = near(("Mary", "a"), ("John", "b"))
    assert recovery.recover('"And so?"', talk, [], []) == ("Mary", "context")
    assert recovery.recover("And so", near(("Mary", "a"), ("John", "b"), ("John", "c")), [], []) == ("John", "context")
    assert recovery.recover("She was walking there", [], [], []) == ("narrator", "content")
    assert recovery.recover('"One", "two"', [], [], []) == ("AMBIGUOUS", "content")
    assert recovery.recover("plain words here", near(("narrator", "plain words here too")), [], []) == ("narrator", "nearness")
    assert recovery.recover("green river song", [], [], [habit("Ann", ["green", "river", "song"], 16.0)]) == ("Ann", "habit")
    assert recovery.recover("green", [], [], [habit("Ann")]) == ("narrator", "fallback")


def test_segments_of_a_table(spark):
    rows = [(1, 0, "Mary", '"Well," she said'), (1, 1, "John", '"Yes"'), (1, 2, "UNFIXABLE", '"And then?"'), (1, 3, "narrator", "It rained"), (2, 0, "UNFIXABLE", "nothing"), (2, 1, "UNFIXABLE", None)]
    got = {(r["conv_id"], r["turn"]): (r["speaker"], r["strategy"]) for r in sequential.recovered(spark.createDataFrame(rows, "conv_id long, turn long, speaker string, text string")).collect()}
    assert got == {(1, 2): ("Mary", "context"), (2, 0): ("narrator", "fallback"), (2, 1): ("narrator", "fallback")}
