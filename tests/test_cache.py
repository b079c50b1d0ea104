"""The cache, validators by name, alert files."""

from __future__ import annotations

import json

import pytest

from folio import catalogue
from folio.functions.registered import register
from folio.operators.events import RULES
from folio.plans import dashboards
from folio.sources import cache


def entries(spark, **values):
    return spark.createDataFrame(list(values.items()), "key string, value string")


def values(spark, c, namespace="segment"):
    keys = spark.createDataFrame([(k,) for k in "abcd"], "key string")
    return {r["key"]: r["value"] for r in c.get(keys, namespace).collect()}


def test_cache(spark):
    c = cache.Cache(spark)
    c.put(entries(spark, a="1", b="2"), tags=["x"])
    c.put(entries(spark, a="3"))
    c.put(entries(spark, a="9"), "llm", tags=["x"])
    c.put(entries(spark, d="0"), seconds=-1)
    assert values(spark, c) == {"a": "3", "b": "2", "c": None, "d": None} and values(spark, c, "llm")["a"] == "9"
    assert c.exists("a") and not c.exists("d")
    c.delete(["a"])
    c.invalidate("x")
    assert values(spark, c) == dict.fromkeys("abcd") and not c.exists("a", "llm")
    c.put(entries(spark, c="5"))
    c.put(entries(spark, c="6"), "llm")
    c.clear("segment")
    c.compact()
    assert not c.exists("c") and c.exists("c", "llm")


def test_decorators(spark, tmp_path):
    known, ran = {}, []

    @cache.stored_once(lambda: known)
    def numbers(session, folder):
        ran.append(folder)
        return session.range(5)

    assert numbers(spark, "f").count() == numbers(spark, "f").count() == 5 and ran == ["f"]
    df, seen = cache.measured(lambda: spark.range(7))()
    assert df.count() == 7 and seen.get["rows"] == 7


@pytest.mark.parametrize(
    ("call", "want"),
    [
        ("validate_segment_quality('short', 0.4, 'dialogue')", ["segment_too_short", "low_quality_score", "missing_dialogue_markers"]),
        ("validate_segment_quality('It said \"no\" to them', 0.9, 'narrative')", ["unexpected_dialogue_in_narrative"]),
        ("validate_segment_quality(null, 0.9, 'narrative')", ["segment_too_short"]),
        ("generate_refinement_suggestions(0.5, 0.9, 2)", ["improve_speaker_detection", "verify_speaker_presence"]),
        ("calculate_refined_quality(repeat('x', 60), 0.8, '[]')", 0.88),
        ("calculate_refined_quality('x', 0.4, '[\"segment_too_short\", \"low_quality_score\"]')", 0.14),
        ("refine_text_content('a  b', '[\"missing_dialogue_markers\"]')", '"a b"'),
        ("should_apply_refinement('[\"excessive_whitespace\"]')", True),
        ("should_apply_refinement(null)", False),
        ("calculate_consistency_score('[0.9, 0.7]', 3)", 0.8),
        ("calculate_consistency_score('[0.9]', 30)", 0.5),
        ("calculate_consistency_score('none', 30)", 0.5),
        ("attribute_speakers('Mary said so', array('Mary')).speaker", "narrator"),
    ],
)
def test_functions_by_name(spark, call, want):
    register(spark)
    got = spark.sql(f"select {call} as x").first()["x"]
    assert (json.loads(got) if isinstance(want, list) else got) == (pytest.approx(want) if isinstance(want, float) else want)


def test_alerts_and_dashboards():
    text = dashboards.alert_yaml()
    assert text.count("- alert: ") == len(RULES) == 26 and "expr: disk_bytes > 8.58993e+10" in text
    assert all(q in catalogue.queries() for names in dashboards.DASHBOARDS.values() for q in names)
    assert len(json.loads(dashboards.dashboard("models"))["panels"]) == 4 and len(dashboards.topic_settings()) == 10
