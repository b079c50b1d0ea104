"""What operators give for rows by hand, worked out from the specification's words and not from their SQL."""

from __future__ import annotations

import pytest

from folio import catalogue

SEGMENTS = "conv_id long, turn long, role string, segment_id string, speaker string, text string, confidence double"
LINES = "conv_id long, turn long, role string, speaker string, text string"


def run(spark, name, **tables):
    return catalogue.queries()[name].on(**{t: spark.createDataFrame(rows, schema) for t, (rows, schema) in tables.items()}).collect()


def segments(*rows):
    return [(c, t, "user", f"{c}-{t}", s, x, p) for c, t, s, x, p in rows], SEGMENTS


def names(*found):
    return [(n,) for n in found], "name string"


def close(x):
    return pytest.approx(x, abs=1e-9)


def test_scores_of_segments(spark):
    rows = segments((1, 0, "Ann", "short", 0.9), (1, 1, "AMBIGUOUS", "x" * 120, 0.9), (1, 2, "narrator", "y" * 1001, 0.9), (1, 3, "Ann", '"Well now," she said', 0.9))
    got = {r["segment_id"]: r for r in run(spark, "segment_quality", segments=rows)}
    # 0.8 for all; half when short, 0.9 when over 1000; 0.6 for AMBIGUOUS, 1.1 for the narrator
    assert [got[f"1-{i}"]["segment_quality"] for i in range(4)] == close([0.4, 0.48, 0.8 * 0.9 * 1.1, 0.8])
    # 0.7 for all; half when short, 1.1 over 100, 0.9 over 500; 0.6 AMBIGUOUS, 1.1 a name; 1.05 with marks
    assert [got[f"1-{i}"]["quality"] for i in range(4)] == close([0.7 * 0.5 * 1.1, 0.7 * 1.1 * 0.6, 0.63, 0.7 * 1.1 * 1.05])
    assert [got[f"1-{i}"]["segment_type"] for i in range(4)] == ["mixed", "ambiguous", "narrative", "dialogue"]


def test_issues_and_refined_scores(spark):
    rows = segments((1, 0, "Ann", "short", 0.9), (1, 1, "narrator", 'She said "no" and went away again, as she always had done.', 0.9), (1, 2, "Ann", "A line with a fair number of letters in it, and no mark at all.", 0.9))
    got = {r["segment_id"]: r for r in run(spark, "segment_validation", segments=rows)}
    assert [got[f"1-{i}"]["issues"] for i in range(3)] == ["segment_too_short;low_quality_score;", "unexpected_dialogue_in_narrative;", ""]
    assert got["1-0"]["refined_quality"] == close(max(0.385 * 0.7 * 0.5, 0.1))
    assert got["1-1"]["refined_quality"] == close(0.7 * 1.05) and got["1-2"]["refined_quality"] == close(min(0.77 * 1.1, 1))


def test_rules_of_attribution(spark):
    lines = [
        (1, 0, "u", "Ann", "ANN: come in"),
        (1, 1, "u", "Ann", '"Come," Ann said.'),
        (1, 2, "u", "Ann", '"Come," Zoe said.'),
        (1, 3, "u", "Ann", "Ann thought about it."),
        (1, 4, "u", "Ann", "Rain fell on the town."),
        (1, 5, "u", "Ann", '"Who is there?"'),
        (1, 6, "u", "Ann", "Exeunt all"),
        (1, 7, "u", "Ann", "z" * 201),
    ]
    got = {r["turn"]: (r["speaker"], r["confidence"], r["rule"], r["status"]) for r in run(spark, "rule_attribution", utterances=(lines, LINES), names=names("Ann"))}
    assert got == {
        0: ("Ann", 1.0, "script", "ATTRIBUTED"),
        1: ("Ann", 0.9, "tag", "ATTRIBUTED"),
        2: ("Zoe", 0.7, "tag", "PENDING_AI"),
        3: ("Ann", 0.8, "thought", "ATTRIBUTED"),
        4: ("narrator", 0.85, "narrative", "ATTRIBUTED"),
        5: ("AMBIGUOUS", 0.3, "dialogue", "PENDING_AI"),
        6: ("narrator", 0.95, "stage", "ATTRIBUTED"),
        7: ("narrator", 0.6, "other", "PENDING_AI"),
    }


def test_errors_of_segments(spark):
    rows = segments(
        (1, 0, "", "text", 0.9),
        (1, 1, "Ann", "", 0.9),
        (1, 2, "narrator", '"Hello"', 0.9),
        (1, 3, "Ann", "plain prose", 0.9),
        (1, 4, "ann x", '"Hello"', 0.9),
        (1, 5, "Bob", '"' + "w" * 500 + '"', 0.9),
        (1, 6, "Ann", '"One"', 0.9),
        (1, 7, "Ann", '"Two"', 0.9),
        (1, 8, "Ann", "She thought so", 0.9),
    )
    got = {r["segment_id"]: r["errors"] for r in run(spark, "validator_errors", segments=rows, names=names("Ann", "Bob"))}
    want = ["missing_speaker;narrative_as_dialogue;", "missing_text;narrative_as_dialogue;", "dialogue_as_narrator;", "narrative_as_dialogue;", "unknown_speaker;", "very_long_dialogue;", "", "consecutive_same_speaker;", ""]
    assert [got[f"1-{i}"] for i in range(9)] == want


def test_score_of_a_conversation(spark):
    rows = segments(*[(1, i, "narrator", f"Prose number {i}", 0.9) for i in range(8)], (1, 8, "AMBIGUOUS", "plain", 0.9), (1, 9, "narrator", '"Said"', 0.9))
    got = run(spark, "document_quality_score", segments=rows, names=names("narrator"))[0]
    # one error of ten: 90 % attributed, less a fifth for errors, 3 for the ambiguous one, 3 penalty
    assert got["errors"] == 1 and got["score"] == close(0.9 * 100 * (1 - 0.2) - 0.1 * 30 - 3) and got["band"] == "Fair"


def test_neighbours_turns_and_refinement(spark):
    rows = segments((1, 0, "Ann", '"a"', 0.9), (1, 1, "Bob", '"b"', 0.9), (1, 2, "AMBIGUOUS", '"c"', 0.9), (1, 3, "Bob", '"d"', 0.9), (1, 4, "narrator", "went", 0.9))
    assert [(r["turn"], r["speaker"], r["n"]) for r in run(spark, "neighbor_majority", segments=rows)] == [(2, "Bob", 2)]
    got = {r["turn"]: r["expected"] for r in run(spark, "turn_taking", segments=rows)}
    assert got[0] is None and got[2] == "Ann"
    refined = {r["turn"]: (r["speaker"], r["strategy"]) for r in run(spark, "refine_ambiguous", segments=rows, names=names("Ann", "Bob"))}
    assert refined[2] == ("Ann", "turn_taking") and refined[1] == ("Bob", "kept")


def test_statistics_of_texts(spark):
    text = "The cat is in the house. It ran!\n\nWhere to? Home"
    got = run(spark, "doc_text_stats", documents=([(1, text), (1, None), (2, "")], "doc_id long, text string"))
    full = next(r for r in got if r["words"] and r["doc_id"] == 1)
    assert len(got) == 3
    assert (full["chars"], full["words"], full["lines"], full["paragraphs"], full["sentences"], full["english"]) == (len(text), 11, 3, 2, 4, True)
    assert full["avg_word_length"] == close(sum(map(len, text.split())) / 11)


def test_scores_of_stories(spark):
    texts = {1: "tiny", 2: '"Well," she said, and walked on to the gate of the town', 3: "Copyright 1999 of the author", 4: "A plain sentence of some length. " * 20}
    got = {r["doc_id"]: r["score"] for r in run(spark, "story_score", documents=(list(texts.items()), "doc_id long, text string"))}
    # 0.5, talk 0.3, two families of verbs 0.2, both 0.2; two marks of no story; long, longer and of sentences
    assert got == {1: 0.0, 2: 1.0, 3: 0.0, 4: close(0.5 + 0.1 + 0.1 + 0.1)}


def test_windows_of_sentences(spark):
    text = ". ".join(f"s{i}" for i in range(30))
    got = sorted((r["window_index"], r["task_start"], r["task_end"], r["context_start"], r["has_context"]) for r in run(spark, "sliding_windows", documents=([(1, text)], "doc_id long, text string")))
    assert got == [(0, 0, 15, 0, False), (1, 11, 26, 0, True), (2, 22, 30, 0, True)]


def test_requests(spark):
    requests = [(i, f"2024-01-{1 + i // 100:02d} 10:00:00", i % 7, 4, float(i % 100) / 10, 100, i % 10 > 0, "view", 0.5) for i in range(200)]
    schema = "request_id long, at string, instance_id long, model_id long, response_time double, tokens long, success boolean, job_type string, cost double"
    df = spark.createDataFrame(requests, schema).selectExpr("*", "cast(at as timestamp_ntz) as ts").drop("at")
    ask = lambda name: catalogue.queries()[name].on(requests=df).collect()
    usual = {r["day"].day: (r["cost"], r["level"]) for r in ask("budget_alerts_usual")}
    assert usual == {1: (50.0, "critical"), 2: (50.0, "critical")}
    own = ask("request_metrics")[0]
    assert (own["requests"], own["successes"], own["avg_cost"], own["tokens"]) == (200, 180, 0.5, 20000)
    times = sorted(r[4] for r in sorted((r for r in requests if r[6]), key=lambda r: -r[0])[:100])
    latency = ask("latency_percentiles_last100")[0]
    assert (latency["p50"], latency["p95"], latency["p99"]) == (times[50], times[95], times[99])
    means = {r["instance_id"]: r for r in ask("instance_means")}
    assert means[0]["input_tokens"] == 100 and means[0]["output_tokens"] == 50 and means[0]["context_used"] == close(round(100 / 30720, 9))
