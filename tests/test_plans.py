import json
from pathlib import Path

import pytest

from folio import __main__ as cli
from folio.functions.registered import register
from folio.plans import sizing, structuring


@pytest.mark.parametrize("strategy", sizing.STRATEGIES)
@pytest.mark.parametrize(("cores", "memory"), [(1, 2), (8, 16), (64, 256)])
def test_sizes_fit_the_machine(strategy, cores, memory):
    s = sizing.sizes(sizing.Workload(50_000, "llm_processing"), cores, memory, strategy)
    assert 1 <= s.executors <= 20 and 1 <= s.cores <= 8
    assert s.executors == 1 or s.executors * s.cores <= cores
    assert s.executors * s.memory_gb + s.driver_gb <= max(2, memory * 0.9)


def test_shuffle_partitions_follow_the_data():
    assert sizing.sizes(sizing.Workload(1_280_000), 16, 64).shuffle_partitions == 10_000
    assert sizing.recommend(sizing.Workload(100, "llm_processing")) == "memory_optimized"
    assert sizing.submit_settings(sizing.sizes(sizing.Workload(10), 4, 8))["spark.executor.memory"].endswith("g")


TEXT = '"Hello there," John said. "How are you today?" asked Mary. ' + "The room was quiet and nobody moved for a long time. " * 8


@pytest.fixture
def names(spark):
    return spark.createDataFrame([("John",), ("Mary",)], "name string")


def test_only_pending_lines_are_asked(spark, names):
    docs = spark.createDataFrame([(1, TEXT), (2, " "), (3, "Short.")], "doc_id long, text string")
    lines = structuring.lines_of(docs)
    out = structuring.structured(lines, names, lambda texts: ["Mary"] * len(texts))
    rows = out.collect()
    assert {r["conv_id"] for r in rows} == {1, 3} and len(rows) == lines.count()
    assert {r["speaker"] for r in rows if r["method"] == "scorer"} <= {"Mary"}
    whole = "".join("".join(r["text"].split()) for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])))
    assert whole == "".join((TEXT + "Short.").split())


def test_a_scorer_that_fails_marks_its_lines(spark):
    lines = spark.createDataFrame([(1, i, f"line {i}") for i in range(45)], "conv_id long, turn long, text string")

    def broken(texts):
        raise RuntimeError("no model")

    rows = structuring.ask(lines, broken).collect()
    assert len(rows) == 45 and all(r["answer"] == "AMBIGUOUS" and "no model" in r["error"] for r in rows)
    short = structuring.ask(lines, lambda t: t[:1]).collect()
    assert {r["answer"] for r in short} <= {"AMBIGUOUS", *[f"line {i}" for i in range(45)]}


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(TEXT)
    cli.main([str(tmp_path / "in"), str(tmp_path / "out"), "--names", "John, Mary"])
    read = lambda d: [json.loads(x) for p in Path(tmp_path, "out", d).glob("part-*") for x in p.read_text().splitlines()]
    assert read("segments") and {"conv_id", "band"} <= set(read("report")[0])
    assert "AMBIGUOUS" not in {r["speaker"] for r in read("segments")}


def test_registered_functions(spark):
    register(spark)
    row = spark.sql(
        "select calculate_quality_score('Hello there, you', 'narrator') a, segment_type('\"Hi\"', 'John') b, dialogue_confidence('\"Yes,\" she said') c, "
        "quality_band(81e0) d, calculate_avg_confidence('[0.5, 1.0]') e, calculate_avg_confidence('[]') f, segment_text('One. Two.') g, token_set_ratio('a b', 'b a') h"
    ).first()
    assert (round(row["a"], 6), row["b"], row["c"], row["d"], row["e"], row["f"], row["g"], row["h"]) == (0.88, "dialogue", 1.0, "Good", 0.75, 0.0, ["One. Two."], 100)
