"""Functions by name for SQL: ``register(spark)``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from folio.functions import cascade, fuzzy, splitting
from folio.functions.fragments import marked
from folio.operators import quality, text  # noqa: F401


def _sql(fragment: str) -> str:
    from string import Template

    from folio.plans.sql import WORDS

    return Template(fragment).substitute({k: v[0] for k, v in WORDS.items()})


def _issue_list(*cases: tuple[str, str]) -> str:
    """A JSON array of the names whose conditions are true, in this order."""
    return f"to_json(filter(array({', '.join(f'case when {c} then {chr(39)}{n}{chr(39)} end' for n, c in cases)}), x -> x is not null))"


def _held(issue: str) -> str:
    return f"coalesce(array_contains(from_json(issues, 'array<string>'), '{issue}'), false)"


_marked = marked("text")
_scores = "from_json(scores, 'array<double>')"
_spread = f"sqrt(aggregate({_scores}, 0e0, (a, x) -> a + pow(x - aggregate({_scores}, 0e0, (b, y) -> b + y) / size({_scores}), 2)) / size({_scores}))"
_steps = "score * case when {} then 0.7e0 else 1e0 end * case when {} then 0.8e0 else 1e0 end".format(_held("segment_too_short"), _held("segment_too_long"))
#: The validators of segments and speakers, by the names that queries know them by.
VALIDATORS = {
    "validate_segment_quality(text string, quality double, type string)": (
        "string",
        _issue_list(
            ("segment_too_short", "length(trim(coalesce(text, ''))) < 10"),
            ("segment_too_long", "length(text) > 1000"),
            ("low_quality_score", "quality < 0.5e0"),
            ("missing_dialogue_markers", f"type = 'dialogue' and not {_marked}"),
            ("unexpected_dialogue_in_narrative", "type = 'narrative' and (contains(text, '\"') or contains(text, chr(39)))"),
        ),
    ),
    "calculate_refined_quality(text string, score double, issues string)": (
        "double",
        f"""case when size(from_json(coalesce(issues, '[]'), 'array<string>')) = 0 and length(text) > 50 then least(score * 1.1e0, 1e0)
          else case when {_held("low_quality_score")} then greatest({_steps} * 0.5e0, 0.1e0) else {_steps} end * case when {_held("missing_dialogue_markers")} then 0.6e0 else 1e0 end end""",
    ),
    "refine_text_content(text string, issues string)": (
        "string",
        f"trim(regexp_replace(case when {_held('missing_dialogue_markers')} and not {_marked} then concat('\"', text, '\"') else text end, '[ \t\n\r]+', ' '))",
    ),
    "should_apply_refinement(issues string)": ("boolean", f"{_held('missing_dialogue_markers')} or {_held('excessive_whitespace')}"),
    "calculate_consistency_score(scores string, lines long)": (
        "double",
        f"case when coalesce(size({_scores}), 0) < 2 then 0.5e0 when lines > 10 then least(greatest(0e0, 1e0 - 2e0 * {_spread}) * 1.1e0, 1e0) else greatest(0e0, 1e0 - 2e0 * {_spread}) end",
    ),
    "generate_refinement_suggestions(confidence double, consistency double, lines long)": (
        "string",
        _issue_list(("improve_speaker_detection", "confidence < 0.7e0"), ("review_speaker_attribution", "consistency < 0.8e0"), ("verify_speaker_presence", "lines < 3"), ("consider_speaker_splitting", "lines > 50")),
    ),
}


def register(spark: SparkSession) -> None:
    """Scores, types and validators as SQL functions, which Catalyst takes in; splitting, attribution and ratios as pandas functions."""
    body = VALIDATORS | {
        "calculate_quality_score(text string, speaker string)": ("double", quality.segment_score("text", "speaker")),
        "segment_quality_score(text string, speaker string)": ("double", quality.orchestrated_score("text", "speaker")),
        "segment_type(text string, speaker string)": ("string", quality.segment_type("text", "speaker")),
        "dialogue_confidence(text string)": ("double", quality.dialogue_confidence("text")),
        "quality_band(score double)": ("string", quality.band("score")),
        "calculate_avg_confidence(scores string)": ("double", "coalesce(aggregate(from_json(scores, 'array<double>'), 0e0, (a, x) -> a + x) / nullif(size(from_json(scores, 'array<double>')), 0), 0e0)"),
    }
    for signature, (kind, fragment) in body.items():
        spark.sql(f"create or replace temporary function {signature} returns {kind} return {_sql(fragment)}")
    from folio.operators.sequential import _split

    spark.udf.register("segment_text", _split(splitting.split_segment))
    spark.udf.register("attribute_speakers", cascade.attributed())
    spark.udf.register("fuzzy_ratio", fuzzy.scorer(fuzzy.ratio))
    spark.udf.register("token_set_ratio", fuzzy.scorer(fuzzy.token_set_ratio))
