"""Quality of segments, speakers, conversations: scores, issues, refinement, reports, gates."""

from __future__ import annotations

from folio.functions.fragments import META, any_of, clamp, dialogue, marked, n_words, share, word
from folio.plans.sql import Catalogue, view

C = Catalogue()

def segment_score(text: str, speaker: str) -> str:
    """Score of a segment by length and speaker, from 0.8."""
    return f"""least(1e0, 0.8e0 * case when length({text}) < 10 then 0.5e0 when length({text}) > 1000 then 0.9e0 else 1e0 end
    * case {speaker} when 'AMBIGUOUS' then 0.6e0 when 'narrator' then 1.1e0 else 1e0 end)"""


def orchestrated_score(text: str, speaker: str) -> str:
    """Score of a segment by trimmed length, speaker and marks, from 0.7."""
    size = f"length(trim({text}))"
    return f"""least(1e0, 0.7e0 * case when {size} < 10 then 0.5e0 when {size} > 500 then 0.9e0 when {size} > 100 then 1.1e0 else 1e0 end
    * case when {speaker} = 'AMBIGUOUS' then 0.6e0 when {speaker} in ('narrator', 'unknown') then 1e0 else 1.1e0 end
    * case when {marked(text)} then 1.05e0 else 1e0 end)"""


def segment_type(text: str, speaker: str) -> str:
    return f"case when {speaker} = 'narrator' then 'narrative' when {marked(text)} then 'dialogue' when {speaker} = 'AMBIGUOUS' then 'ambiguous' else 'mixed' end"


view(
    "scored",
    f"""
select *, {segment_score("text", "speaker")} as segment_quality, {orchestrated_score("text", "speaker")} as quality,
  {segment_type("text", "speaker")} as segment_type from {{segments}}""",
)

C.add("segment_quality", "select segment_id, speaker, segment_quality, quality, segment_type from {scored}")

#: Issues as flags, in the order in which they are listed.
ISSUES = {
    "segment_too_short": "length(trim(text)) < 10",
    "segment_too_long": "length(text) > 1000",
    "low_quality_score": "quality < 0.5e0",
    "missing_dialogue_markers": f"segment_type = 'dialogue' and not {marked('text')}",
    "unexpected_dialogue_in_narrative": f"segment_type = 'narrative' and {any_of('text', ['\"', chr(39)])}",
}
_listed = " || ".join(f"case when {name} then '{name};' else '' end" for name in ISSUES)

view(
    "validated",
    f"""
select *, {_listed} as issues, segment_too_short or segment_too_long or low_quality_score or missing_dialogue_markers or unexpected_dialogue_in_narrative as any_issue,
  missing_dialogue_markers as refinement_applied,
  case when segment_too_short or segment_too_long or low_quality_score or missing_dialogue_markers or unexpected_dialogue_in_narrative or length(text) <= 50
    then (case when low_quality_score then greatest(stepped * 0.5e0, 0.1e0) else stepped end) * case when missing_dialogue_markers then 0.6e0 else 1e0 end
    else least(quality * 1.1e0, 1e0) end as refined_quality,
  trim(regexp_replace(case when missing_dialogue_markers then '"' || text || '"' else text end, '[ \t\n\r]+', ' '$g)) as refined_text
from (select *, quality * case when segment_too_short then 0.7e0 else 1e0 end * case when segment_too_long then 0.8e0 else 1e0 end as stepped
  from (select *, {", ".join(f"{test} as {name}" for name, test in ISSUES.items())} from {{scored}}) a) b""",
)

C.add("segment_validation", "select segment_id, quality, issues, refinement_applied, refined_quality, refined_text from {validated}")

#: Patterns of inner life and of description that lower the confidence. Classes are spelled out, as
#: the two dialects read ``\\s`` and ``\\w`` differently.
INTERNAL = [
    r"(he|she|they|it)[ \t\n]+(thought|wondered|considered|realized|remembered|knew|felt|understood)",
    r"(his|her|their|its)[ \t\n]+(thoughts?|mind|memory|feelings?)",
    r"was[ \t\n]+(thinking|wondering|considering)",
    r"it[ \t\n]+(wasn.t|was|seemed|appeared)",
]
NARRATIVE = [
    r"(the|a|an)[ \t\n]+[A-Za-z0-9_]+[ \t\n]+(was|were|had|did|could|would|should)",
    r"(there|here)[ \t\n]+(was|were|had)",
    r"(it|this|that)[ \t\n]+(was|were|had|seemed|appeared)",
]
SPEECH = "said|asked|replied|answered|whispered|shouted|exclaimed|muttered|cried|thought|wondered"


def dialogue_confidence(text: str) -> str:
    """0 to 1: quotation marks, dashes, script form and verbs of speech less thought and description."""
    start = "(?i)(^|[^A-Za-z0-9_])"
    less = [f"- case when $rlike({text}, '{start}{p}') then 0.3e0 else 0e0 end" for p in INTERNAL]
    less += [f"- case when $rlike({text}, '{start}{p}') then 0.2e0 else 0e0 end" for p in NARRATIVE]
    score = f"""(case when contains({text}, '"') then 0.8e0 else 0e0 end + case when {any_of(text, ["—", "–"])} then 0.4e0 else 0e0 end
    + case when $ends(trim({text}), ':') or $starts(trim({text}), '"') then 0.3e0 else 0e0 end
    + case when $rlike({text}, '(?i){word(SPEECH)}') then 0.2e0 else 0e0 end {" ".join(less)})"""
    return f"case when trim(coalesce({text}, '')) = '' then 0e0 else {clamp(score)} end"


C.add("dialogue_confidence", f"select segment_id, {dialogue_confidence('text')} as confidence from {{segments}}")

view(
    "speakers",
    f"""
select speaker, count(*) as segments, avg(length(text)) as avg_length, cast(sum({n_words("text")}) as bigint) as words,
  cast(sum(case when {marked("text")} or speaker not in {META} then 1 else 0 end) as bigint) as dialogue_segments,
  avg(confidence) as avg_confidence, $stddev(confidence) as spread, count(confidence) as n
from {{segments}} where speaker not in {META} group by speaker""",
)
C.add("speaker_profile", "select speaker, segments, avg_length, words, dialogue_segments, avg_confidence from {speakers}")

view(
    "speaker_scores",
    """
select *, case when n < 2 then 0.5e0 when dialogue_segments > 10 then least(greatest(0e0, 1e0 - 2e0 * round(spread, 9)) * 1.1e0, 1e0)
  else greatest(0e0, 1e0 - 2e0 * round(spread, 9)) end as consistency from {speakers}""",
)
C.add(
    "speaker_consistency",
    """
select speaker, round(avg_confidence, 9) as avg_confidence, round(consistency, 8) as consistency,
  case when avg_confidence < 0.7e0 then 'improve_speaker_detection;' else '' end || case when consistency < 0.8e0 then 'review_speaker_attribution;' else '' end
  || case when dialogue_segments < 3 then 'verify_speaker_presence;' else '' end || case when dialogue_segments > 50 then 'consider_speaker_splitting;' else '' end as suggestions
from {speaker_scores}""",
    doc="Population deviation of confidences; suggestions in a fixed order.",
)

C.add(
    "speaker_quality",
    """
select speaker, segment_type, count(*) as segments, round(avg(segment_quality), 9) as avg_quality, round(avg(refined_quality), 9) as avg_refined,
  cast(sum(case when any_issue then 1 else 0 end) as bigint) as with_issues
from {validated} group by speaker, segment_type""",
    doc="The flagship: types, scores, issues and refined scores by speaker.",
)

C.add(
    "quality_report",
    """
with s as (select count(*) as total_segments, avg(quality) as original, avg(refined_quality) as refined,
    cast(sum(case when refinement_applied then 1 else 0 end) as bigint) as refinements,
    cast(sum(case when refined_quality < 0.6e0 then 1 else 0 end) as bigint) as low from {validated}),
p as (select count(*) as total_speakers, avg(avg_confidence) as confidence, avg(consistency) as consistency,
    cast(sum(case when consistency < 0.8e0 then 1 else 0 end) as bigint) as uneven, cast(sum(case when avg_confidence < 0.7e0 then 1 else 0 end) as bigint) as to_review from {speaker_scores})
select total_segments, total_speakers, refinements, round(original, 9) as average_original, round(refined, 9) as average_refined,
  round(coalesce((refined - original) / nullif(original, 0e0) * 100e0, 0e0), 6) as improvement_percentage,
  round(confidence, 9) as average_confidence, round(consistency, 8) as average_consistency, to_review as speakers_needing_review,
  case when low > total_segments * 0.1e0 then 'reprocess;' else '' end || case when uneven > 0 then 'review_speakers;' else '' end
  || case when refinements > total_segments * 0.3e0 then 'improve_initial_processing;' else '' end as recommendations
from s join p on 1 = 1""",
    doc="One row; the join is of two single rows.",
)

#: Penalties by type of error.
PENALTIES = {
    "missing_speaker": 8.0,
    "missing_text": 10.0,
    "empty_text": 5.0,
    "dialogue_as_narrator": 3.0,
    "narrative_as_dialogue": 3.0,
    "unknown_speaker": 2.0,
    "very_long_dialogue": 1.0,
    "consecutive_same_speaker": 0.5,
    "too_many_single_use_speakers": 5.0,
}
view("penalties", f"select * from (values {', '.join(f'({chr(39)}{k}{chr(39)}, {v}e0)' for k, v in PENALTIES.items())}) as t(type, penalty)")

THOUGHT = "thought|wondered|felt|remembered|realized|knew|believed"
view(
    "flagged",
    f"""
select conv_id, turn, segment_id, speaker, text, coalesce(trim(speaker), '') = '' as missing_speaker,
  coalesce(trim(speaker), '') <> '' and coalesce(text, '') = '' as missing_text,
  talk and speaker = 'narrator' as dialogue_as_narrator,
  not talk and speaker not in ('narrator', 'AMBIGUOUS') and not $rlike(lower(text), '{THOUGHT}') as narrative_as_dialogue,
  talk and speaker not in ('narrator', 'AMBIGUOUS') and not known and not $rlike(speaker, '^[A-Z][a-z]+( [A-Z][a-z]+)*$$') as unknown_speaker,
  talk and length(trim(text)) > 500 as very_long_dialogue,
  talk and coalesce(speaker = prev_speaker and prev_talk and length(trim(text)) < 100 and prev_length < 100, false) and speaker not in ('narrator', 'AMBIGUOUS') as consecutive_same_speaker
from (select s.*, {dialogue("s.text")} as talk, n.name is not null as known,
    lag(s.speaker) over w as prev_speaker, lag({dialogue("s.text")}) over w as prev_talk, lag(length(trim(s.text))) over w as prev_length
  from {{segments}} s left join {{names}} n on s.speaker = n.name window w as (partition by s.conv_id order by s.turn)) t""",
)
ROW_ERRORS = ["missing_speaker", "missing_text", "dialogue_as_narrator", "narrative_as_dialogue", "unknown_speaker", "very_long_dialogue", "consecutive_same_speaker"]
C.add("validator_errors", f"select segment_id, {' || '.join(f'case when {e} then {chr(39)}{e};{chr(39)} else {chr(39)}{chr(39)} end' for e in ROW_ERRORS)} as errors from {{flagged}}")
C.add("consecutive_same_speaker", "select segment_id, consecutive_same_speaker from {flagged}")

_any = ", ".join(f"max(case when {e} then 1 else 0 end) as {e}" for e in ROW_ERRORS)
_list = " || ".join(f"case when {e} = 1 then '{e};' else '' end" for e in ROW_ERRORS)
C.add(
    "segment_dedupe",
    f"""
with s as (select f.*, s.confidence, case when f.text = lag(f.text) over (partition by f.conv_id order by f.turn) then 0 else 1 end as new_text from {{flagged}} f join {{segments}} s on f.conv_id = s.conv_id and f.turn = s.turn),
i as (select *, sum(new_text) over (partition by conv_id order by turn) as island from s),
g as (select conv_id, min(turn) as turn, max(text) as text, $argmin(speaker, turn) as speaker, max(confidence) as confidence, count(*) as merged_count, {_any} from i group by conv_id, island)
select conv_id, turn, text, speaker, confidence, merged_count, {_list} as errors from g""",
    doc="Neighbouring segments of one text as one: the first speaker, the highest confidence, the errors of all.",
)

view("row_errors", " union all ".join(f"select conv_id, '{e}' as type from {{flagged}} where {e}" for e in ROW_ERRORS))
view(
    "single_use",
    """
select conv_id, 'too_many_single_use_speakers' as type from (
  select conv_id, speaker, count(*) as n from {segments} where speaker not in ('narrator', 'AMBIGUOUS') group by conv_id, speaker) t
group by conv_id having sum(case when n = 1 then 1 else 0 end) > (select count(*) from {names}) * 0.5e0""",
)
view("all_errors", "select * from {row_errors} union all select * from {single_use}")
C.add(
    "error_summary",
    "select e.type, count(*) as errors, coalesce(max(p.penalty), 1e0) as penalty, count(*) * coalesce(max(p.penalty), 1e0) as total from {all_errors} e left join {penalties} p on e.type = p.type group by e.type",
)
C.add("single_use_speakers", "select conv_id, type from {single_use}")


def band(score: str) -> str:
    return f"case when {score} >= 95 then 'Excellent' when {score} >= 80 then 'Good' when {score} >= 60 then 'Fair' when {score} >= 30 then 'Poor' else 'Critical' end"


view(
    "document_scores",
    f"""
with s as (select conv_id, count(*) as n, sum(case when speaker not in ('AMBIGUOUS', 'UNFIXABLE') then 1 else 0 end) * 1e0 as attributed,
    sum(case when speaker = 'AMBIGUOUS' then 1 else 0 end) * 1e0 as ambiguous, sum(case when speaker = 'UNFIXABLE' then 1 else 0 end) * 1e0 as unfixable
  from {{segments}} group by conv_id),
e as (select conv_id, count(*) as errors, sum(coalesce(p.penalty, 1e0)) as penalty from {{all_errors}} x left join {{penalties}} p on x.type = p.type group by conv_id)
select s.conv_id, n, coalesce(errors, 0) as errors, attributed, ambiguous, unfixable,
  {clamp('''attributed / n * 100e0 * (1e0 - least(1e0, coalesce(errors, 0) * 1e0 / n * 2e0)) - ambiguous / n * 30e0 - unfixable / n * 50e0
    - least(coalesce(penalty, 0e0) * case when coalesce(errors, 0) * 1e0 / n > 0.5e0 then 1e0 + (errors * 1e0 / n - 0.5e0) else 1e0 end, 60e0)''', "0e0", "100e0")} as score
from s left join e on s.conv_id = e.conv_id""",
)
C.add("document_quality_score", f"select conv_id, n, errors, round(score, 9) as score, {band('score')} as band from {{document_scores}}")
C.add(
    "attribution_metrics",
    "select count(*) as segments, cast(sum(attributed) as bigint) as attributed, cast(sum(ambiguous) as bigint) as ambiguous, cast(sum(unfixable) as bigint) as unfixable, round(avg(score), 8) as mean_score from {document_scores} where n > 0",
)

C.add(
    "speaker_transitions",
    f"""
with t as (select conv_id, role, length(text) as size, coalesce(role <> lag(role) over (partition by conv_id order by turn), false) as moved from {{conversations}})
select conv_id, count(*) as segments, count(distinct role) as speakers, cast(sum(case when moved then 1 else 0 end) as bigint) as transitions,
  cast(sum(size) as bigint) as total_length, 100e0 * (1e0 - {share("sum(case when moved then 1 else 0 end)", "count(*)")}) as score from t group by conv_id""",
)
view(
    "conversation_quality",
    f"""
select conv_id, count(*) as segments,
  0.4e0 * 100e0 * {share("sum(case when speaker not in ('AMBIGUOUS', 'UNFIXABLE') then 1 else 0 end)", "count(*)")}
  + 0.4e0 * 100e0 * {share("sum(case when confidence > 0.8e0 then 1 else 0 end)", "count(*)")} + 0.2e0 * (100e0 - 100e0 * {share("sum(case when speaker = 'UNFIXABLE' then 1 else 0 end)", "count(*)")}) as attribution,
  {clamp("100e0 - 2e0 * 100e0 * " + share("sum(case when trim(coalesce(text, '')) = '' or coalesce(speaker, '') = '' then 1 else 0 end)", "count(*)") + " - 0.5e0 * 100e0 * " + share("sum(case when length(text) < 10 or length(text) > 1000 then 1 else 0 end)", "count(*)"), "0e0", "100e0")} as structural,
  100e0 * {share("sum(case when speaker = 'UNFIXABLE' then 1 else 0 end)", "count(*)")} as error_rate, 100e0 * avg(confidence) as confidence
from {{segments}} group by conv_id""",
)
C.add("attribution_quality", "select conv_id, segments, round(attribution, 9) as attribution from {conversation_quality}")
C.add("structural_quality", "select conv_id, segments, round(structural, 9) as structural from {conversation_quality}")
C.add(
    "threshold_check",
    """
select conv_id, attribution >= 95e0 as overall_passed, structural >= 90e0 as consistency_passed, confidence >= 85e0 as confidence_passed, error_rate <= 5e0 as errors_passed,
  attribution >= 95e0 and structural >= 90e0 and confidence >= 85e0 and error_rate <= 5e0 as all_passed
from (select conv_id, round(attribution, 6) as attribution, round(structural, 6) as structural, round(confidence, 6) as confidence, round(error_rate, 6) as error_rate from {conversation_quality}) t""",
)
C.add(
    "batch_quality",
    """
select batch, count(*) as conversations, round(avg(attribution), 8) as attribution, round(avg(structural), 8) as structural
from (select conv_id % 7 as batch, attribution, structural from {conversation_quality} where segments > 1) t group by batch""",
    doc="Two levels: conversations, then batches of them.",
)

QUERIES, ORACLES = C.queries, C.oracles
