"""Narrators, pronouns, names, cleaning of pages, parsed answers, job and routing reports."""

from __future__ import annotations

from folio.functions.fragments import any_of, hits, marked, share
from folio.operators import events, quality, routing, text  # noqa: F401  their views are named here
from folio.operators.attribution import INTERACTION, NAME, NOT_NAMES, THINK, found
from folio.operators.text import SPACE, tokens
from folio.plans.sql import Catalogue, view

C = Catalogue()

C.add(
    "narrator_discovery",
    f"""
with c as (
  select conv_id, {found("text", f"(?:[Mm]y name is|I am|I.m called|[Cc]all me|I go by) ({NAME})")} as name, 0.9e0 as confidence from {{utterances}}
  union all select conv_id, {found("text", f'"[^"]*[,.]?" ({NAME}) (?:said|replied|asked|thought)')}, 0.7e0 from {{utterances}}
  union all select conv_id, {found("text", f'"({NAME})[,.]? [^"]*"')}, 0.6e0 from {{utterances}}),
n as (select conv_id, name, max(confidence) as confidence, count(*) as hits from c where name is not null and name not in {NOT_NAMES} group by conv_id, name)
select conv_id, name, confidence, hits from (select *, row_number() over (partition by conv_id order by confidence desc, hits desc, name) as place from n) t where place = 1""",
    doc="The best candidate of three kinds of pattern; ties by hits, then name.",
)
MALE, FEMALE, NEUTRAL = "he|him|his|himself", "she|her|hers|herself", "they|them|their|theirs|themselves"
C.add(
    "pronoun_gender",
    f"""
select speaker, cast(sum(m) as bigint) as male, cast(sum(f) as bigint) as female, cast(sum(n) as bigint) as neutral, case when sum(m) > 0 then 'male' when sum(f) > 0 then 'female' when sum(n) > 0 then 'neutral' end as gender
from (select speaker, {tokens("text", MALE)} as m, {tokens("text", FEMALE)} as f, {tokens("text", NEUTRAL)} as n from {{segments}}) t group by speaker""",
    doc="Any male pronoun counts before female ones, and these before neutral ones.",
)
C.add(
    "name_validity",
    f"""
select name, n, length(name) between 2 and 50 and name not in {NOT_NAMES} and not $rlike(name, '[0-9?]') and not {any_of("lower(name)", ["chapter", "contents", "volume", "page"])} as valid
from (select name, count(*) as n from (select {found("text", f"({NAME})")} as name from {{utterances}}) t where name is not null group by name) c""",
)
C.add(
    "alias_normalisation",
    f"""
select distinct speaker as alias, case when {any_of("lower(speaker)", ["assist"])} then 'Assistant' when {any_of("lower(speaker)", ["sys"])} then 'System' else upper(substring(trim(speaker), 1, 1)) || lower(substring(trim(speaker), 2)) end as name,
  $rlike(speaker, '^[A-Z][a-z]+( [A-Z][a-z]+)*$$') as name_like from (select speaker from {{segments}} union all select role from {{segments}} union all select upper(role) || ' (aside)' from {{segments}}) t""",
)
C.add(
    "comment_rules",
    f"""
select conv_id, turn, case when $rlike(text, '(?i)(next chapter|thanks for|please rate|bookmark|first comment)') then 'comment' when $rlike(text, '(?i)(level up|quest|status window|click here)') then 'interface'
    when $rlike(text, '(?i)i (was|am|have|had|felt|thought|knew)') then 'first_person' when $rlike(text, '(?i)({THINK})') then 'monologue' else 'none' end as rule,
  case when $rlike(text, '(?i)(next chapter|thanks for|please rate|bookmark|first comment)') then 0.95e0 when $rlike(text, '(?i)(level up|quest|status window|click here)') then 0.9e0
    when $rlike(text, '(?i)i (was|am|have|had|felt|thought|knew)') then 0.8e0 when $rlike(text, '(?i)({THINK})') then 0.7e0 else 0e0 end as confidence from {{utterances}}""",
    doc="First-person rules have no word boundary, as specified: any word that ends in i fits.",
)
C.add(
    "recent_speakers",
    """
select conv_id, turn, array_join(slice(reverse(filter(collect_list(speaker) over w, x -> x not in ('unknown', 'AMBIGUOUS', 'narrator', 'UNFIXABLE'))), 1, 5), '|') as recent from {segments} window w as (partition by conv_id order by turn rows between 10 preceding and 1 preceding)""",
    """
select conv_id, turn, coalesce(array_to_string(list_slice(list_reverse(list_filter(list(speaker) over w, lambda x: x not in ('unknown', 'AMBIGUOUS', 'narrator', 'UNFIXABLE'))), 1, 5), '|'), '') as recent from {segments} window w as (partition by conv_id order by turn rows between 10 preceding and 1 preceding)""",
    doc="Of the ten lines before, the last five named speakers, latest first.",
)
view(
    "reasoned",
    """
select event_id, 'STEP 1: look at marks. STEP 2: compare. Line 1 confidence: ' || case event_id % 3 when 0 then 'HIGH' when 1 then 'LOW' else 'MEDIUM' end || chr(10) || case when event_id % 5 = 0 then 'no answer'
  else 'FINAL ANSWER: ["User", "Assistant"]' end as answer from {events}""",
)
C.add(
    "reasoning_parse",
    f"""
select event_id, regexp_extract(answer, '(?is)final answer: *($lb[^$rb]*$rb)', 1) as speakers, cast($size($findall(answer, 'STEP [0-9]+'$group0)) as bigint) as steps, regexp_extract(answer, 'confidence: *(HIGH|MEDIUM|LOW)', 1) as confidence,
  round(least(1e0, least($size($findall(answer, 'STEP [0-9]+'$group0)), 5) * 0.1e0 + case when contains(answer, 'FINAL ANSWER') then 0.5e0 else 0e0 end + case when {any_of("lower(answer)", ["because", "compare", "marks"])} then 0.2e0 else 0e0 end), 6) as quality from {{reasoned}}""",
)
view("emotions", "select event_id, case event_id % 4 when 0 then 'not json' when 1 then chr(123) || '\"emotion\": \"joy\", \"pitch\": 1.5' || chr(125) when 2 then chr(123) || '\"speaking_rate\": 0.8' || chr(125) else chr(123) || chr(125) end as answer from {events}")
_emotion = "select event_id, coalesce({label}, 'neutral') as emotion, coalesce(cast({pitch} as double), 0e0) as pitch, coalesce(cast({rate} as double), 1e0) as speaking_rate from {{emotions}}"
C.add(
    "emotion_parse",
    _emotion.format(**{k: f"get_json_object(answer, '$$.{p}')" for k, p in (("label", "emotion"), ("pitch", "pitch"), ("rate", "speaking_rate"))}),
    _emotion.format(**{k: f"case when json_valid(answer) then json_extract_string(answer, '$$.{p}') end" for k, p in (("label", "emotion"), ("pitch", "pitch"), ("rate", "speaking_rate"))}),
)
#: The older penalties by type of error.
OLD = {"missing_speaker": 2.0, "missing_text": 3.0, "empty_text": 1.0, "dialogue_as_narrator": 0.5, "narrative_as_dialogue": 0.5, "unknown_speaker": 0.3, "very_long_dialogue": 0.1, "consecutive_same_speaker": 0.1, "too_many_single_use_speakers": 1.0}
_old = "case type " + " ".join(f"when '{k}' then {v}e0" for k, v in OLD.items()) + " else 0.2e0 end"
C.add(
    "older_quality",
    f"""
with e as (select conv_id, count(*) as errors, round(sum({_old}), 6) as penalty from {{all_errors}} group by conv_id),
s as (select conv_id, count(*) as n, sum(length(text)) as chars, sum(case when trim(text) = '' then 1 else 0 end) * 1e0 / count(*) as hollow from {{segments}} group by conv_id)
select s.conv_id, greatest(0e0, 30e0 - case when coalesce(errors, 0) * 1e0 / n > 0.5e0 then least(coalesce(penalty, 0e0), 15e0) else coalesce(penalty, 0e0) end) as impact,
  greatest(0e0, 10e0 - case when hollow > 0.1e0 then hollow * 20e0 else 0e0 end - case when chars < 100 then 5e0 else 0e0 end) as preservation from s left join e on s.conv_id = e.conv_id""",
)
C.add(
    "routing_optimiser",
    """
with u as (select strategy, model_id, count(*) as n from {routed} where place = 1 group by strategy, model_id)
select strategy, max(n) as most, min(n) as least, max(n) > 3 * min(n) as unbalanced, max(n) - min(n) > 0.3e0 * sum(n) as uneven from u group by strategy""",
    doc="An aggregate of an aggregate.",
)
C.add(
    "job_efficiency",
    f"""
select job_type, count(*) as jobs, round(avg(response_time), 8) as mean_time, {share("sum(case when success then 1 else 0 end)", "count(*)")} as success_rate,
  round(least(1e0, {share("sum(tokens)", "sum(response_time)")} / 100e0), 6) as throughput_score from {{requests}} group by job_type""",
)
C.add("message_pairs", "select job_id, kind, place from (select job_id, 'text_extraction_request' as kind, 1 as place from {messages} union all select job_id, 'status_update', 2 from {messages} where kind <> 'error' union all select job_id, 'error_event', 3 from {messages} where kind = 'error') t group by job_id, kind, place")
C.add(
    "fallback_segments",
    "select doc_id, cast(pos + 1 as bigint) as part_no, 'narrator' as speaker, trim(part) as text from (select doc_id, posexplode(split(text, '\n[ \t]*\n')) as (pos, part) from {documents}) t where trim(part) <> ''",
    "select doc_id, part_no, 'narrator' as speaker, trim(part) as text from (select doc_id, cast(unnest(range(1, len(p) + 1)) as bigint) as part_no, unnest(p) as part from (select doc_id, regexp_split_to_array(text, '\n[ \t]*\n') as p from {documents}) a) t where trim(part) <> ''",
)
C.add(
    "page_cleaners",
    f"""
select page_id, line_no, trim(regexp_replace(regexp_replace(line, '^([0-9]+[.]?|chapter [0-9]+:?) *', ''), '{SPACE}', ' '$g)) as line from {{page_lines}} where length(line) >= 3 and not $rlike(lower(line), '^(copyright|all rights|bookmark|next chapter|previous chapter)')""",
)
C.add(
    "webnovel_lines",
    """
with m as (select doc_id, line_no, line, $rlike(lower(line), '^(chapter|prologue|episode) *[0-9]*') or length(trim(line)) > 60 as story, $rlike(lower(line), '(translator note|next chapter|previous chapter|bookmark|please rate|thanks for reading)') as noise from {lines}),
b as (select doc_id, min(case when story and not noise then line_no end) as first_line, max(case when not noise and trim(line) <> '' then line_no end) as last_line from m group by doc_id)
select m.doc_id, count(*) as kept, min(m.line_no) as first_line, max(m.line_no) as last_line from m join b on m.doc_id = b.doc_id where not noise and trim(line) <> '' and m.line_no between b.first_line and b.last_line group by m.doc_id""",
)
C.add(
    "refinement_candidates",
    f"""
select segment_id, speaker, speaker = 'AMBIGUOUS' or (speaker = 'UNFIXABLE' and {marked("text")}) as candidate, {hits("lower(text)", INTERACTION)} > 0 as interaction from {{segments}}""",
)
C.add(
    "quality_gate",
    """
select band, count(*) as conversations, cast(sum(case when score >= 95e0 then 0 else 1 end) as bigint) as to_refine, round(min(score), 6) as least from (
  select round(score, 6) as score, case when score >= 95 then 'Excellent' when score >= 80 then 'Good' when score >= 60 then 'Fair' when score >= 30 then 'Poor' else 'Critical' end as band from {document_scores}) t group by band""",
)
QUERIES, ORACLES = C.queries, C.oracles
