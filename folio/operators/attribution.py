"""Speakers of lines: rules, dictionaries, context, turn-taking, profiles, responses, prompts."""

from __future__ import annotations

from folio.functions.fragments import META, any_of, hits, likely_dialogue, marked
from folio.operators.quality import dialogue_confidence
from folio.operators.text import SPACE
from folio.plans.sql import Catalogue, view

C = Catalogue()

NAME = "[A-Z][a-z]+(?: [A-Z][a-z]+)*"
TAGS = "said|asked|replied|answered|whispered|shouted|exclaimed|muttered|cried|called|added|continued"
THINK = "thought|wondered|realized|remembered|considered|decided|knew|felt|believed"
#: Words that start stage directions, or are held by them (as substrings), in texts without marks.
STAGE = ["enter ", "exit", "exeunt", "aside", "curtain", "prologue", "epilogue", "kneels", "sheathes", "the end"]
#: Verbs of interaction, and words that start a line and are no names.
INTERACTION = ["said", "replied", "asked", "whispered", "shouted", "told", "responded", "answered", "continued", "added", "called", "yelled", "muttered", "exclaimed"]
NOT_NAMES = "('Chapter', 'The', 'This', 'That', 'Title', 'Author', 'Note', 'Narrator')"


def found(text: str, pattern: str) -> str:
    """The pattern's first group, null where it does not match."""
    return f"nullif(regexp_extract({text}, '{pattern}', 1), '')"


view(
    "name_marks",
    f"""
select conv_id, turn, speaker as truth, trim(text) as text,
  {found("trim(text)", "^([A-Z][A-Za-z0-9_]*): ")} as script_name, {found("trim(text)", f"({NAME}) (?:{TAGS})")} as tag_name,
  {found("trim(text)", f"({NAME}) (?:turned|looked|glanced|stepped|moved|walked|paused|hesitated|waited)")} as action_name,
  {found("trim(text)", f"({NAME}) (?:{THINK})")} as thought_name, {found("trim(text)", f"({NAME}).s (?:voice|words|response|reply|answer|question)")} as possessive_name,
  {likely_dialogue("text")} as talk, {hits("lower(text)", INTERACTION)} as interaction, {any_of("lower(text)", STAGE)} and not {any_of("text", ['"', "'", ":", "?", "!"])} as stage
from {{utterances}}""",
)
_names = "(select lower(name) as low, name from {names}) "
view(
    "attributed",
    f"""
select conv_id, turn, truth, text, r.rule, case r.rule when 'stage' then 'narrator' when 'script' then r.script when 'tag' then r.tag when 'action' then r.action when 'thought' then r.thought
    when 'possessive' then r.possessive when 'dialogue' then 'AMBIGUOUS' else 'narrator' end as speaker,
  case r.rule when 'stage' then 0.95e0 when 'script' then case when script_known then 1e0 else least(1e0, 0.8e0 + 0.2e0) end when 'tag' then case when tag_known then 0.9e0 else 0.7e0 end
    when 'action' then case when action_known then 0.85e0 else 0.65e0 end when 'thought' then case when thought_known then 0.8e0 else 0.6e0 end when 'possessive' then 0.75e0
    when 'dialogue' then 0.3e0 when 'narrative' then 0.85e0 else 0.6e0 end as confidence
from (select m.*, coalesce(n1.name, script_name) as script, coalesce(n2.name, tag_name) as tag, coalesce(n3.name, action_name) as action, coalesce(n4.name, thought_name) as thought, n5.name as possessive,
    n1.name is not null as script_known, n2.name is not null as tag_known, n3.name is not null as action_known, n4.name is not null as thought_known,
    case when stage then 'stage' when script_name is not null and script_name not in {NOT_NAMES} then 'script' when tag_name is not null and tag_name not in {NOT_NAMES} then 'tag'
      when talk and action_name is not null and action_name not in {NOT_NAMES} then 'action' when thought_name is not null and thought_name not in {NOT_NAMES} then 'thought'
      when n5.name is not null then 'possessive' when talk then 'dialogue' when length(text) <= 200 and interaction < 2 then 'narrative' else 'other' end as rule
  from {{name_marks}} m left join {_names} n1 on lower(script_name) = n1.low left join {_names} n2 on lower(tag_name) = n2.low left join {_names} n3 on lower(action_name) = n3.low
    left join {_names} n4 on lower(thought_name) = n4.low left join {_names} n5 on lower(possessive_name) = n5.low) r""",
)
C.add(
    "rule_attribution",
    "select conv_id, turn, speaker, confidence, rule, case when confidence >= 0.8e0 then 'ATTRIBUTED' else 'PENDING_AI' end as status from {attributed}",
    doc="The rules in their order, the first that fits wins; names are looked up by equality in a table of distinct names.",
)
C.add(
    "pending_split",
    """
select rule, count(*) as lines, cast(sum(case when confidence >= 0.8e0 then 1 else 0 end) as bigint) as attributed, cast(sum(case when confidence < 0.8e0 or speaker = 'AMBIGUOUS' then 1 else 0 end) as bigint) as for_scorer,
  cast(sum(case when lower(speaker) = lower(truth) then 1 else 0 end) as bigint) as right_speaker from {attributed} group by rule""",
)
C.add("known_speaker_semi", "select conv_id, turn, role from {utterances} u where exists (select 1 from {names} n where lower(n.name) = lower(nullif(regexp_extract(u.text, '([A-Z][a-z]+) said', 1), '')))")
C.add("unknown_speaker_anti", "select conv_id, turn, role from {utterances} u where not exists (select 1 from {names} n where lower(n.name) = lower(nullif(regexp_extract(u.text, '([A-Z][a-z]+) said', 1), '')))")
view("answers", "select conv_id, turn, 'User' as answer from {attributed} where confidence < 0.8e0 and turn % 3 = 0")
C.add(
    "validation_overlay_left",
    "select a.conv_id, a.turn, coalesce(b.answer, a.speaker) as speaker, b.answer is not null as replaced, case when a.confidence < 0.8e0 and b.answer is null then 'AMBIGUOUS' else 'ATTRIBUTED' end as status from {attributed} a left join {answers} b on a.conv_id = b.conv_id and a.turn = b.turn",
    doc="Answers overlay pending lines by id; pending lines without one survive as AMBIGUOUS.",
)
C.add(
    "neighbor_majority",
    f"""
with n as (select a.conv_id, a.turn, b.speaker, count(*) as n from {{segments}} a join {{segments}} b on a.conv_id = b.conv_id and b.turn between a.turn - 3 and a.turn + 3 and b.turn <> a.turn
  where a.speaker in ('AMBIGUOUS', 'UNFIXABLE') and b.speaker not in ('AMBIGUOUS', 'UNFIXABLE', 'narrator') group by a.conv_id, a.turn, b.speaker)
select conv_id, turn, speaker, n from (select *, row_number() over (partition by conv_id, turn order by n desc, speaker) as place from n) t where place = 1""",
    doc="Within a conversation, so the join is by its id; ties by name.",
)
C.add(
    "rolling_context_asof",
    f"""
select conv_id, turn, last_value(case when speaker not in {META} then speaker end$lastnulls over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as last_speaker from {{segments}}""",
    doc="The last known speaker before a line, as of that line.",
)
C.add(
    "dedupe_islands",
    """
with i as (select doc_id, line_no, trim(line) as line, sum(case when trim(line) = before then 0 else 1 end) over (partition by doc_id order by line_no) as island
  from (select doc_id, line_no, line, trim(lag(line) over (partition by doc_id order by line_no)) as before from {lines} where trim(line) <> '') t)
select doc_id, min(line_no) as line_no, max(md5(line)) as digest, count(*) as merged_count from i group by doc_id, island""",
    doc="Runs of equal lines to one row each.",
)
C.add("line_dedupe", "select doc_id, digest, min(line_no) as line_no, count(*) as copies from (select doc_id, line_no, md5(line) as digest from {lines} where trim(line) <> '') t group by doc_id, digest")
C.add(
    "context_window5",
    """
select conv_id, turn, array_join(collect_list(speaker) over w, '|') as flow, count(*) over w as lines, coalesce(sum(length(text)) over w, 0) as chars from {segments} window w as (partition by conv_id order by turn rows between 5 preceding and 1 preceding)""",
    """
select conv_id, turn, coalesce(array_to_string(list(speaker) over w, '|'), '') as flow, count(*) over w as lines, cast(coalesce(sum(length(text)) over w, 0) as bigint) as chars from {segments} window w as (partition by conv_id order by turn rows between 5 preceding and 1 preceding)""",
)
view(
    "turns",
    f"""
select conv_id, turn, speaker, {marked("text")} as strong, lag(speaker, 1) over w as s1, lag(speaker, 2) over w as s2, lag(speaker, 3) over w as s3 from {{segments}} where speaker not in ('UNFIXABLE') window w as (partition by conv_id order by turn)""",
)
C.add(
    "turn_taking",
    """
select conv_id, turn, case when s1 <> s2 and (s2 <> 'narrator') = strong then s2 when s1 is not null and s2 <> s1 and (s2 <> 'narrator') = strong then s2 when s3 <> s1 and (s3 <> 'narrator') = strong then s3 end as expected, speaker from {turns}""",
    doc="After two different speakers the first of them is expected, else the latest other one; names need marks of dialogue, the narrator their absence.",
)
view(
    "refined",
    f"""
select s.conv_id, s.turn, s.speaker as before, coalesce(case when s.speaker not in ('AMBIGUOUS', 'UNFIXABLE') then s.speaker end, nullif(n.name, ''), t.expected,
    case when s.confidence_of_dialogue < 0.3e0 then 'narrator' end, case when s.speaker = 'UNFIXABLE' then 'narrator' else s.speaker end) as speaker,
  case when s.speaker not in ('AMBIGUOUS', 'UNFIXABLE') then 'kept' when n.name is not null then 'explicit' when t.expected is not null then 'turn_taking' when s.confidence_of_dialogue < 0.3e0 then 'narrative' when s.speaker = 'UNFIXABLE' then 'fallback' else 'none' end as strategy
from (select *, {dialogue_confidence("text")} as confidence_of_dialogue, {found("text", f"({NAME}) (?:{TAGS}|{THINK})")} as named from {{segments}}) s
left join {{names}} n on s.named = n.name
left join (select conv_id, turn, case when s1 <> s2 and s2 not in {META} then s2 when s3 <> s1 and s3 not in {META} then s3 end as expected from {{turns}}) t on s.conv_id = t.conv_id and s.turn = t.turn""",
)
C.add("refine_ambiguous", "select conv_id, turn, before, speaker, strategy from {refined}", doc="One round on a snapshot of the context; the strategies in their order.")
C.add("recover_unfixable", "select strategy, before, count(*) as lines from {refined} where before in ('AMBIGUOUS', 'UNFIXABLE') group by strategy, before")
C.add(
    "speaker_top_words",
    """
with w as (select speaker, explode(regexp_extract_all(lower(text), '[a-z]+', 0)) as word from {segments}), c as (select speaker, word, count(*) as n from w where length(word) > 3 group by speaker, word)
select speaker, word, n, cast(place as bigint) as place from (select *, row_number() over (partition by speaker order by n desc, word) as place from c) t where place <= 10""",
    """
with w as (select speaker, unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from {segments}), c as (select speaker, word, count(*) as n from w where length(word) > 3 group by speaker, word)
select speaker, word, n, place from (select *, row_number() over (partition by speaker order by n desc, word) as place from c) t where place <= 10""",
)
#: Patterns of names of characters, with their confidences.
CANDIDATES = [
    (f"({NAME}) (?:{TAGS})", 0.9),
    ("^([A-Z]+): ", 0.95),
    ("(?:Mr|Mrs|Miss|Dr)[.] ([A-Z][a-z]+)", 0.85),
    (f"({NAME}).s ", 0.7),
    (f"({NAME}) (?:{THINK})", 0.6),
]
_candidates = """
select upper(substring(name, 1, 1)) || lower(substring(name, 2)) as name, max(confidence) as confidence, count(*) as appearances from (FOUND) e
where name is not null group by upper(substring(name, 1, 1)) || lower(substring(name, 2)) having max(confidence) >= 0.5e0 and count(*) >= 2"""
_structs = ", ".join(f"named_struct('name', {found('text', p)}, 'confidence', {c}e0)" for p, c in CANDIDATES)
C.add(
    "character_candidates",
    _candidates.replace("FOUND", f"select inline(array({_structs})) from {{utterances}}"),
    _candidates.replace("FOUND", " union all ".join(f"select {found('text', p)} as name, {c}e0 as confidence from {{utterances}}" for p, c in CANDIDATES)),
    doc="All patterns in one pass over the lines.",
)
C.add(
    "name_set_ops",
    """
select 'both' as part, name from (select name from {names} intersect select distinct speaker from {segments}) a
union all select 'attributed_only', speaker from (select distinct speaker from {segments} except select name from {names}) b
union all select 'any', name from (select name from {names} union select speaker from {segments}) c""",
)
_prompt = """
select doc_id, window_index, cast(length(prompt) as bigint) as chars, md5(prompt) as digest from (
  select doc_id, cast(w as bigint) as window_index, 'Name the speaker of each of these ' || cast(count(*) as $string) || ' lines, as a JSON array:' || chr(10) || LINES as prompt from {window_lines} group by doc_id, w) t"""
C.add(
    "prompt_build",
    _prompt.replace("LINES", "array_join(transform(array_sort(collect_list(struct(place, line))), x -> concat(cast(x.place as string), '. ', x.line)), chr(10))"),
    _prompt.replace("LINES", "array_to_string(list(cast(place as varchar) || '. ' || line order by place), chr(10))"),
)
#: Words that the key of a point of view is made of.
POV_WORDS = 2000
C.add(
    "cache_keys",
    f"""
select doc_id, substring($sha(n$bits), 1, 16) as line_key, substring($sha('batch|' || n || '|User,Assistant'$bits), 1, 16) as batch_key,
  substring($sha('pov|' || $join($slice($split(n, ' '), 1, {POV_WORDS}), ' ')$bits), 1, 16) as pov_key
from (select doc_id, trim(regexp_replace(text, '{SPACE}', ' '$g)) as n from {{documents}}) t""",
)
view(
    "responses",
    """
select event_id, event_id % 4 as kind, case event_id % 4 when 0 then '["User", "Assistant"]' when 1 then chr(123) || '"speakers": ["User", "unknown"]' || chr(125)
  when 2 then 'User: yes' || chr(10) || '# note' || chr(10) || 'Assistant' else 'FINAL ANSWER: ["User"]' end as response, 2 as expected from {events}""",
)
_parsed = """
with l as (select event_id, kind, expected, case when kind = 2 then array_join(transform(filter(split(response, chr(10)), x -> x <> '' and not startswith(x, '#')), x -> trim(split_part(x, ':', 1))), '|')
    else array_join(transform(regexp_extract_all(regexp_extract(response, '$lb([^$rb]*)$rb', 1), '"([^"]*)"', 1), x -> case when lower(x) in ('unknown', 'unclear', '') then 'AMBIGUOUS' else x end), '|') end as found from {responses})"""
_finish = """
select event_id, found || case when length(found) = 0 then 'AMBIGUOUS|AMBIGUOUS' when length(found) - length(replace(found, '|', '')) + 1 < expected then '|AMBIGUOUS' else '' end as speakers, found = '' as empty from l"""
C.add(
    "llm_response_parse",
    _parsed + _finish,
    _parsed.replace("array_join(transform(filter(split(response, chr(10)), x -> x <> '' and not startswith(x, '#')), x -> ", "array_to_string(list_transform(list_filter(string_split(response, chr(10)), lambda x: x <> '' and not starts_with(x, '#')), lambda x: ").replace(
        "array_join(transform(regexp_extract_all(", "array_to_string(list_transform(regexp_extract_all("
    ).replace("1), x -> case", "1), lambda x: case")
    + _finish,
    doc="Arrays, objects with speakers, or lines; too few are filled up with AMBIGUOUS, as unclear ones are replaced.",
)
C.add(
    "json_properties",
    """select event_id, cast(regexp_extract(props, '"k": *(-?[0-9]+)', 1) as bigint) as k, cast(get_json_object(props, '$$.k') as bigint) as parsed from {events}""",
    """select event_id, cast(regexp_extract(props, '"k": *(-?[0-9]+)', 1) as bigint) as k, cast(json_extract_string(props, '$$.k') as bigint) as parsed from {events}""",
)
QUERIES, ORACLES = C.queries, C.oracles
