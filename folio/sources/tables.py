"""Views over the tables: what the operators of dialogue, requests and lines start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.plans.sql import full_text, view

#: Lines of documents, numbered from 1.
view(
    "lines",
    "select doc_id, cast(pos + 1 as bigint) as line_no, line from {documents} lateral view posexplode(split(text, '\n')) as pos, line",
    "select doc_id, cast(unnest(range(1, len(string_split(text, '\n')) + 1)) as bigint) as line_no, unnest(string_split(text, '\n')) as line from {documents}",
)

#: Conversations in the four forms that dialogue takes: script line, quotation with a tag, narrative, thought.
view(
    "utterances",
    """
select conv_id, turn, role, speaker,
  case turn % 4 when 0 then upper(role) || ': ' || body
    when 1 then '"' || body || '," ' || speaker || ' said.'
    when 2 then body
    else speaker || ' thought about it. ' || body end as text
from (select conv_id, turn, role, upper(substring(role, 1, 1)) || substring(role, 2) as speaker,
    case when conv_id % 2 = 0 then split_part(text, '.', 1) || '.' else text end as body
  from {conversations}) t""",
)

view("names", "select distinct speaker as name from {utterances}")

#: Utterances as attributed segments; narrative lines are the narrator's, some thoughts nobody's.
view(
    "segments",
    """
select conv_id, turn, role, cast(conv_id as $string) || '-' || cast(turn as $string) as segment_id,
  case when turn % 4 = 2 then 'narrator' when conv_id % 5 = 0 and turn % 4 = 3 then 'AMBIGUOUS'
    when conv_id % 11 = 0 and turn % 4 = 1 then 'UNFIXABLE' else speaker end as speaker,
  text, case turn % 4 when 0 then 0.95e0 when 1 then 0.9e0 when 2 then 0.85e0 else 0.6e0 end as confidence
from {utterances}""",
)

#: Requests to language models, one for each event; k is the number in the event's properties.
view(
    "requests",
    """
select event_id as request_id, ts, user_id % 7 as instance_id, user_id % 6 as model_id, value / 100e0 as response_time,
  k as tokens, event_type <> 'error' as success, event_type as job_type,
  case when user_id % 6 >= 4 then k / 1000e0 * 0.002e0 else 0e0 end as cost
from (select *, cast(regexp_extract(props, '"k": *(-?[0-9]+)', 1) as bigint) as k from {events}) t""",
)

#: The six models, their tiers and figures.
MODELS = [
    (0, "gpt-oss:20b", "local", "fast", "highest", 32768, 0.0, 1800, 0.97, "complex_reasoning,speaker_attribution,dialogue_analysis,chain_of_thought,agentic_tasks"),
    (1, "deepseek-v2:16b", "local", "fast", "high", 32768, 0.0, 1500, 0.95, "complex_reasoning,coding,analysis"),
    (2, "llama3:8b", "local", "fast", "medium", 8192, 0.0, 800, 0.92, "general_chat,simple_reasoning"),
    (3, "mistral:7b", "local", "medium", "medium", 32768, 0.0, 1200, 0.90, "classification,extraction"),
    (4, "gemini-1.0-pro", "gcp", "medium", "high", 30720, 0.002, 2000, 0.98, "complex_reasoning,analysis,creative_writing"),
    (5, "gemini-1.5-flash", "gcp", "fast", "medium", 1000000, 0.0005, 800, 0.96, "simple_classification,batch_processing"),
]
_rows = ", ".join(
    f"({i}, '{name}', '{engine}', '{speed}', '{quality}', {context}, {cost}e0, {ms}, {rel}e0, '{cases}')" for i, name, engine, speed, quality, context, cost, ms, rel, cases in MODELS
)
view(
    "models",
    f"""
select cast(model_id as bigint) as model_id, model_name, engine, speed_tier, quality_tier, cast(context as bigint) as context, rate,
  ms / 1000e0 as usual_time, reliability, use_cases, true as gives_json,
  coalesce(case speed_tier when 'slow' then 0.3e0 when 'medium' then 0.6e0 when 'fast' then 0.9e0 end, 0.6e0) as speed_score,
  coalesce(case quality_tier when 'basic' then 0.4e0 when 'medium' then 0.7e0 when 'high' then 1e0 end, 0.7e0) as quality_score
from (values {_rows}) as t(model_id, model_name, engine, speed_tier, quality_tier, context, rate, ms, reliability, use_cases)""",
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or a view by name."""
    text, needed = full_text("select * from {" + name + "}", 0)
    return spark.sql(text, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in needed})
