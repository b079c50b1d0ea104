"""Events, messages and jobs: rates, histograms, alerts, sessions, status, completion, validation."""

from __future__ import annotations

from folio.functions.fragments import share
from folio.operators import text  # noqa: F401  its views are named here
from folio.plans.sql import Catalogue, view

C = Catalogue()

MINUTE = 60_000_000


def floor_to(ts: str, minutes: int) -> str:
    """Microseconds of the start of the window that holds a time."""
    return f"cast(floor({ts} / {minutes * MINUTE}e0) as bigint) * {minutes * MINUTE}"


view("timed", "select *, unix_micros(cast(ts as timestamp)) as us from {events}", "select *, epoch_us(ts) as us from {events}")
C.add(
    "rate_5m",
    f"select event_type, {floor_to('us', 5)} as start_us, count(*) as events, count(*) / 300e0 as per_second from {{timed}} group by event_type, {floor_to('us', 5)}",
)
_slid = "select event_type, start_us, count(*) as events, count(*) / 300e0 as per_second from (select event_type, {start} as start_us from {{timed}} {view}) t group by event_type, start_us"
C.add(
    "sliding_rate",
    _slid.format(start=f"{floor_to('us', 1)} - back * {MINUTE}", view="lateral view explode(array(0, 1, 2, 3, 4)) as back"),
    _slid.format(start=f"{floor_to('us', 1)} - unnest([0, 1, 2, 3, 4]) * {MINUTE}", view=""),
    doc="Windows of five minutes, one a minute: an event is in five of them.",
)
#: Minutes of the windows that rates are asked for.
WINDOWS = [1, 5, 10, 60]
C.add(
    "rates",
    " union all ".join(
        f"select event_type, {w} as minutes, {floor_to('us', w)} as start_us, count(*) as events, count(*) / {w * 60}e0 as per_second from {{timed}} group by event_type, {floor_to('us', w)}" for w in WINDOWS
    ),
    doc="Rates over one, five and ten minutes and an hour, in tumbling windows.",
)
#: Bounds of the buckets of processing times, in seconds.
BOUNDS = [0.1, 0.5, 1, 2.5, 5, 10, 30, 60, 300]
view(
    "histogram",
    "select instance_id, bound, sum(n) over (partition by instance_id order by bound) as below, sum(n) over (partition by instance_id) as total from ("
    + "select instance_id, bound, count(*) as n from (select instance_id, case "
    + " ".join(f"when t <= {b}e0 then {b}e0" for b in map(float, BOUNDS))
    + " else 1e9 end as bound from (select instance_id, response_time * 10e0 as t from {requests}) a) b group by instance_id, bound) c",
)
C.add("response_histogram", "select instance_id, bound, cast(below as bigint) as below, cast(total as bigint) as total from {histogram}")
C.add(
    "hist_quantile",
    """
with q as (select instance_id, bound, below, total, coalesce(lag(bound) over (partition by instance_id order by bound), 0e0) as lower_bound, coalesce(lag(below) over (partition by instance_id order by bound), 0) as under from {histogram}),
f as (select *, row_number() over (partition by instance_id order by bound) as place from q where below >= 0.95e0 * total)
select instance_id, round(case when bound >= 1e9 then lower_bound else lower_bound + (bound - lower_bound) * (0.95e0 * total - under) / (below - under) end, 9) as p95 from f where place = 1""",
    doc="Linear within the bucket that holds the quantile, as of cumulative counts.",
)
_window = floor_to("us", 60)
view("hourly", f"select event_type, {_window} as start_us, count(*) as n, sum(value) as total, avg(value) as mean from {{timed}} group by event_type, {_window}")
view(
    "failure_ratio",
    f"select user_id % 7 as instance_id, {_window} as start_us, count(*) as n, {share('''sum(case when event_type = 'error' then 1 else 0 end)''', 'count(*)')} as ratio from {{timed}} group by user_id % 7, {_window}",
)
C.add(
    "failure_ratio_alerts",
    "select instance_id, start_us, n, round(ratio, 9) as ratio, ratio > 0.1e0 as processing, ratio > 0.2e0 as job, ratio > 0.3e0 as accuracy from {failure_ratio} where ratio > 0.1e0",
)
C.add(
    "sustained_alerts",
    f"""
with m as (select *, row_number() over (partition by instance_id order by start_us) - row_number() over (partition by instance_id, ratio > 0.2e0 order by start_us) as island from {{failure_ratio}})
select instance_id, min(start_us) as from_us, max(start_us) + {60 * MINUTE} as to_us, count(*) as windows from m where ratio > 0.2e0 group by instance_id, island having count(*) >= 3""",
    doc="A condition that holds for three windows in a row or more: islands of true.",
)
#: Alerts as (name, group, metric, comparison, threshold, seconds it must hold, severity).
RULES = [
    ("SystemUnhealthy", "system", "health_status", "=", 0.0, 120, "critical"),
    ("HighErrorRate", "system", "processing_failure_ratio", ">", 0.1, 300, "warning"),
    ("ProcessingQueueBuildup", "system", "queue_size", ">", 100.0, 600, "warning"),
    ("ServiceDown", "system", "up", "=", 0.0, 60, "critical"),
    ("SparkJobFailureRate", "spark", "job_failure_ratio", ">", 0.2, 300, "warning"),
    ("SparkJobTooLong", "spark", "job_seconds_p95", ">", 1800.0, 0, "warning"),
    ("SparkExecutorFailure", "spark", "executor_rate", "<", -0.1, 120, "critical"),
    ("SparkHighMemoryUsage", "spark", "spark_memory_bytes", ">", 8589934592.0, 300, "warning"),
    ("KafkaConsumerLag", "kafka", "consumer_lag", ">", 1000.0, 300, "warning"),
    ("KafkaProducerFailures", "kafka", "producer_failure_rate", ">", 0.01, 120, "critical"),
    ("KafkaMessageRateDrop", "kafka", "message_rate", "<", 0.1, 600, "warning"),
    ("KafkaPartitionImbalance", "kafka", "lag_spread", ">", 500.0, 900, "warning"),
    ("LLMHighFailureRate", "llm", "llm_failure_ratio", ">", 0.1, 180, "warning"),
    ("LLMSlowResponse", "llm", "llm_seconds_p95", ">", 30.0, 300, "warning"),
    ("LLMPoolExhaustion", "llm", "pool_utilization", ">", 90.0, 300, "critical"),
    ("LLMInstanceDown", "llm", "active_instances", "=", 0.0, 60, "critical"),
    ("LowQualityScore", "quality", "quality_score", "<", 80.0, 600, "warning"),
    ("HighValidationErrorRate", "quality", "validation_error_rate", ">", 0.05, 300, "warning"),
    ("ProcessingAccuracyDrop", "quality", "ambiguous_ratio", ">", 0.3, 1800, "warning"),
    ("AirflowDAGFailures", "airflow", "dag_failure_rate", ">", 0.01, 300, "critical"),
    ("AirflowLongRunningTask", "airflow", "task_seconds_p95", ">", 3600.0, 0, "warning"),
    ("AirflowTaskQueueBuildup", "airflow", "active_tasks", ">", 50.0, 900, "warning"),
    ("HighCPUUsage", "resources", "cpu_percent", ">", 80.0, 600, "warning"),
    ("HighMemoryUsage", "resources", "memory_bytes", ">", 17179869184.0, 600, "warning"),
    ("DiskSpaceWarning", "resources", "disk_bytes", ">", 53687091200.0, 1800, "warning"),
    ("DiskSpaceCritical", "resources", "disk_bytes", ">", 85899345920.0, 300, "critical"),
]
view(
    "alert_rules",
    "select alert, rule_group, metric, comparison, threshold, cast(seconds as bigint) as seconds, severity from (values "
    + ", ".join(f"('{n}', '{g}', '{m}', '{c}', {t!r}e0, {s}, '{v}')" for n, g, m, c, t, s, v in RULES)
    + ") as t(alert, rule_group, metric, comparison, threshold, seconds, severity)",
)
#: Samples of a metric at a time, a quarter of an hour apart, as the events give them.
view(
    "samples",
    f"""
with w as (select {floor_to('us', 15)} as at_us, count(*) as n, sum(case when event_type = 'error' then 1 else 0 end) * 1e0 / count(*) as errors, avg(value) as mean, max(value) as most, count(distinct user_id) as users
  from {{timed}} group by {floor_to('us', 15)})
select 'processing_failure_ratio' as metric, at_us, errors as sample from w union all select 'job_failure_ratio', at_us, errors from w union all select 'llm_failure_ratio', at_us, errors from w
union all select 'quality_score', at_us, 100e0 - mean from w union all select 'cpu_percent', at_us, most from w union all select 'pool_utilization', at_us, most from w
union all select 'message_rate', at_us, n / 900e0 from w union all select 'active_instances', at_us, cast(users as double) - 1e0 from w union all select 'queue_size', at_us, cast(n as double) from w""",
)
view(
    "breaches",
    """
select alert, severity, seconds, s.metric, at_us, sample, case comparison when '>' then sample > threshold when '<' then sample < threshold else sample = threshold end as true_now
from {samples} s join {alert_rules} r on s.metric = r.metric""",
)
C.add(
    "alert_rules_fired",
    """
with i as (select *, row_number() over (partition by alert order by at_us) - row_number() over (partition by alert, true_now order by at_us) as island from {breaches})
select alert, max(severity) as severity, min(at_us) as from_us, max(at_us) as to_us, count(*) as samples, max(at_us) - min(at_us) >= max(seconds) * 1000000 as fired from i where true_now group by alert, island""",
    doc="Every rule against the samples of its metric: the islands where its condition is true, and whether one held for as long as the rule asks.",
)
C.add("alert_rule_list", "select alert, rule_group, metric, comparison, threshold, seconds, severity from {alert_rules}", doc="The twenty-six rules.")
C.add(
    "metric_aggregates",
    "select event_type, count(*) as n, round(avg(value), 8) as mean, round(stddev_pop(value), 6) as spread, round(stddev_samp(value), 6) as sample_spread, min(value) as least, max(value) as most, median(value) as middle from {events} group by event_type",
)
C.add(
    "session_windows",
    """
with g as (select user_id, us, case when us - lag(us) over (partition by user_id order by us, event_id) < 300000000 then 0 else 1 end as new_session, event_id from {timed}),
s as (select user_id, us, sum(new_session) over (partition by user_id order by us, event_id) as session from g)
select user_id, min(us) as start_us, max(us) + 300000000 as end_us, count(*) as events, max(us) - min(us) >= 3600000000 as over_age from s group by user_id, session""",
    doc="Gaps of 300 seconds end a session: the batch twin of a session window.",
)
C.add(
    "late_events",
    f"""
select {_window} as start_us, count(*) as events, cast(sum(case when seen - us > {60 * MINUTE} then 1 else 0 end) as bigint) as late
from (select us, max(us) over (partition by user_id order by event_id rows between unbounded preceding and current row) as seen from {{timed}}) t group by {_window}""",
    doc="Events over an hour behind the latest one of their user so far: what a watermark of an hour drops.",
)
C.add("job_latest_status", "select user_id as job_id, max_by(event_type, us * 4096 + event_id % 4096) as status, max(us) as at_us, count(*) as updates from {timed} group by user_id", "select user_id as job_id, arg_max(event_type, us * 4096 + event_id % 4096) as status, max(us) as at_us, count(*) as updates from {timed} group by user_id")
C.add(
    "job_status_upsert",
    "select job_id, status, at_us from (select user_id as job_id, event_type as status, us as at_us, row_number() over (partition by user_id order by us desc, event_id desc) as place from {timed}) t where place = 1",
    doc="The one table of jobs: later rows replace earlier ones by key.",
)
C.add(
    "job_completion",
    """
with c as (select conv_id, count(distinct turn) as seen, max(turn) + 1 as expected from {conversations} group by conv_id)
select conv_id, seen, expected, seen = expected as complete, round(100e0 * seen / expected, 9) as progress from c""",
    doc="A job is complete when every index below its total was seen.",
)
#: Topics by kind of message.
TOPICS = {
    "file_upload": "text-extraction-requests",
    "text_extracted": "text-extraction-results",
    "processing_request": "processing-requests",
    "chunk_processing": "chunk-processing",
    "llm_request": "llm-classification",
    "validation_result": "validation-results",
    "processing_complete": "processing-complete",
    "error": "error-handling",
    "status_update": "processing-status",
    "metrics": "metrics",
}
view("topics", "select * from (values " + ", ".join(f"('{k}', '{t}')" for k, t in TOPICS.items()) + ") as t(kind, topic)")
view(
    "messages",
    """
select event_id, cast(user_id as $string) as job_id, us, case event_type when 'error' then 'error' when 'purchase' then 'processing_request' when 'click' then 'chunk_processing' when 'view' then 'status_update' else event_type end as kind,
  case when event_id % 17 = 0 then '' else props end as body from {timed}""",
)
C.add(
    "message_validate_route",
    """
select m.event_id, m.kind, coalesce(t.topic, 'error-handling') as topic, trim(m.body) <> '' and m.job_id is not null and (m.kind <> 'chunk_processing' or contains(m.body, '"k"')) as valid
from {messages} m left join {topics} t on m.kind = t.kind""",
)
C.add(
    "message_dead_letters",
    "select kind, count(*) as messages, cast(sum(case when trim(body) = '' then 1 else 0 end) as bigint) as dead, cast(sum(case when trim(body) = '' then least(event_id % 5, 3) else 0 end) as bigint) as retries from {messages} group by kind",
)
C.add(
    "chunk_submission",
    "select doc_id % 50 as job_id, count(*) as chunks, cast(sum(n_lines) as bigint) as lines, max(doc_id % 10) as priority, round(avg(n_lines), 9) as mean_lines, round(100e0 * sum(case when doc_id % 3 = 0 then 1 else 0 end) / count(*), 9) as progress from {doc_lines} group by doc_id % 50",
)
C.add("sinks_output_summary", "select conv_id as job_id, count(*) as total_segments, count(distinct speaker) as unique_speakers from {segments} where trim(text) <> '' group by conv_id")
#: Seconds that cached results live, by kind.
TTL = {"llm": 7200, "embedding": 86400, "segment": 3600, "quality": 1800, "analysis": 3600}
view("lifetimes", "select kind, cast(seconds as bigint) as seconds from (values " + ", ".join(f"('{k}', {s})" for k, s in TTL.items()) + ") as t(kind, seconds)")
C.add(
    "cache_live",
    """
with e as (select event_id, us, case user_id % 5 when 0 then 'llm' when 1 then 'embedding' when 2 then 'segment' when 3 then 'quality' else 'analysis' end as kind from {timed})
select e.kind, count(*) as entries, cast(sum(case when e.us + l.seconds * 1000000 > (select max(us) from {timed}) then 1 else 0 end) as bigint) as live from e join lifetimes_ l on e.kind = l.kind group by e.kind""".replace("lifetimes_", "{lifetimes}"),
)
C.add(
    "health_rollup",
    """
with i as (select user_id % 7 as component, sum(case when event_type = 'error' then 1 else 0 end) * 1e0 / count(*) as errors from {events} group by user_id % 7)
select case when sum(case when errors > 0.5e0 then 1 else 0 end) > 0 then 'unhealthy' when sum(case when errors > 0.15e0 then 1 else 0 end) > 0 then 'degraded' else 'healthy' end as status, count(*) as components from i""",
)
QUERIES, ORACLES = C.queries, C.oracles
