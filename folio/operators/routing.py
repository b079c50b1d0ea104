"""Requests to models: metrics, rankings, budgets, health, characteristics, routing, timeouts."""

from __future__ import annotations

from folio.functions.fragments import any_of, clamp, hits, n_words, share
from folio.operators.text import count_of
from folio.plans.sql import Catalogue, view

C = Catalogue()

view(
    "model_metrics",
    f"""
select r.model_id, count(*) as requests, cast(sum(case when success then 1 else 0 end) as bigint) as successes, {share("sum(case when success then 1 else 0 end)", "count(*)")} as success_rate,
  coalesce(avg(case when success then response_time end), 0e0) as avg_time, sum(cost) as total_cost, sum(cost) / count(*) as avg_cost,
  cast(sum(tokens) as bigint) as tokens, coalesce(sum(tokens) / nullif(sum(case when success then response_time else 0e0 end), 0e0), 0e0) as tokens_per_second
from {{requests}} r group by r.model_id""",
)
C.add(
    "model_dimension",
    """
select r.request_id, r.model_id, coalesce(m.model_name, 'unknown') as model_name, coalesce(m.engine, 'local') as engine, coalesce(m.speed_score, 0.6e0) as speed_score, coalesce(m.quality_score, 0.7e0) as quality_score,
  case when coalesce(m.engine, 'local') = 'local' then 0e0 else (r.tokens + 0.5e0 * r.tokens) / 1000e0 * m.rate end as estimated_cost
from {requests} r left join {models} m on r.model_id = m.model_id""",
    doc="Capabilities by a left join on a dimension of six rows, with defaults for models it lacks.",
)
C.add(
    "request_metrics",
    "select model_id, requests, successes, round(success_rate, 9) as success_rate, round(avg_time, 9) as avg_time, round(avg_cost, 9) as avg_cost, tokens, round(tokens_per_second, 6) as tokens_per_second from {model_metrics}",
)
C.add(
    "request_metrics_sets",
    f"""
select model_id, instance_id, cast(grouping(instance_id) as bigint) as level, count(*) as requests, round({share("sum(case when success then 1 else 0 end)", "count(*)")}, 9) as success_rate, round(avg(response_time), 9) as avg_time
from {{requests}} group by grouping sets ((model_id, instance_id), (model_id), ())""",
)
C.add(
    "request_metrics_rollup",
    """
select model_id, cast(date_trunc('month', ts) as $ntz) as month, cast(date_trunc('day', ts) as $ntz) as day, cast(date_trunc('hour', ts) as $ntz) as hour, count(*) as requests, round(sum(cost), 9) as cost
from {requests} group by rollup (model_id, date_trunc('month', ts), date_trunc('day', ts), date_trunc('hour', ts))""",
    doc="Cost by hour, day, month and model, and in all, in one pass.",
)
C.add("request_cube", "select model_id, job_type, count(*) as requests, cast(sum(tokens) as bigint) as tokens from {requests} group by cube (model_id, job_type)")
view("recent", "select * from (select *, row_number() over (partition by model_id order by ts desc, request_id desc) as age from {requests} where success) t where age <= 100")
C.add(
    "latency_percentiles_last100",
    """
with o as (select model_id, response_time, row_number() over (partition by model_id order by response_time, request_id) - 1 as place, count(*) over (partition by model_id) as n from {recent})
select model_id, max(case when place = floor(n * 0.5e0) then response_time end) as p50, max(case when place = floor(n * 0.95e0) then response_time end) as p95, max(case when place = floor(n * 0.99e0) then response_time end) as p99 from o group by model_id""",
    doc="The value at place floor(n * p) of the last hundred, sorted.",
)
C.add(
    "running_latency",
    """
select request_id, instance_id, avg(cast(round(response_time * 1000000e0) as bigint)) over (partition by instance_id, date_trunc('day', ts) order by ts, request_id rows between unbounded preceding and current row) as mean_so_far_us,
  avg(cast(round(response_time * 1000000e0) as bigint)) over (partition by instance_id, date_trunc('day', ts) order by ts, request_id rows between 99 preceding and current row) as mean_of_100_us from {requests}""",
    doc="By instance and day, so that no frame spans an instance's whole history.",
)
C.add(
    "model_rankings",
    """
with r as (select *, row_number() over (order by avg_time, model_id) as fastest, row_number() over (order by success_rate desc, model_id) as most_reliable,
    row_number() over (order by avg_cost, model_id) as cheapest, row_number() over (order by tokens_per_second desc, model_id) as busiest from {model_metrics})
select model_id, cast(fastest as bigint) as fastest, cast(most_reliable as bigint) as most_reliable, cast(cheapest as bigint) as cheapest, cast(busiest as bigint) as busiest from r
where fastest <= 3 or most_reliable <= 3 or cheapest <= 3 or busiest <= 3""",
    doc="Ranks of one row a model; the aggregate below is the size of the dimension.",
)
C.add(
    "cheaper_alternatives",
    """
select a.model_id, b.model_id as alternative, b.avg_cost < a.avg_cost * 0.5e0 as cheaper, b.avg_time < a.avg_time * 0.7e0 as faster
from {model_metrics} a join {model_metrics} b on a.model_id <> b.model_id and b.success_rate >= a.success_rate * 0.9e0 and (b.avg_cost < a.avg_cost * 0.5e0 or b.avg_time < a.avg_time * 0.7e0)""",
    doc="A join of two aggregates of one row a model.",
)
#: A day's budget in dollars, and the shares of it that warn and that are critical.
BUDGET, WARNING, CRITICAL = 50.0, 0.7, 0.9


def budget_sql(budget: float = BUDGET) -> str:
    return f"""
select day, round(cost, 9) as cost, case when cost >= {budget}e0 * {CRITICAL}e0 then 'critical' when cost >= {budget}e0 * {WARNING}e0 then 'warning' else 'ok' end as level, round(cost / {budget}e0, 9) as used
from (select date_trunc('day', ts) as day, round(sum(cost), 12) as cost from {{requests}} group by date_trunc('day', ts)) t"""


C.add("budget_alerts", budget_sql(0.005), doc="With a budget of 0.005, as the requests of the tables cost little; ``budget_sql`` takes any.")
C.add("budget_alerts_usual", budget_sql(), doc="With the usual budget of a day.")
C.add(
    "instance_means",
    """
select r.instance_id, count(*) as requests, round(avg((tokens + 0.5e0 * tokens) / greatest(0.1e0, response_time)), 6) as tokens_per_second, round(avg(cast(tokens as double)), 6) as input_tokens,
  round(avg(0.5e0 * tokens), 6) as output_tokens, round(avg(tokens * 1e0 / coalesce(m.context, 8192)), 9) as context_used,
  round(avg(case when coalesce(m.rate, 0e0) > 0e0 then (tokens + 0.5e0 * tokens) / greatest(0.1e0, response_time) / m.rate else 1e0 end), 4) as cost_efficiency
from {requests} r left join {models} m on r.model_id = m.model_id group by r.instance_id""",
    doc="A running mean ends as the mean; an answer is taken as half as long as its request.",
)
C.add(
    "recent_averages",
    """
with t as (select *, row_number() over (partition by job_type order by ts desc, request_id desc) as age, max(ts) over (partition by job_type) as latest from {requests})
select job_type, cast(sum(case when ts > latest - interval 1 hour then 1 else 0 end) as bigint) as of_hour, round(avg(case when ts > latest - interval 1 hour then response_time end), 9) as mean_of_hour,
  round(avg(case when age <= 10 then response_time end), 9) as mean_of_ten from t group by job_type""",
    doc="Over the last hour and the last ten requests of each kind of job.",
)
C.add(
    "benchmark_statistics",
    """
with o as (select model_id, response_time, row_number() over (partition by model_id order by response_time, request_id) - 1 as place, count(*) over (partition by model_id) as n from {requests} where success)
select model_id, max(n) as n, round(avg(response_time), 8) as mean, median(response_time) as middle, max(case when place = floor(n * 0.95e0) then response_time end) as p95,
  max(case when place = floor(n * 0.99e0) then response_time end) as p99, round(stddev_samp(response_time), 8) as spread, round(stddev_samp(response_time) / sqrt(max(n)), 8) as standard_error from o group by model_id""",
    doc="Percentiles are the values at place floor(n * p); the spread is that of a sample.",
)
view(
    "advice",
    """
select 'cost' as kind, case when avg_cost * requests * 0.5e0 > 1e0 then 'high' else 'medium' end as priority, model_id, avg_cost * requests * 0.5e0 as gain from {model_metrics} a
  where requests >= 10 and avg_cost > 0.00001e0 and exists (select 1 from {model_metrics} b where b.avg_cost < a.avg_cost * 0.5e0 and b.success_rate >= a.success_rate * 0.9e0)
union all select 'performance', case when (a.avg_time - c.best) * a.requests > 300e0 then 'high' else 'medium' end, a.model_id, (a.avg_time - c.best) * a.requests from {model_metrics} a
  join (select x.model_id, min(y.avg_time) as best from {model_metrics} x join {model_metrics} y on y.avg_time < x.avg_time * 0.99e0 and y.success_rate >= x.success_rate * 0.9e0 group by x.model_id) c on a.model_id = c.model_id
  where a.avg_time > 0.1e0 and a.requests > 50
union all select 'scaling', 'high', model_id, 50e0 from {model_metrics} where requests >= 10 and 1e0 - success_rate > 0.1e0
union all select 'routing', 'low', model_id, 10e0 from {model_metrics} where success_rate > 0.7e0 and requests < 0.166e0 * (select sum(requests) from {model_metrics})""",
)
C.add("optimisation_recommendations", "select kind, priority, model_id, round(gain, 6) as gain from {advice}")
C.add(
    "system_health",
    f"""
select round((success + speed + thrift) / 3e0, 9) as score, round(success, 9) as success, round(speed, 9) as speed, round(thrift, 9) as thrift, case when success < 0.5e0 then 'unhealthy' when success < 0.9e0 then 'degraded' else 'healthy' end as status
from (select sum(successes) * 1e0 / sum(requests) as success, {clamp("(5e0 - avg(avg_time)) / 5e0")} as speed, {clamp("(0.01e0 - sum(total_cost) / sum(requests)) / 0.01e0")} as thrift from {{model_metrics}}) t""",
)
C.add(
    "pool_status",
    """
select instance_id, count(*) as requests, count(distinct model_id) as models, min(response_time) as fastest, max(response_time) as slowest, cast(sum(case when success then 0 else 1 end) as bigint) as failed,
  case when sum(case when success then 1 else 0 end) >= 0.79e0 * count(*) then 'healthy' else 'degraded' end as status from {requests} group by instance_id""",
)

#: Words that tell what a prompt asks for; the first family that fits counts.
COMPLEXITY = {
    "batch": ["analyze", "process", "multiple", "list", "batch", "all"],
    "complex": ["reason", "explain", "analyze", "compare", "evaluate", "synthesize"],
    "medium": ["classify", "categorize", "identify", "extract", "summarize"],
}
USE_CASES = {
    "classification": ["classify", "categorize", "label", "tag"],
    "extraction": ["extract", "find", "identify", "locate"],
    "analysis": ["analyze", "examine", "evaluate", "assess"],
    "generation": ["generate", "create", "write", "compose"],
    "translation": ["translate", "convert", "transform"],
    "summarization": ["summarize", "condense", "abstract"],
    "question_answering": ["what", "why", "how", "when", "where"],
    "coding": ["code", "function", "class", "method", "algorithm"],
    "creative_writing": ["story", "poem", "creative", "fiction"],
}
CONTENT = {"code": ["code", "function", "class", "def ", "import"], "creative": ["story", "poem", "creative", "fiction"], "analytical": ["analyze", "evaluate", "research"], "data": ["data", "table", "csv", "json"]}


def first_family(text: str, families: dict[str, list[str]], otherwise: str) -> str:
    return "case " + " ".join(f"when {any_of(text, words)} then '{name}'" for name, words in families.items()) + f" else '{otherwise}' end"


ENGLISH = "the|and|is|in|to|of|a|that|it|with|for|as|was|on|are|you"
view(
    "characteristics",
    f"""
select doc_id, case when size > 20000 or n > 4000 then 'heavy' when size > 10000 or n > 2000 or {hits("low", COMPLEXITY["batch"])} > 1 then 'batch'
    when size > 2000 or n > 400 or {any_of("low", COMPLEXITY["complex"])} then 'complex' when size > 500 or n > 100 or {any_of("low", COMPLEXITY["medium"])} then 'medium' else 'simple' end as complexity,
  greatest(cast(floor(size / 4e0) as bigint), n) as tokens, {first_family("low", USE_CASES, "general")} as use_case, {first_family("low", CONTENT, "text")} as content_type,
  case when doc_id % 10 >= 8 then 'critical' when doc_id % 10 >= 5 then 'high' when doc_id % 10 >= 2 then 'medium' else 'low' end as urgency, {any_of("low", ["json", "javascript object notation", '{"', '[{'])} as needs_json,
  {share(count_of(f"regexp_replace(' ' || low || ' ', '[^a-z0-9_]+', '  '$g)", f" ({ENGLISH}) "), "n")} > 0.1e0 as english, case when doc_id % 3 = 0 then 'basic' when doc_id % 3 = 1 then 'medium' else 'high' end as quality_needed, size
from (select doc_id, lower(text) as low, cast(length(text) as bigint) as size, cast({n_words("text")} as bigint) as n from {{documents}}) t""",
)
C.add("request_complexity", "select doc_id, complexity, tokens, use_case, content_type, urgency, needs_json, english from {characteristics}")

#: Weights of the scores by strategy.
WEIGHTS = {
    "speed_first": dict(speed=0.4, capacity=0.2, health=0.15, quality=0.1, cost=0.05, use_case=0.05, suitability=0.025, json=0.025),
    "quality_first": dict(quality=0.4, health=0.2, use_case=0.15, suitability=0.1, speed=0.05, capacity=0.05, cost=0.025, json=0.025),
    "cost_first": dict(cost=0.5, health=0.2, capacity=0.1, speed=0.1, quality=0.05, use_case=0.025, suitability=0.02, json=0.005),
    "balanced": dict(health=0.2, suitability=0.15, use_case=0.15, quality=0.15, speed=0.1, cost=0.1, capacity=0.1, json=0.05),
}
SCORES = ["health", "suitability", "use_case", "cost", "quality", "speed", "capacity", "json"]
#: The strategy that follows the load: the balanced weights, and these times as much where the pool is over BUSY full.
ADAPTIVE, BUSY = {"capacity": 2.0, "health": 1.5}, 0.8
STRATEGIES = [*WEIGHTS, "adaptive"]


def weighed(strategy: str, of: str = "") -> str:
    """The weighed sum of the scores; ``of`` names the offer that they are of."""
    own = WEIGHTS.get(strategy, WEIGHTS["balanced"])
    boost = lambda s: f" * case when {of}busy then {ADAPTIVE[s]}e0 else 1e0 end" if strategy == "adaptive" and s in ADAPTIVE else ""
    return "least(1e0, " + " + ".join(f"{of}{s}_score * ({own[s]}e0{boost(s)})" for s in SCORES) + ")"


view(
    "instances",
    f"""
select m.*, coalesce(t.load, 0e0) as load, avg(coalesce(t.load, 0e0)) over () > {BUSY}e0 as busy, case when coalesce(t.requests, 0) = 0 then 0.5e0 when m.rate > 0e0 then least(1e0, t.tokens_per_second / m.rate) else 1e0 end as thrift,
  case when coalesce(t.requests, 0) = 0 then m.reliability else
    0.3e0 * t.success_rate + 0.25e0 * (1e0 - t.load) + 0.25e0 * least(1e0, 1e0 / greatest(0.1e0, t.avg_time)) + 0.2e0 * ((m.speed_score + m.quality_score + m.reliability) / 3e0) end as health
from {{models}} m left join (select *, (requests % 8) / 10e0 as load from {{model_metrics}}) t on m.model_id = t.model_id""",
)


def _offer(i: str, c: str) -> dict[str, str]:
    """The scores of instance ``i`` for request ``c``."""
    return {
        "health": f"{i}.health",
        "suitability": f"0.7e0 * {i}.health + 0.3e0 * {i}.thrift",
        "use_case": f"case when contains({i}.use_cases, {c}use_case) then 1e0 else 0.5e0 end",
        "cost": f"case when {i}.engine = 'local' then 1e0 else greatest(0e0, 1e0 - least(1e0, {c}tokens * 1.5e0 / 1000e0 * {i}.rate / 0.01e0)) end",
        "quality": f"case {c}quality_needed when 'basic' then least({i}.quality_score * 1.2e0, 1e0) when 'high' then case when {i}.quality_score < 0.8e0 then {i}.quality_score * 0.8e0 else {i}.quality_score end else {i}.quality_score end",
        "speed": f"case {c}urgency when 'critical' then {i}.speed_score * 1.5e0 when 'high' then {i}.speed_score * 1.2e0 when 'low' then least({i}.speed_score * 0.8e0, 1e0) else {i}.speed_score end",
        "capacity": f"1e0 - {i}.load",
        "json": f"case when {c}needs_json and not {i}.gives_json then 0.3e0 else 1e0 end",
    }


_offers = f"select c.doc_id, c.complexity, i.model_id, i.busy, {', '.join(f'{x} as {s}_score' for s, x in _offer('i', 'c.').items())} from {{characteristics}} c join {{instances}} i on i.context >= c.tokens"
_routed = " union all ".join(f"select doc_id, complexity, model_id, '{s}' as strategy, round({weighed(s)}, 9) as score from ({_offers}) o" for s in STRATEGIES)
#: On Spark: a request's offers are an array, made from the pool, which is one row, and so are the best of each
#: strategy; no row moves.
_scored = ", ".join(f"'{s}_score', {x}" for s, x in _offer("i", "").items())
_best = ", ".join(
    f"named_struct('strategy', '{s}', 'best', array_sort(transform(offers, o -> named_struct('less', -round({weighed(s, 'o.')}, 9), 'model_id', o.model_id))))" for s in STRATEGIES
)
view(
    "ranked",
    f"""
select doc_id, complexity, inline(array({_best})) from (
  select c.*, transform(filter(pool, i -> i.context >= tokens), i -> named_struct('model_id', i.model_id, 'busy', i.busy, {_scored})) as offers
  from {{characteristics}} c join (select collect_list(struct(*)) as pool from {{instances}}) p on true) t""",
)
view(
    "routed",
    "select doc_id, complexity, strategy, o.model_id, -o.less as score, pos + 1 as place from (select doc_id, complexity, strategy, posexplode(best) as (pos, o) from {ranked}) t",
    f"select *, row_number() over (partition by doc_id, strategy order by score desc, model_id) as place from ({_routed}) t",
)
C.add(
    "route_requests",
    """
select doc_id, strategy, get(best, 0).model_id as chosen, -get(best, 0).less as score, get(best, 1).model_id as fallback1, get(best, 2).model_id as fallback2, get(best, 3).model_id as fallback3
from {ranked} where size(best) > 0""",
    """
select doc_id, strategy, max(case when place = 1 then model_id end) as chosen, max(case when place = 1 then score end) as score, max(case when place = 2 then model_id end) as fallback1, max(case when place = 3 then model_id end) as fallback2, max(case when place = 4 then model_id end) as fallback3
from {routed} where place <= 4 group by doc_id, strategy""",
    doc="Each request against the six instances that can hold it, in one pass over the requests.",
)
C.add(
    "routing_analytics",
    "select strategy, complexity, model_id, count(*) as requests, avg(cast(round(score * 1000000e0) as bigint)) as mean_score_millionths from {routed} where place = 1 group by grouping sets ((strategy, model_id), (strategy, complexity), (strategy))",
)
#: Requests that routing is reported on, and patterns that are listed.
RECENT, PATTERNS = 100, 10
C.add(
    "recent_routing",
    f"""
with r as (select * from {{routed}} where place = 1 and strategy = 'balanced'),
l as (select * from r order by doc_id desc limit {RECENT}),
p as (select c.complexity || '|' || use_case as pattern, count(*) as n from {{characteristics}} c group by c.complexity || '|' || use_case order by n desc, pattern limit {PATTERNS})
select 'model' as kind, cast(model_id as $string) as name, count(*) as requests from l group by model_id
union all select 'complexity', complexity, count(*) from l group by complexity
union all select 'pattern', pattern, n from p""",
    doc="The last hundred requests by model and complexity, and the ten most frequent patterns of all.",
)
C.add(
    "dynamic_timeout",
    f"""
select doc_id, greatest(5e0, least(300e0, 60e0 * case complexity when 'simple' then 0.7e0 when 'medium' then 1e0 when 'complex' then 1.5e0 when 'batch' then 2e0 else 3e0 end
  * case when size > 50000 then 2e0 when size > 10000 then 1.5e0 when size > 1000 then 1.2e0 else 1e0 end
  * case when usual > 48e0 then 1.5e0 when usual > 30e0 then 1.2e0 else 0.9e0 end)) as timeout
from (select *, (select avg(response_time) from {{requests}}) as usual from {{characteristics}}) c""",
)
#: Pools and time limits by complexity.
POOLS = [("simple", "fast", "primary", 30), ("medium", "primary", "fast", 60), ("complex", "primary", "fallback", 120), ("batch", "fast", "primary", 300)]
view("pools", f"select complexity, pool, second_pool, cast(seconds as bigint) as seconds from (values {', '.join(str(p) for p in POOLS)}) as t(complexity, pool, second_pool, seconds)")
C.add("pool_routing", "select c.doc_id, c.complexity, coalesce(p.pool, 'fallback') as pool, coalesce(p.second_pool, 'primary') as second_pool, coalesce(p.seconds, 300) as seconds from {characteristics} c left join {pools} p on c.complexity = p.complexity")

QUERIES, ORACLES = C.queries, C.oracles
