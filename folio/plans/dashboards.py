"""Alerts as YAML for a rule engine, dashboards as lists of queries, topics as they are set up."""

from __future__ import annotations

import json

from folio.operators.events import RULES, TOPICS

#: Dashboards by the queries that fill their panels.
DASHBOARDS = {
    "overview": ["system_health", "pool_status", "health_rollup"],
    "processing": ["job_completion", "job_latest_status", "chunk_submission"],
    "models": ["request_metrics", "latency_percentiles_last100", "model_rankings", "benchmark_statistics"],
    "costs": ["request_metrics_rollup", "budget_alerts", "cheaper_alternatives"],
    "quality": ["quality_report", "document_quality_score", "error_summary"],
    "streams": ["rates", "session_windows", "late_events", "message_dead_letters"],
    "alerts": ["alert_rules_fired", "failure_ratio_alerts", "sustained_alerts"],
}
#: How topics are set up: parts, copies, and how long messages stay.
PARTITIONS, REPLICAS, RETENTION_MS = 3, 1, 7 * 24 * 3600 * 1000


def alert_yaml() -> str:
    """The alert rules in groups, as rule files have them."""
    lines = ["groups:"]
    for group in dict.fromkeys(r[1] for r in RULES):
        lines += [f"- name: {group}", "  rules:"]
        for name, own, metric, comparison, threshold, seconds, severity in RULES:
            if own == group:
                sign = "==" if comparison == "=" else comparison
                lines += [f"  - alert: {name}", f"    expr: {metric} {sign} {threshold:g}", f"    for: {seconds}s", "    labels:", f"      severity: {severity}"]
    return "\n".join(lines) + "\n"


def dashboard(name: str) -> str:
    """A dashboard as JSON: a panel for each of its queries, two to a row."""
    panels = [{"id": i + 1, "title": q.replace("_", " "), "query": q, "gridPos": {"x": 12 * (i % 2), "y": 8 * (i // 2), "w": 12, "h": 8}} for i, q in enumerate(DASHBOARDS[name])]
    return json.dumps({"title": name, "panels": panels}, indent=2)


def topic_settings(extra: dict[str, dict] | None = None) -> dict[str, dict]:
    """What an administrator's client creates: settings by topic."""
    usual = {"partitions": PARTITIONS, "replicas": REPLICAS, "retention.ms": RETENTION_MS, "compression.type": "snappy"}
    return {topic: usual | (extra or {}).get(topic, {}) for topic in TOPICS.values()}
