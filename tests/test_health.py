"""Checks, metrics, messages and dispatch by hand."""

from __future__ import annotations

import json

from folio.plans import health
from folio.streaming import streams


def test_checks(spark):
    def broken(session):
        raise ValueError("no")

    rows = {r["component"]: (r["status"], r["error"]) for r in health.checked(spark, health.CHECKS | {"broken": broken}).collect()}
    assert rows.pop("broken") == ("unhealthy", "no") and set(rows.values()) == {("healthy", None)} and len(rows) == 5
    assert health.polled(spark, 2, 0.0, {"x": lambda s: "healthy"}).count() == 2
    assert health.jobs(spark).columns[0] == "stage_id"


def test_metrics(spark):
    m = health.Metrics(spark)
    for v in (1, 2):
        m.record("requests", "counter", v, model="a")
        m.record("load", "gauge", v)
        m.flush()
    assert m.timed("seconds", lambda: 5) == 5
    got = {r["name"]: r for r in m.summary().collect()}
    assert got["requests"]["value"] == 3 and got["load"]["value"] == 2 and got["seconds"]["le_0_1"] == 1 and got["load"]["le_0_1"] is None


def test_messages_and_notices(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0), (1, 1), (2, 1)], "conv_id long, turn long")
    sent = streams.completion_notices(rows)
    streams.send(sent, str(tmp_path / "out"))
    got = spark.read.json(str(tmp_path / "out")).collect()
    assert [(r["topic"], r["key"]) for r in got] == [("processing-complete", "1")]
    assert json.loads(got[0]["value"])["message_type"] == "processing_complete"


def test_dispatch(spark):
    known = spark.createDataFrame([("1", "done")], "key string, value string")
    cached, rest = streams.dispatched(spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "job_id long, body string"), known)
    assert [tuple(r) for r in cached.collect()] == [(1, "a", "done")]
    assert len({r["worker"] for r in rest.collect()}) == 1 and rest.count() == 2
