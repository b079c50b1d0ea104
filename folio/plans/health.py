"""Checks of components, jobs that run, and metrics that are recorded as rows."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.events import BOUNDS
from folio.session import shared_dir

Check = Callable[[SparkSession], str]
METRIC = "name string, kind string, value double, labels map<string, string>, at timestamp"


def _runs(spark: SparkSession) -> str:
    return "healthy" if spark.range(10).count() == 10 else "unhealthy"


def _stores(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/folio-check-{uuid.uuid4().hex}"
    spark.range(3).write.parquet(path)
    return "healthy" if spark.read.parquet(path).count() == 3 else "unhealthy"


def _streams(spark: SparkSession) -> str:
    return "degraded" if any(q.exception() for q in spark.streams.active) else "healthy"


def _executors(spark: SparkSession) -> str:
    sc = spark.sparkContext
    alive = sc._jsc.sc().getExecutorMemoryStatus().size()
    return "healthy" if alive > 1 or sc.master.startswith("local") else "unhealthy"


def _stages(spark: SparkSession) -> str:
    failed = sum(s.numFailedTasks for s in filter(None, map(spark.sparkContext.statusTracker().getStageInfo, spark.sparkContext.statusTracker().getActiveStageIds())))
    return "degraded" if failed else "healthy"


CHECKS: dict[str, Check] = {"session": _runs, "shared_folder": _stores, "streams": _streams, "executors": _executors, "stages": _stages}


def checked(spark: SparkSession, checks: dict[str, Check] | None = None) -> DataFrame:
    """component, status, seconds, error: every check once; one that fails is unhealthy and ends nothing."""
    rows = []
    for name, check in (checks or CHECKS).items():
        began = time.perf_counter()
        try:
            status, error = check(spark), None
        except Exception as e:  # what is checked may be broken in any way
            status, error = "unhealthy", str(e)[:500]
        rows.append((name, status, time.perf_counter() - began, error))
    return spark.createDataFrame(rows, "component string, status string, seconds double, error string")


def polled(spark: SparkSession, times: int, every: float = 30.0, checks: dict[str, Check] | None = None) -> DataFrame:
    """The checks several times, some seconds apart, with the round."""
    found = None
    for i in range(times):
        if i:
            time.sleep(every)
        part = checked(spark, checks).withColumn("round", F.lit(i))
        found = part if found is None else found.unionByName(part)
    return found


def jobs(spark: SparkSession) -> DataFrame:
    """stage_id, name, tasks, active, done, failed of the stages that run now."""
    tracker = spark.sparkContext.statusTracker()
    found = filter(None, map(tracker.getStageInfo, tracker.getActiveStageIds()))
    rows = [(s.stageId, s.name, s.numTasks, s.numActiveTasks, s.numCompletedTasks, s.numFailedTasks) for s in found]
    return spark.createDataFrame(rows, "stage_id int, name string, tasks int, active int, done int, failed int")


class Metrics:
    """Counters, gauges and histograms as rows that are appended; nothing is kept in the driver but what waits to be written."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path, self.waiting = spark, path or f"{shared_dir(spark)}/folio-metrics-{uuid.uuid4().hex}", []

    def record(self, name: str, kind: str, value: float, **labels: str) -> None:
        self.waiting.append((name, kind, float(value), labels))
        if len(self.waiting) >= 1000:
            self.flush()

    def flush(self) -> None:
        rows = self.spark.createDataFrame(self.waiting, "name string, kind string, value double, labels map<string, string>")
        rows.withColumn("at", F.current_timestamp()).write.mode("append").parquet(self.path)
        self.waiting = []

    def timed(self, name: str, f: Callable, *args, **labels: str):
        """What ``f`` returns; its seconds go to a histogram."""
        began = time.perf_counter()
        try:
            return f(*args)
        finally:
            self.record(name, "histogram", time.perf_counter() - began, **labels)

    def rows(self) -> DataFrame:
        if self.waiting:
            self.flush()
        return self.spark.read.schema(METRIC).parquet(self.path)

    def summary(self) -> DataFrame:
        """name, kind, total of counters, last of gauges, count, and of histograms how many are at most each bound."""
        below = [F.when(F.first("kind") == "histogram", F.count_if(F.col("value") <= b)).alias(f"le_{b:g}".replace(".", "_")) for b in BOUNDS]
        total = F.when(F.first("kind") != "gauge", F.sum("value")).otherwise(F.max_by("value", "at"))
        return self.rows().groupBy("name", "kind").agg(total.alias("value"), F.count("*").alias("n"), *below)
