"""Streams: the operators on events over Structured Streaming, with watermarks and state.

A query here runs over all that its source has (``availableNow``) and gives a table, so that it can be
held against its batch twin; the same functions serve a source that never ends.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import events
from folio.operators.sequential import Breaker
from folio.session import shared_dir

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
#: How far events may be out of order here; the default elsewhere is an hour.
LATE = "40 days"


def source(spark: SparkSession, path: str, schema: str = EVENTS, kind: str = "parquet", **options: str) -> DataFrame:
    """A stream of rows: files of a folder, or ``kind="kafka"`` with JSON values of the schema."""
    if kind == "kafka":
        raw = spark.readStream.format("kafka").options(**options).load()
        return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*")
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).options(**options)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.format(kind).load(path)
    return reader.option("pathGlobFilter", name).format(kind).load(folder)


def messages(rows: DataFrame, kind: str, key: str = "job_id") -> DataFrame:
    """topic, key and value of rows as messages of a kind: JSON with the kind and the time, to the kind's topic."""
    body = F.to_json(F.struct(F.lit(kind).alias("message_type"), F.current_timestamp().alias("timestamp"), *[F.col(f"`{c}`") for c in rows.columns]))
    return rows.select(F.lit(events.TOPICS[kind]).alias("topic"), F.col(key).cast("string").alias("key"), body.alias("value"))


def send(sent: DataFrame, to: str, kind: str = "json", **options: str) -> None:
    """Messages to a folder, a part for each topic, or to the topics of a cluster with ``kind="kafka"``."""
    if kind == "kafka":
        sent.write.format("kafka").options(**({"kafka.bootstrap.servers": to, "kafka.compression.type": "snappy"} | options)).save()
    else:
        sent.write.mode("append").partitionBy("topic").format(kind).options(**options).save(to)


def completion_notices(conversations: DataFrame) -> DataFrame:
    """A message for every conversation whose turns are all there."""
    done = events.C["job_completion"].on(conversations=conversations).where("complete")
    return messages(done.select(F.col("conv_id").alias("job_id"), "seen"), "processing_complete")


def dispatched(requests: DataFrame, known: DataFrame, workers: int = 4) -> tuple[DataFrame, DataFrame]:
    """Requests (job_id, ...) whose result is known (key, value), with it; and the rest, each with the worker its job belongs to."""
    joined = requests.join(known.select(F.col("key").alias("_key"), F.col("value").alias("result")), F.col("job_id").cast("string") == F.col("_key"), "left")
    rest = joined.where("_key IS NULL").drop("_key", "result").withColumn("worker", F.pmod(F.xxhash64(F.col("job_id").cast("string")), F.lit(workers)).cast("int"))
    return joined.where("_key IS NOT NULL").drop("_key"), rest


def event_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source(spark, f"{sf_dir}/events.parquet")
    return rows.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", LATE)


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what there is; its rows as a table in the shared folder."""
    spark = stream.sparkSession
    top = f"{shared_dir(spark)}/folio-stream-{uuid.uuid4().hex}"
    out = f"{top}/out"

    def save(batch: DataFrame, number: int) -> None:
        part = "all" if mode == "complete" else number
        batch.write.mode("overwrite").parquet(f"{out}/batch={part}")  # a batch that runs again replaces itself

    query = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/*")


def latest(stream: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows in update mode: the last of each key."""
    rows = finished(stream, "update")
    return rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), order).alias("r")).select(*key, "r.*")


def stream_rate_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.window("at", "5 minutes")
    counted = event_source(spark, sf_dir).groupBy("event_type", w).agg(F.count("*").alias("events"))
    rows = counted.select("event_type", F.unix_micros("window.start").alias("start_us"), "events", (F.col("events") / F.lit(300.0)).alias("per_second"))
    return latest(rows, ["event_type", "start_us"], "events")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.session_window("at", "300 seconds")
    counted = event_source(spark, sf_dir).groupBy("user_id", w).agg(F.count("*").alias("events"))
    rows = counted.select("user_id", F.unix_micros("session_window.start").alias("start_us"), F.unix_micros("session_window.end").alias("end_us"), "events")
    return finished(rows, "complete")


def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated keys within the watermark come through once."""
    rows = event_source(spark, sf_dir).dropDuplicatesWithinWatermark(["user_id"])
    return finished(rows.select("user_id"))


def stream_job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("at", "event_id")
    counted = event_source(spark, sf_dir).groupBy(F.col("user_id").alias("job_id")).agg(F.max_by("event_type", order).alias("status"), F.unix_micros(F.max("at")).alias("at_us"), F.count("*").alias("updates"))
    return latest(counted, ["job_id"], "updates")


def stream_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with their topics; invalid ones go to the topic of errors."""
    rows = event_source(spark, sf_dir)
    body = F.when(F.col("event_id") % 17 == 0, "").otherwise(F.col("props"))
    topics = F.create_map(*[F.lit(x) for pair in events.TOPICS.items() for x in pair])
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "chunk_processing").when(F.col("event_type") == "view", "status_update").otherwise("processing_request")
    valid = F.trim(body) != ""
    return finished(rows.select("event_id", F.when(valid, F.coalesce(topics[kind], F.lit("error-handling"))).otherwise("error-handling").alias("topic"), valid.alias("valid")))


def _breaker(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    breaker = Breaker(*state.get) if state.exists else Breaker()
    rows = pd.concat(list(batches)).sort_values(["us", "event_id"])
    states = [breaker.step(us, ok) for us, ok in zip(rows["us"], rows["success"])]
    state.update(breaker.held())
    yield pd.DataFrame({"instance_id": key[0], "request_id": rows["event_id"], "us": rows["us"], "state": states})


def stream_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The breaker of each instance as state: a few numbers a key, whatever the stream's length.

    Rows of a micro-batch are put in order; ``maxFilesPerTrigger`` bounds a micro-batch.
    """
    rows = event_source(spark, sf_dir).select((F.col("user_id") % 7).alias("instance_id"), "event_id", F.unix_micros("at").alias("us"), (F.col("event_type") != "error").alias("success"))
    folded = rows.groupBy("instance_id").applyInPandasWithState(
        _breaker, "instance_id long, request_id long, us long, state string", "state string, failures long, last_us long, tests long", "append", "NoTimeout"
    )
    return finished(folded)


def in_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], at: str, every: str = "30 seconds"):
    """A stream that hands each micro-batch to a function; at least once, from a checkpoint."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", at).trigger(processingTime=every).start()


QUERIES = {
    "stream_rate_5m": stream_rate_5m,
    "stream_sessions": stream_sessions,
    "stream_first_seen": stream_first_seen,
    "stream_job_status": stream_job_status,
    "stream_validated": stream_validated,
    "stream_breaker": stream_breaker,
}
ORACLES = {
    "stream_rate_5m": events.C["rate_5m"].oracle,
    "stream_sessions": f"select user_id, start_us, end_us, events from ({events.C['session_windows'].oracle}) t",
    "stream_first_seen": "select distinct user_id from events",
    "stream_job_status": events.C["job_latest_status"].oracle,
}
