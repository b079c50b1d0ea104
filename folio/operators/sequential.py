"""Operators that need order or state: splitting, fuzzy matching, merging of profiles, breakers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import cascade, fuzzy, recovery, splitting
from folio.operators import text  # noqa: F401  its views are named here
from folio.sources.tables import load


def _split(f):
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([f(t or "") for t in texts])

    return run


def split_segments(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``part_no`` and ``part`` for each part of its texts: quotations, speakers, actions, sentences."""
    return df.select("*", F.posexplode(_split(splitting.split_segment)(F.col(text))).alias("part_no", "part"))


def advanced_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return split_segments(docs).select("doc_id", "part_no", "part")


def long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lines").where(F.length("line") > splitting.LONG_LINE)
    return lines.select("doc_id", "line_no", F.posexplode(_split(splitting.split_line)(F.col("line"))).alias("part_no", "part"))


def attribute_lines(lines: DataFrame, names: DataFrame) -> DataFrame:
    """conv_id, turn, speaker, confidence, rule, status: every line by the cascade, with the names (conv_id, name) of its conversation."""
    known = names.groupBy("conv_id").agg(F.array_sort(F.collect_set("name")).alias("known"))
    found = lines.join(known, "conv_id", "left").select("conv_id", "turn", cascade.attributed()("text", "known").alias("a")).select("conv_id", "turn", "a.*")
    return found.withColumn("status", F.when(F.col("confidence") >= 0.8, "ATTRIBUTED").otherwise("PENDING_AI"))


def cascade_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "utterances")
    return attribute_lines(lines, lines.select("conv_id", F.col("speaker").alias("name")))


def recovered(segments: DataFrame, reach: int = 5) -> DataFrame:
    """conv_id, turn, speaker, strategy of UNFIXABLE segments (conv_id, turn, speaker, text), by ``recovery.recover``.

    A segment is looked at with ``reach`` neighbours on either side and with a line for each speaker of its
    conversation, made from the attributed ones.
    """
    order = Window.partitionBy("conv_id").orderBy("turn")
    own = F.struct("speaker", "text")
    near = segments.withColumns({"before": F.collect_list(own).over(order.rowsBetween(-reach, -1)), "after": F.collect_list(own).over(order.rowsBetween(1, reach))})
    known = segments.where(~F.col("speaker").isin(*recovery.NOBODY))
    words = known.select("conv_id", "speaker", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).where("length(word) > 3")
    words = words.groupBy("conv_id", "speaker", "word").count().withColumn("place", F.row_number().over(Window.partitionBy("conv_id", "speaker").orderBy(F.desc("count"), "word")))
    words = words.where("place <= 10").groupBy("conv_id", "speaker").agg(F.sort_array(F.collect_list("word")).alias("words"))
    habits = known.groupBy("conv_id", "speaker").agg(F.avg(F.length("text")).alias("size"), F.avg(F.expr("if(text rlike '[\"“”—–]' or contains(text, chr(39)), 1.0D, 0.0D)")).alias("talk"))
    habits = habits.join(words, ["conv_id", "speaker"], "left").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("speaker", "words", "size", "talk"))).alias("habits"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [recovery.recover(t or "", list(x), list(y), [] if h is None else list(h)) for t, x, y, h in zip(b["text"], b["before"], b["after"], b["habits"])]
            yield b[["conv_id", "turn"]].assign(speaker=[f[0] for f in found], strategy=[f[1] for f in found])

    todo = near.where("speaker = 'UNFIXABLE'").join(habits, "conv_id", "left").select("conv_id", "turn", "text", "before", "after", "habits")
    return todo.mapInPandas(run, "conv_id long, turn long, speaker string, strategy string")


def recovery_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovered(load(spark, sf_dir, "segments").select("conv_id", "turn", "speaker", "text"))


def merged_profiles(names: pd.DataFrame, above: int = 85) -> pd.DataFrame:
    """Profiles of one conversation, greedily merged: each into the first kept one that is like it."""
    kept: list[list] = []
    for name, n in sorted(zip(names["name"], names["n"]), key=lambda x: (-x[1], x[0])):
        like = (k for k in kept if fuzzy.ratio(name.lower(), k[0].lower()) >= above or ((name in k[0] or k[0] in name) and abs(len(name) - len(k[0])) <= 5))
        if (k := next(like, None)) is not None:
            k[1] += n
            k[2].append(name)
        else:
            kept.append([name, n, []])
    return pd.DataFrame({"conv_id": names["conv_id"].iloc[0], "name": [k[0] for k in kept], "n": [k[1] for k in kept], "aliases": ["|".join(k[2]) for k in kept]})


def profile_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a conversation are counted first, so a group holds a row for each distinct name of one conversation."""
    words = load(spark, sf_dir, "utterances").select("conv_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), F.lit(0))).alias("name"))
    counted = words.groupBy("conv_id", "name").agg(F.count("*").alias("n"))
    return counted.groupBy("conv_id").applyInPandas(lambda g: merged_profiles(g), "conv_id long, name string, n long, aliases string")


class Breaker:
    """CLOSED; OPEN after five failures; HALF_OPEN 60 seconds later; CLOSED again after three successes."""

    FAILURES, WAIT_US, TESTS = 5, 60_000_000, 3

    def __init__(self, state: str = "CLOSED", failures: int = 0, last_us: int = 0, tests: int = 0):
        self.state, self.failures, self.last_us, self.tests = state, failures, last_us, tests

    def step(self, us: int, success: bool) -> str:
        """The state after a request; one that is turned away changes nothing."""
        if self.state == "OPEN":
            if us - self.last_us < self.WAIT_US:
                return self.state
            self.state, self.tests = "HALF_OPEN", 0
        if success:
            if self.state == "HALF_OPEN":
                self.tests += 1
                if self.tests >= self.TESTS:
                    self.state, self.failures = "CLOSED", 0
            else:
                self.failures = 0
        else:
            self.failures, self.last_us = self.failures + 1, us
            if self.state == "HALF_OPEN" or self.failures >= self.FAILURES:
                self.state = "OPEN"
        return self.state

    def held(self) -> tuple[str, int, int, int]:
        return self.state, self.failures, self.last_us, self.tests


def breaker_states(requests: DataFrame) -> DataFrame:
    """instance_id, request_id, us, state: a fold over each instance's requests in order, a batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, breaker = None, Breaker()
        for b in batches:
            states = []
            for instance, us, ok in zip(b["instance_id"], b["us"], b["success"]):
                if instance != at:
                    at, breaker = instance, Breaker()
                states.append(breaker.step(us, ok))
            yield b[["instance_id", "request_id", "us"]].assign(state=states)

    rows = requests.select("instance_id", "request_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "success")
    ordered = rows.repartition("instance_id").sortWithinPartitions("instance_id", "us", "request_id")
    return ordered.mapInPandas(run, "instance_id long, request_id long, us long, state string")


def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breaker_states(load(spark, sf_dir, "requests"))


def batch_groups(df: DataFrame, lines: int = 20, groups: int = 3) -> DataFrame:
    """Windows in batches of at most three and twenty lines, greedily in order: a fold over each document's windows."""
    start = F.expr("named_struct('batch', 0L, 'n', 0L, 'size', 0L, 'out', cast(array() as array<struct<w: bigint, batch: bigint>>))")

    def step(acc, x):
        fresh = (acc["n"] >= groups) | ((acc["size"] + x["size"] > lines) & (acc["n"] > 0))
        batch = F.when(fresh, acc["batch"] + 1).otherwise(acc["batch"])
        return F.struct(
            batch.alias("batch"),
            F.when(fresh, F.lit(1).cast("long")).otherwise(acc["n"] + 1).alias("n"),
            F.when(fresh, x["size"]).otherwise(acc["size"] + x["size"]).alias("size"),
            F.concat(acc["out"], F.array(F.struct(x["w"].alias("w"), batch.alias("batch")))).alias("out"),
        )

    found = F.aggregate(F.array_sort(F.collect_list(F.struct("w", "size"))), start, step, lambda acc: acc["out"])
    return df.groupBy("doc_id").agg(found.alias("out")).select("doc_id", F.inline("out"))


def window_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = load(spark, sf_dir, "window_lines").groupBy("doc_id", F.col("w").cast("long").alias("w")).agg(F.count("*").alias("size"))
    return batch_groups(windows)


QUERIES = {
    "advanced_split": advanced_split,
    "long_lines": long_lines,
    "cascade_attribution": cascade_attribution,
    "recovery_strategies": recovery_strategies,
    "profile_merge": profile_merge,
    "circuit_breaker": circuit_breaker,
    "window_batches": window_batches,
}
ORACLES: dict[str, str] = {}
