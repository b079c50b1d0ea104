"""A cache of results as a table in the shared folder: put, get, exists, delete, by tag, by namespace, with lifetimes.

Every change is appended as rows with a time; of the rows of a key the latest counts. So writers never wait for each other,
and what a lost executor had written stays. ``compact`` rewrites what lives.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from folio.operators.events import TTL
from folio.session import shared_dir

ROW = "namespace string, key string, value string, tags array<string>, at timestamp, until timestamp, gone boolean"


class Cache:
    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/folio-cache-{uuid.uuid4().hex}"
        spark.createDataFrame([], ROW).write.mode("append").parquet(self.path)

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(ROW).parquet(self.path)

    def _append(self, rows: DataFrame) -> None:
        rows.selectExpr(*[c.split()[0] for c in ROW.split(", ")]).write.mode("append").parquet(self.path)

    def live(self) -> DataFrame:
        """The latest row of every key that was not taken away and whose time is not over."""
        last = Window.partitionBy("namespace", "key").orderBy(F.desc("at"), F.desc("gone"))
        rows = self._rows().withColumn("place", F.row_number().over(last)).where("place = 1 AND NOT gone").drop("place", "gone")
        return rows.where(F.col("until") > F.current_timestamp())

    def put(self, entries: DataFrame, namespace: str = "segment", seconds: int | None = None, tags: list[str] | None = None) -> None:
        """Entries (key, value). They live for ``seconds``, or as long as their namespace's kind does."""
        lives = TTL.get(namespace, 3600) if seconds is None else seconds
        now = F.current_timestamp()
        self._append(
            entries.select(
                F.lit(namespace).alias("namespace"),
                F.col("key").cast("string").alias("key"),
                F.col("value").cast("string").alias("value"),
                F.lit(tags or []).cast("array<string>").alias("tags"),
                now.alias("at"),
                (now + F.make_interval(secs=F.lit(lives))).alias("until"),
                F.lit(False).alias("gone"),
            )
        )

    def get(self, keys: DataFrame, namespace: str = "segment") -> DataFrame:
        """``keys`` (key) with their values, null where none lives."""
        own = self.live().where(F.col("namespace") == namespace).select("key", "value")
        return keys.join(own, "key", "left")

    def exists(self, key: str, namespace: str = "segment") -> bool:
        return not self.live().where((F.col("namespace") == namespace) & (F.col("key") == key)).isEmpty()

    def _take_away(self, which) -> None:
        self._append(self.live().where(which).withColumns({"at": F.current_timestamp(), "gone": F.lit(True)}))

    def delete(self, keys: list[str], namespace: str = "segment") -> None:
        self._take_away((F.col("namespace") == namespace) & F.col("key").isin(keys))

    def invalidate(self, tag: str) -> None:
        """Everything that has the tag, in any namespace."""
        self._take_away(F.array_contains("tags", tag))

    def clear(self, namespace: str) -> None:
        self._take_away(F.col("namespace") == namespace)

    def compact(self) -> None:
        """Go over to a new folder with only what lives."""
        fresh = f"{shared_dir(self.spark)}/folio-cache-{uuid.uuid4().hex}"
        self.live().withColumn("gone", F.lit(False)).write.parquet(fresh)
        self.path = fresh


def stored_once(cache: Callable[[], dict]):
    """A decorator for functions of a session and a folder that return a DataFrame: the second call reads what the first wrote."""

    def wrap(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            known, key = cache(), (f.__name__, sf_dir, spark.sparkContext.applicationId)
            if key not in known:
                found = f(spark, sf_dir)
                path = f"{shared_dir(spark)}/folio-once-{uuid.uuid4().hex}"
                found.write.parquet(path)
                known[key] = path, found.schema
            path, schema = known[key]
            return spark.read.schema(schema).parquet(path)

        return run

    return wrap


def measured(f: Callable[..., DataFrame]) -> Callable[..., tuple[DataFrame, Observation]]:
    """A decorator: the DataFrame, and an observation that has its number of rows when it was run."""

    @functools.wraps(f)
    def run(*args, **kwargs) -> tuple[DataFrame, Observation]:
        seen = Observation(f.__name__)
        return f(*args, **kwargs).observe(seen, F.count(F.lit(1)).alias("rows")), seen

    return run
