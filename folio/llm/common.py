"""What the operators share: columns by position, tables in the shared folder, small Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.session import shared_dir


def pick(df: DataFrame, **names: str) -> DataFrame:
    """The named columns of ``df`` under new names: ``pick(df, doc_id="id")``.

    Columns are found by exact name and then by position, so that further columns whose names
    differ only in case, or repeat, do not clash. Of repeated names the first one counts.
    """
    places = {new: df.columns.index(old) for new, old in names.items()}
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}").alias(new) for new, i in places.items()])


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with columns ``c0, c1, ...`` and the old names, for operators that return whole rows."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), list(df.columns)


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written once to a table in the shared folder and read from there.

    This cuts lineage: a lost executor never makes an expensive step run again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folio-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 128, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, fewer where they would hold over ``most`` bytes."""
    for batch in batches:
        step = max(1, min(rows, int(batch.num_rows * most / max(1, batch.nbytes))))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


#: Groups with over one in HOT of the rows are fewer than HOT, and few enough to broadcast.
HOT = 10_000


def with_group(rows: DataFrame, groups: DataFrame, key: str | list[str]) -> DataFrame:
    """``rows`` joined to their ``groups`` by ``key``; both are stored, and ``size`` is a group's number of rows.

    Large groups are broadcast to their rows, so that none of them meets in one task.
    """
    large = F.col("size") * HOT > (groups.agg(F.sum("size")).first()[0] or 0)
    heavy = F.broadcast(groups.where(large))  # under HOT rows
    light = rows.join(heavy, key, "left_anti").join(groups.where(~large), key)
    return rows.join(heavy, key).unionByName(light)


def no_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
