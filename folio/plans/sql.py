"""Operators written as one SQL text, which Spark runs and DuckDB checks.

A text names its inputs in braces, ``{utterances}``; an input is a table, or a view that is itself a
text. Where the dialects differ, ``$name`` stands for the word of each. On Spark an operator is a
function of DataFrames: ``operator.on(utterances=df)``; Catalyst sees one plan, views included.
"""

from __future__ import annotations

import re
from string import Template

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Words of the two dialects: (Spark, DuckDB).
WORDS = {
    "g": ("", ", 'g'"),
    "rlike": ("rlike", "regexp_matches"),
    "starts": ("startswith", "starts_with"),
    "ends": ("endswith", "ends_with"),
    "pos": ("instr", "strpos"),
    "findall": ("regexp_extract_all", "regexp_extract_all"),
    "group0": (", 0", ""),
    "size": ("size", "len"),
    "split": ("split", "string_split"),
    "resplit": ("split", "regexp_split_to_array"),
    "list": ("collect_list", "list"),
    "join": ("array_join", "array_to_string"),
    "map": ("transform", "list_transform"),
    "keep": ("filter", "list_filter"),
    "x": ("x ->", "lambda x:"),
    "series": ("explode(sequence", "unnest(range"),
    "epoch": ("unix_micros(cast({} as timestamp))", "epoch_us({})"),
    "any": ("bool_or", "bool_or"),
    "every": ("bool_and", "bool_and"),
    "slice": ("slice", "list_slice"),
    "stddev": ("stddev_pop", "stddev_pop"),
    "argmax": ("max_by", "arg_max"),
    "argmin": ("min_by", "arg_min"),
    "string": ("string", "varchar"),
    "sha": ("sha2", "sha256"),
    "bits": (", 256", ""),
    "micros": ("unix_micros", "epoch_us"),
    "ts": ("timestamp", "timestamp"),
    "ntz": ("timestamp_ntz", "timestamp"),
    "ref1": ("$1", "\\1"),
    "ref2": ("$2", "\\2"),
    "lb": ("\\\\x5B", "\\x5B"),
    "rb": ("\\\\x5D", "\\x5D"),
    "lastnulls": (") ignore nulls", " ignore nulls)"),
    "strlen": ("octet_length", "strlen"),
}

VIEWS: dict[str, str | tuple[str, str]] = {}


def view(name: str, spark: str, duckdb: str | None = None) -> None:
    VIEWS[name] = (spark, duckdb if duckdb is not None else spark)


def _refs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


def full_text(sql: str | tuple[str, str], dialect: int, given: tuple[str, ...] = ()) -> tuple[str, set[str]]:
    """The text with its views as common table expressions, and the tables it still needs."""
    body = sql if isinstance(sql, str) else sql[dialect]
    found: dict[str, str] = {}
    tables: set[str] = set()

    def visit(text: str) -> None:
        for name in _refs(text):
            if name in given or name not in VIEWS:
                tables.add(name)
            elif name not in found:
                found[name] = ""
                visit(VIEWS[name][dialect])
                del found[name]
                found[name] = VIEWS[name][dialect]

    visit(body)
    named = {n: "{" + n + "}" if dialect == 0 and n in tables else n for n in [*tables, *found]}
    words = {k: v[dialect] for k, v in WORDS.items()}

    def finished(text: str) -> str:
        return re.sub(r"\{(\w+)\}", lambda m: named[m[1]], Template(text).substitute(words))

    own = [f"{n} as (\n{finished(t)}\n)" for n, t in found.items()]
    body = finished(body)
    if not own:
        return body, tables
    if re.match(r"\s*with\b", body):
        return f"with {', '.join(own)}, {re.sub(r'^\s*with\b', '', body)}", tables
    return f"with {', '.join(own)}\n{body}", tables


class SqlOperator:
    def __init__(self, name: str, sql: str, duckdb: str | None = None, doc: str = ""):
        self.name, self.sql, self.__doc__ = name, (sql, duckdb if duckdb is not None else sql), doc

    def on(self, spark: SparkSession | None = None, **frames: DataFrame) -> DataFrame:
        """The operator over these inputs; views not given are made from the tables that are."""
        spark = spark or next(iter(frames.values())).sparkSession
        text, needed = full_text(self.sql, 0, tuple(frames))
        return spark.sql(text, **{n: frames[n] for n in needed})

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        _, needed = full_text(self.sql, 0)
        return self.on(spark, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in needed})

    @property
    def oracle(self) -> str:
        return full_text(self.sql, 1)[0]


class Catalogue(dict):
    """Operators by name: ``add(name, sql)``; ``queries`` and ``oracles`` are what the entry module takes."""

    def add(self, name: str, sql: str, duckdb: str | None = None, doc: str = "") -> SqlOperator:
        self[name] = SqlOperator(name, sql, duckdb, doc)
        return self[name]

    @property
    def queries(self) -> dict:
        return dict(self)

    @property
    def oracles(self) -> dict[str, str]:
        return {name: op.oracle for name, op in self.items()}
