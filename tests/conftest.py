from __future__ import annotations

import math
import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from folio.session import local_session  # noqa: E402

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, "tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not DATA.is_dir():
        pytest.skip("no test tables")
    return str(DATA)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="session")
def same(duck):
    """Holds a DataFrame against SQL: names of columns and rows in any order."""

    def run(df, sql):
        names = sorted(df.columns)
        other = duck.sql(sql)
        assert names == sorted(other.columns)
        own = sorted(tuple(map(plain, r)) for r in df.select(*names).collect())
        quoted = ", ".join(f'"{n}"' for n in names)
        assert own == sorted(tuple(map(plain, r)) for r in other.project(quoted).fetchall())

    return run
