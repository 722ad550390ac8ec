"""Every registered query of the library proper against its SQL, on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parent.parent / "scripts"))
from compare import TABLES, cell  # noqa: E402

from quietcount.plans.registry import ORACLES, QUERIES  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(cell(v) for v in r)) for r in df.select(*columns).collect())
    if name not in ORACLES:
        assert got is not None
        return
    sql = ORACLES[name]
    assert sorted(duck.sql(sql).columns) == columns
    want = sorted(repr(tuple(cell(v) for v in r)) for r in duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({sql})").fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
