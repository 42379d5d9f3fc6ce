"""Every registered query at the smallest table size, against its SQL where it has one."""

import glob
from pathlib import Path

import duckdb
import pytest
from check_oracle import compare

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    verdict, _, _ = compare(spark, con, name, SF)
    assert verdict.startswith(("ok", "rows-only")), verdict


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
