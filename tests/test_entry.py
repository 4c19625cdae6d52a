"""The driver's contract, and every query with SQL next to DuckDB on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from claimforge.plans import catalog, derived  # noqa: F401  derived adds its queries

FOLDER = "/root/testdata/sf0.001"
there = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and catalog.QUERIES.keys() <= entry.queries().keys()


@there
def test_entry(spark):
    assert entry.entry(spark).columns == ["company_id", "person_id", "name", "total", "rank"]


@there
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, name):
    import sys

    sys.path.insert(0, str(Path(__file__).parent))
    from oracle import compare, duck

    assert compare(catalog.QUERIES[name](spark, FOLDER), catalog.ORACLES[name], duck(FOLDER)) == ""


@pytest.fixture(scope="module")
def emptied(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for table in ("pages", "people", "companies", "documents", "evidence", "events", "person_versions"):
        spark.read.parquet(f"{FOLDER}/{table}.parquet").limit(0).write.parquet(str(folder / f"{table}.parquet"))
    return str(folder)


#: Reports that have rows without any input.
ALWAYS = {"role_histogram", "headline_rates", "baseline_comparison", "failure_categories"}


@there
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_runs_on_empty_tables(spark, emptied, name):
    columns = catalog.QUERIES[name](spark, FOLDER).columns
    empty = catalog.QUERIES[name](spark, emptied)
    rows = empty.count()
    assert empty.columns == columns and (rows == 0 or name in ALWAYS)
