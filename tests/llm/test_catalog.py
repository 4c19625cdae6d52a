"""Every query of the subpackage on the smallest tables: next to its SQL where it has some, and on empty tables."""

import sys
from pathlib import Path

import pytest

from claimforge.llm import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = ("pages", "people", "companies", "documents", "person_versions", "role_reference", "mix_targets")
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def emptied(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for table in TABLES:
        spark.read.parquet(f"{FOLDER}/{table}.parquet").limit(0).write.parquet(str(folder / f"{table}.parquet"))
    return str(folder)


def test_names():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 7, 10)} <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, name):
    sys.path.insert(0, str(Path(__file__).parents[1]))
    from oracle import compare, duck

    assert compare(catalog.QUERIES[name](spark, FOLDER), catalog.ORACLES[name], duck(FOLDER)) == ""


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_runs_on_small_and_empty_tables(spark, emptied, name):
    full = catalog.QUERIES[name](spark, FOLDER)
    assert full.count() > 0
    empty = catalog.QUERIES[name](spark, emptied)
    assert empty.columns == full.columns and empty.count() == 0
