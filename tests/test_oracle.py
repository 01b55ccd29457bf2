"""Registered queries against DuckDB on the smallest tables. LOOMWRIGHT_ORACLE=all runs every query."""

import os
import warnings

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
PREFIXES = {}
for name in ORACLE:
    PREFIXES.setdefault(name.split("_")[0], []).append(name)
PICKED = list(ORACLE) if os.environ.get("LOOMWRIGHT_ORACLE") == "all" else [n for v in PREFIXES.values() for n in v[:3]]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", PICKED)
def test_matches_oracle(spark, con, name):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert compare(spark, con, QUERIES[name], ORACLE[name], SF) == []


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert "client" in df.columns and df.limit(1).count() == 1
