"""Every registered plan with an oracle: Spark result == DuckDB result (sf0.001)."""

import pytest
from testdata import SF_SMALL

import check_oracle as CO
import __spark_entry__ as E

ORACLE = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def duck():
    return CO.duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, duck, name):
    sp = CO.digest(QUERIES[name](spark, SF_SMALL).toPandas())
    du = CO.digest(duck.sql(ORACLE[name]).df())
    assert sp[1] == du[1], "column names differ"
    assert sp[0] == du[0], "row counts differ"
    assert sp[2] == du[2], "values differ"


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert {r.level for r in rows} <= {"easy", "medium", "hard", "extra"}
    assert sum(r.n_queries for r in rows) == 1500


def test_every_plan_has_ops():
    from quarry.plans.registry import load_all
    for p in load_all().values():
        assert p.ops, p.name
