"""Physical-plan hygiene of every registered plan."""

import re

import pytest
from testdata import SF_SMALL

from quarry.plans.registry import load_all

PLANS = load_all()
# one-row sides (a global aggregate) may be joined without keys
ONE_ROW_CROSS = {"g17_in_not_in", "g18_scalar_subquery", "e46_metric_row"}
# one packed catalog row per database: with a single constant db_id the optimizer
# folds the equi-join into a nested loop over that one row (F10 broadcasts it)
ONE_CATALOG_ROW = {"a11_enrich_examples", "a12_schema_registry", "c03_schema_verbose", "c04_schema_piped", "c04_schema_piped_fuzzy",
                   "c09_c10_stage_pairs", "c11_parse_back", "f10_first_valid"}
# C06's result is one row per example and column; it joins the catalog by db_id
PER_COLUMN = {"c06_example_values"}


@pytest.mark.parametrize("name", sorted(PLANS))
def test_plan_hygiene(spark, name):
    df = PLANS[name].build(spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    if name not in ONE_ROW_CROSS | ONE_CATALOG_ROW | PER_COLUMN:
        assert "BroadcastNestedLoopJoin" not in plan
    # every window is partitioned (no single-partition window over all rows)
    for m in re.finditer(r"Window \[.*?\], \[(.*?)\], \[", plan):
        assert m.group(1).strip(), f"un-partitioned window in {name}"
    # at most one Python (Arrow) stage
    assert len(re.findall(r"MapInPandas|ArrowEvalPython|FlatMapGroupsInPandas", plan)) <= 1


@pytest.mark.parametrize("name", sorted(PLANS))
def test_output_contract(spark, name):
    """Unique column names and no array/map/struct columns (the driver hashes values)."""
    df = PLANS[name].build(spark, SF_SMALL)
    names = df.columns
    assert len(names) == len(set(names))
    for f in df.schema.fields:
        assert f.dataType.typeName() not in ("array", "map", "struct"), (name, f.name)
