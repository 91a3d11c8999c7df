"""Selection by rank and connected components against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import plan_utils as P


@pytest.fixture
def small_steps(monkeypatch):
    monkeypatch.setattr(P, "SAMPLE", 60)
    monkeypatch.setattr(P, "TAIL", 40)


def order(row):
    return tuple((x is not None, x) for x in row[:2])


@pytest.mark.parametrize("kind", ["spread", "ties", "one_key", "nulls"])
def test_first_k_equals_sorting(spark, small_steps, kind):
    r = random.Random(3)
    make = {"spread": lambda k: (r.random(), k), "ties": lambda k: (r.randint(0, 3), k % 50), "one_key": lambda k: (1.0, 7),
            "nulls": lambda k: (None if r.random() < 0.3 else r.random(), k)}[kind]
    rows = [(*map(lambda x: None if x is None else float(x), make(k)), f"t{k}") for k in range(1500)]
    df = spark.createDataFrame(rows, "a double, b double, t string").repartition(6)
    for k in (0, 1, 39, 700, 1499, 1500, 9000):
        got = sorted(map(tuple, P.first_k(df, [F.col("a"), F.col("b")], k).collect()), key=order)
        assert [order(x) for x in got] == [order(x) for x in sorted(rows, key=order)[:k]]
        assert len(set(got)) == len(got)


def test_selection_has_no_global_sort(spark):
    df = spark.range(0, 50_000, 1, 8).withColumn("key", F.md5(F.col("id").cast("string")))
    plan = P.first_k(df, [F.col("key"), F.col("id")], 9_000)
    assert plan.count() == 9_000
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in text and "Exchange" not in text


def test_components_of_a_long_chain(spark):
    chain = [("a", k, k + 1) for k in range(4_000)] + [("b", 5, 3), ("b", 9, 8), ("b", 3, 8), ("b", 20, 20)]
    random.Random(1).shuffle(chain)
    found, rounds = P.components(spark.createDataFrame(chain, "db string, a long, b long"), ["db"])
    got = {(r["db"], r["node"]): r["comp"] for r in found.collect()}
    assert rounds <= 15
    assert got == {("a", k): 0 for k in range(4_001)} | {("b", k): 3 for k in (3, 5, 8, 9)}
