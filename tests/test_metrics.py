"""Mergeable user metrics; C10 with predicted structures."""

from pyspark.sql import functions as F

from quarry.operators import metrics as M
from quarry.operators import prompt as P


def _longest():
    return M.Metric(state="best bigint, n bigint", result="best bigint, n bigint", init=lambda: {"best": -1, "n": 0},
                    update=lambda s, rows: {"best": max(s["best"], int(rows["v"].max())), "n": s["n"] + len(rows)},
                    merge=lambda a, b: {"best": max(a["best"], b["best"]), "n": a["n"] + b["n"]}, finish=lambda s: s)


def test_user_metric_by_name(spark, monkeypatch):
    monkeypatch.setattr(M, "HELD", 2)
    M.register_metric("longest", _longest())
    rows = [(k, f"g{k % 5}" if k % 5 else None) for k in range(1000)]
    df = spark.createDataFrame(rows, "v bigint, g string").repartition(7)
    assert [tuple(r) for r in M.run_metric(df, "longest").collect()] == [(999, 1000)]
    got = {r.g: (r.best, r.n) for r in M.run_metric(df, "longest", by=("g",)).collect()}
    assert got == {(f"g{k}" if k else None): (995 + k, 200) for k in range(5)}


def test_metric_of_nothing(spark):
    M.register_metric("longest", _longest())
    none = spark.createDataFrame([], "v bigint, g string")
    assert [tuple(r) for r in M.run_metric(none, "longest").collect()] == [(-1, 0)]
    assert M.run_metric(none, "longest", by=("g",)).count() == 0


def test_hot_group_is_folded_before_the_shuffle(spark):
    df = spark.range(20_000).select((F.col("id") * 0).alias("g"), F.lit("a b").alias("gold"), F.lit("a c").alias("pred")).repartition(5)
    out = M.run_metric(df, "word_overlap", by=("g",))
    assert [tuple(r) for r in out.collect()] == [(0, 20_000, 0.5, 0.5)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInPandas") > plan.index("FlatMapGroupsInPandas")          # the fold is the leaf side


def test_content_stage_takes_the_predicted_structure(spark):
    ex = spark.createDataFrame([(1, "in1", "gold one"), (2, "in2", "gold two"), (3, "in3", "gold three")], "ex_id long, input string, structure string")
    pred = spark.createDataFrame([(1, "said one"), (2, None)], "ex_id long, predicted string")
    got = {r.ex_id: (r.used, r.from_prediction) for r in P.with_predicted_structure(ex, pred).collect()}
    assert got == {1: ("said one", True), 2: ("gold two", False), 3: ("gold three", False)}
