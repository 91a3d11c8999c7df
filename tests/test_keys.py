"""Keys and inclusions found in the data, on rows of their own, against sets in Python."""

import random

from pyspark.sql import functions as F

from quarry.operators import keys as K


def tables(spark):
    r = random.Random(5)
    own = [(k, f"name {k}", k % 3) for k in range(400)]
    child = [(r.choice([None, *range(400)]), r.choice([None, "name 7", "name 8"]), r.randint(0, 500), f"name {r.randint(0, 450)}") for _ in range(2_000)]
    wide = [[k, *[(k + c) % 90 for c in range(70)]] for k in range(90)]        # more columns than a word of bits
    return {"own": spark.createDataFrame(own, "o_key long, o_name string, o_kind int").repartition(3),
            "child": spark.createDataFrame(child * 2, "c_key int, c_name string, c_other long, c_text string").repartition(4),
            "wide": spark.createDataFrame(wide, ", ".join(f"w{c}_x int" for c in range(71)))}


def expected(frames):
    held = {}
    for t, df in frames.items():
        rows = df.collect()
        for i, f in enumerate(df.schema.fields):
            values = [x[i] for x in rows if x[i] is not None]
            held[t, f.name] = (f.dataType.typeName() == "string", set(values), len(set(values)) == len(rows))
    stem = lambda c: c.partition("_")[2]
    return {(*a, *b, len(x), stem(a[1]) == stem(b[1])) for a, (kind, x, _) in held.items() for b, (other, y, unique) in held.items()
            if a != b and kind == other and unique and x and x <= y}


def test_inclusions_equal_sets(spark, monkeypatch):
    monkeypatch.setattr(K, "TASK_VALUES", 300)
    frames = tables(spark)
    values = K.column_values(frames)
    assert values.groupBy("table_name", "column_name", "kind", "value").count().where("count > 1").isEmpty()
    found = K.inclusions(values, K.unique_columns(values, frames))
    got = [tuple(x) for x in found.collect()]
    assert len(got) == len(set(got)) and set(got) == expected(frames)
    assert ("child", "c_key", "own", "o_key") in {x[:4] for x in got}


def test_values_and_sets_are_dealt_to_bounded_tasks(spark, monkeypatch):
    """A file split of any size: no task counts, and none gathers, all values of a table."""
    monkeypatch.setattr(K, "TASK_VALUES", 2_000)
    frames = {"t": spark.range(0, 20_000, 1, 1).select((F.col("id") * 7).alias("t_key"), F.concat(F.lit("v"), F.col("id")).alias("t_name"))}
    counted = []
    cut = K.cut_lineage
    monkeypatch.setattr(K, "cut_lineage", lambda df: counted.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    values = K.column_values(frames)
    assert "REPARTITION_BY_NUM" in counted[0] and "hashpartitioning(t_key" in counted[0]
    assert values.count() == 40_000
    plan = K.inclusions(values, K.unique_columns(values, frames))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ObjectHashAggregate" not in plan and "collect_set" not in plan
