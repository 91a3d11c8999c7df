"""Readers and sinks (A01, A05, A15-A19) and the exact first-k selection."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from quarry.functions.plan_utils import first_k
from quarry.sources import corpus as A
from quarry.sources import sinks as K


def _tmp():
    return tempfile.mkdtemp(prefix="quarry-test-")


def test_single_turn_reader(spark):
    d = _tmp()
    path = os.path.join(d, "train.json")
    with open(path, "w") as f:
        json.dump([{"db_id": "star", "query": "SELECT 1", "query_toks": ["SELECT", "1"], "question": "one?"},
                   {"db_id": "star", "query": "SELECT 2", "query_toks": ["SELECT", "2"], "question": "two?"}], f)
    df = A.read_single_turn(spark, [path], "train")
    assert df.count() == 2 and set(df.columns) >= {"db_id", "query", "question", "split", "ex_id"}


def test_schema_from_json(spark):
    d = _tmp()
    path = os.path.join(d, "schema.json")
    with open(path, "w") as f:
        json.dump([{"table": "Orders", "col_data": [{"column_name": "O_Key"}, {"column_name": "Total"}]}], f)
    rows = A.schema_from_json(spark, path).orderBy("col_pos").collect()
    assert [(r.table_name, r.column_name) for r in rows] == [("orders", "o_key"), ("orders", "total")]


def test_alias_renaming(spark):
    df = spark.createDataFrame([("SELECT ORDERSalias0.x FROM orders AS ORDERSalias0 JOIN nation AS NATIONalias0",)], "sql string")
    out = A.normalize_aliases(df, "sql", ["region", "nation", "orders"]).first()[0]
    assert out == "SELECT T2.x FROM orders AS T2 JOIN nation AS T1"


def test_sinks_round_trip(spark):
    d = _tmp()
    pred = spark.createDataFrame([(2, "SELECT 2", "q2"), (1, "SELECT 1", "q1")], "ex_id long, pred_sql string, input string")
    K.write_prediction_lines(pred, f"{d}/lines")
    assert [r.value for r in spark.read.text(f"{d}/lines").collect()] == ["SELECT 1", "SELECT 2"]
    K.write_prediction_records(pred, f"{d}/records")
    assert spark.read.json(f"{d}/records").count() == 2
    K.append_hypotheses(pred, f"{d}/hyp", 0)
    K.append_hypotheses(pred, f"{d}/hyp", 1)
    assert spark.read.parquet(f"{d}/hyp").select("batch_id").distinct().count() == 2
    K.write_score_report(pred, pred.limit(1), f"{d}/report")
    assert spark.read.json(f"{d}/report/total_scores").count() == 1


def test_first_k_is_exact(spark):
    df = spark.range(0, 5000).withColumn("k", (F.col("id") * 7919) % 5003)
    small = [r.id for r in df.orderBy("k", "id").limit(1234).collect()]
    big = [r.id for r in first_k(df, [F.col("k"), F.col("id")], 1234).orderBy("k", "id").collect()]
    assert small == big


def test_alias_numbers_and_nested_names(spark):
    df = spark.createDataFrame([("SELECT SUBORDERSalias0.x , NATIONalias12.y FROM SUBORDERS AS SUBORDERSalias0 , NATION AS NATIONalias12 , "
                                 "NATION AS NATIONalias1",)], "sql string")
    out = A.normalize_aliases(df, "sql", ["suborders", "orders", "nation"]).first()[0]
    assert out == "SELECT T1.x , T3.y FROM SUBORDERS AS T1 , NATION AS T3 , NATION AS T2"


def test_example_ids_follow_the_content(spark, tmp_path):
    rows = [("d", f"q{k % 7}", ["q"], f"text {k % 7}") for k in range(20)]
    df = spark.createDataFrame(rows, "db_id string, query string, query_toks array<string>, question string")
    ids = []
    for n in (1, 5):
        path = str(tmp_path / f"p{n}")
        df.repartition(n).write.json(path)
        ids.append(sorted((r["query"], r["ex_id"]) for r in A.read_single_turn(spark, path, multi_line=False).collect()))
    assert ids[0] == ids[1] and len(set(ids[0])) == 20
