"""Execution match: batched runner + bag comparison == one-by-one execution."""

from testdata import SF_SMALL

from quarry.operators import execution as X
from quarry.sources import tables as T


def test_runner_and_bag_match(spark):
    T.register_views(spark, SF_SMALL, T.STAR_TABLES)
    pairs = [
        (0, "SELECT n_name FROM nation WHERE n_regionkey = 1", "SELECT n_name FROM nation WHERE n_regionkey = 1"),
        (1, "SELECT n_name FROM nation WHERE n_regionkey = 1", "SELECT n_name FROM nation WHERE n_regionkey = 2"),
        (2, "SELECT count(*) FROM orders", "SELECT count(*) FROM orderz"),
        (3, "SELECT r_name FROM region WHERE r_name LIKE '%asia%'", "SELECT r_name FROM region WHERE r_name = 'ASIA'"),
    ]
    df = spark.createDataFrame(pairs, "pair_id long, gold string, pred string")
    texts = df.selectExpr("gold AS sql").unionByName(df.selectExpr("pred AS sql"))
    st, rows = X.run_texts(spark, texts, batch=2)
    got = {r.pair_id: r.exec_match for r in X.bag_match(df, st, rows).collect()}
    assert got == {0: 1, 1: 0, 2: 0, 3: 1}      # LIKE ignores case as in SQLite
    assert not X.executable(spark, "SELECT nope FROM nation")


def test_column_order_does_not_matter(spark):
    T.register_views(spark, SF_SMALL, T.STAR_TABLES)
    df = spark.createDataFrame([(0, "SELECT n_name, n_regionkey FROM nation", "SELECT n_regionkey, n_name FROM nation"),
                                (1, "SELECT n_name FROM nation", "SELECT n_name, n_regionkey FROM nation")],
                               "pair_id long, gold string, pred string")
    texts = df.selectExpr("gold AS sql").unionByName(df.selectExpr("pred AS sql"))
    st, rows = X.run_texts(spark, texts)
    assert {r.pair_id: r.exec_match for r in X.bag_match(df, st, rows).collect()} == {0: 1, 1: 0}


def test_multi_instance_match(spark):
    pairs = spark.createDataFrame(
        [(0, "SELECT r_name FROM region", "SELECT r_name FROM region"),
         (1, "SELECT count(*) FROM orders", "SELECT count(*) FROM orders WHERE o_orderkey < 1500")],
        "pair_id long, gold string, pred string")
    inst = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]
    one = X.multi_instance_match(spark, pairs, inst[:1], lambda d: T.register_views(spark, d, T.STAR_TABLES))
    both = X.multi_instance_match(spark, pairs, inst, lambda d: T.register_views(spark, d, T.STAR_TABLES))
    assert {r.pair_id: r.exec_match for r in one.collect()} == {0: 1, 1: 1}
    assert {r.pair_id: r.exec_match for r in both.collect()} == {0: 1, 1: 0}
