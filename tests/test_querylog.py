"""Query-log segmentation and difficulty classes."""

import pytest
from testdata import SF_MID
from pyspark.sql import functions as F

from quarry.operators import querylog as Q
from quarry.sources import tables as T

# FIXTURES.md §3: hand-derived class of every workload template
EXPECTED = {0: (1, 0, 0, "easy"), 1: (1, 0, 1, "medium"), 2: (4, 0, 0, "extra"), 3: (1, 0, 1, "medium"),
            4: (1, 1, 0, "hard"), 5: (1, 1, 0, "hard"), 6: (3, 0, 3, "extra"), 7: (6, 1, 2, "extra")}


def _hard(spark, texts, compat=True):
    df = spark.createDataFrame(list(enumerate(texts)), "query_id long, sql string")
    return {r.query_id: (r.component1, r.component2, r.others, r.hardness)
            for r in Q.hardness(df, "sql", compat=compat).collect()}


def test_workload_templates(spark):
    h = Q.hardness(T.workload(spark, SF_MID), "gold")
    got = {(r.t, r.component1, r.component2, r.others, r.hardness)
           for r in h.select((F.col("query_id") % 8).alias("t"), "component1", "component2", "others", "hardness").distinct().collect()}
    assert got == {(t,) + v for t, v in EXPECTED.items()}


def test_between_and_is_not_a_connector(spark):
    h = _hard(spark, ["SELECT a FROM t WHERE x BETWEEN 1 AND 2",
                      "SELECT a FROM t WHERE x BETWEEN 1 AND 2 AND y = 3"])
    assert h[0][2] == 0 and h[1][2] == 1     # "others": more than one condition only in the second


def test_not_counts_as_aggregate_only_in_compat(spark):
    texts = ["SELECT a FROM t WHERE x NOT IN (SELECT b FROM u) AND y NOT LIKE 'z'"]
    assert _hard(spark, texts, compat=True)[0][2] == 2      # two NOT conditions → aggregates > 1, conditions > 1
    assert _hard(spark, texts, compat=False)[0][2] == 1


def test_union_chain_counts_once(spark):
    h = _hard(spark, ["SELECT a FROM t UNION SELECT a FROM u UNION SELECT a FROM v"])
    assert h[0][1] == 1


def test_alias_renaming_keeps_class(spark):
    a = "SELECT T1.a FROM t AS T1 JOIN u AS T2 ON T1.k = T2.k WHERE T2.b = 1 ORDER BY T1.a LIMIT 3"
    b = a.replace("T1", "X9").replace("T2", "Y7")
    h = _hard(spark, [a, b])
    assert h[0] == h[1]


def test_odd_quotes(spark):
    df = spark.createDataFrame([("SELECT 'a",), ("SELECT 'a'",)], "s string")
    assert [r[0] for r in df.select(Q.odd_quotes(F.col("s"))).collect()] == [True, False]


TEXTS = [(1, "SELECT a AS b FROM t AS x WHERE y = 'Q' AND z > 10 ORDER BY a DESC LIMIT 7"), (2, "SELECT a AS b FROM t AS x WHERE y = 'R' AND z > 20 ORDER BY a DESC LIMIT 9"),
         (3, "SELECT a FROM t AS 'Lit' WHERE y IN (SELECT z FROM u WHERE k LIKE 'A%') OR n NOT IN (1, 2.5)"), (4, "SELECT a FROM t LIMIT 2.5"), (5, ""), (6, None),
         (7, "SELECT a FROM t WHERE b = 'x'"), (7, "SELECT c AS d FROM t LIMIT 3"), (8, "SELECT a FROM t WHERE b = 1"), (8, "SELECT a FROM t WHERE b = 1"),
         (None, "SELECT a FROM t ORDER BY a"), (9, "SELECT a FROM t UNION SELECT b AS c FROM u")]
FACTS = [(Q.items, ("text",)), (Q.alias_table, ("alias", "table_name")), (Q.order_and_limit, ("limit_value",)), (Q.condition_values, ()), (Q.keyword_set, ())]


@pytest.mark.parametrize("facts,with_marks", FACTS)
def test_facts_of_shapes_are_those_of_the_texts(spark, facts, with_marks):
    df = spark.createDataFrame(TEXTS, "query_id long, gold string")
    want = facts(Q.segment(df, "gold"))
    columns = [c for c in want.columns if c != "first_tok"]         # a literal shows as its shape's
    rows = lambda x: sorted(map(str, x.select(*columns).collect()))
    assert rows(Q.segment_facts(df, "gold", facts, with_marks)) == rows(want)


def test_texts_of_one_shape_are_segmented_once(spark, monkeypatch):
    seen, plain = [], Q.token_rows
    monkeypatch.setattr(Q, "token_rows", lambda df, *a: seen.append(df.count()) or plain(df, *a))
    df = spark.createDataFrame([(k, f"SELECT a FROM t WHERE b = {k} LIMIT {k}") for k in range(40)], "query_id long, gold string")
    got = {r.query_id: r.limit_value for r in Q.segment_facts(df, "gold", Q.order_and_limit, ("limit_value",)).collect()}
    assert seen == [1] and got == {k: str(k) for k in range(40)}
