"""Pair scoring semantics."""

from pyspark.sql import functions as F

from testdata import SF_SMALL
from quarry.operators import catalog as C
from quarry.operators import scoring as S


def _score(spark, pairs):
    df = spark.createDataFrame([(i, g, p) for i, (g, p) in enumerate(pairs)], "query_id long, gold string, pred string")
    cols = C.profile(spark, SF_SMALL)
    comp, rep = S.score_pairs(spark, df, cols, C.foreign_keys(spark, cols), "star")
    return {r.pair_id: r for r in rep.collect()}, comp


def test_identity_and_perturbations(spark):
    g = 'SELECT T1.c_name FROM customer AS T1 JOIN orders AS T2 ON T1.c_custkey = T2.o_custkey WHERE T2.o_orderstatus = "F" ORDER BY T2.o_totalprice DESC LIMIT 1'
    pairs = [
        (g, g),                                                          # identical
        (g, g.lower()),                                                  # literals are masked
        (g, g.replace("T1.c_custkey", "T2.o_custkey")),                  # FK-equivalent ON column
        (g, g.replace(" DESC", " ASC")),                                 # order direction differs
        (g, g.replace("o_orderstatus", "o_status")),                     # unknown column → invalid
        ("SELECT count(*) FROM orders", "SELECT count(DISTINCT o_custkey) FROM orders"),
    ]
    rep, comp = _score(spark, pairs)
    assert [rep[i].exact for i in range(6)] == [1, 1, 1, 0, 0, 0]
    assert rep[4].pred_invalid and not rep[4].gold_invalid
    order = {r.pair_id: r.f1 for r in comp.filter(F.col("comp") == "order").collect()}
    assert order[3] == 0 and order[0] == 1


def test_fk_groups_are_connected_components(spark):
    cols = C.profile(spark, SF_SMALL)
    canon = {r.col_ident: r.canon_ident for r in S.fk_canonical(spark, cols, C.foreign_keys(spark, cols)).collect()}
    assert canon["__supplier.s_nationkey__"] == canon["__customer.c_nationkey__"] == "__nation.n_nationkey__"
    assert canon["__lineitem.l_orderkey__"] == "__orders.o_orderkey__"


def test_zero_items_score_one(spark):
    rep, comp = _score(spark, [("SELECT n_name FROM nation", "SELECT n_name FROM nation")])
    f1 = {r.comp: r.f1 for r in comp.collect()}
    assert f1["where"] == 1 and f1["group"] == 1 and rep[0].exact == 1


def test_outside_subset_is_invalid(spark):
    g = "SELECT n_name FROM nation WHERE n_regionkey = 1"
    preds = ["SELECT n_name FROM nation WHERE n_regionkey IN (1, 2)",       # multi-element IN list
             "SELECT n_name FROM nation WHERE n_regionkey IN (1)",          # single element: fine
             "SELECT n_name FROM nation, region",                           # comma join
             "SELECT n_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey",
             "SELECT n_name FROM nation WHERE n_name IS NULL"]
    rep, _ = _score(spark, [(g, p) for p in preds])
    assert [rep[i].pred_invalid for i in range(5)] == [True, False, True, True, True]


def test_f1_when_acc_and_rec_are_zero(spark):
    # one pair, every component predicted and missed: acc = rec = 0
    comp = spark.createDataFrame([(0, c, 1, 1, 0, 0, 0, 0) for c in ("select", "where")],
                                 "pair_id long, comp string, label_total long, pred_total long, cnt long, acc long, rec long, f1 long")
    rep = spark.createDataFrame([(0, 0, "easy")], "pair_id long, exact long, hardness string")
    f1 = lambda compat: {r.component: r.f1 for r in S.roll_up(comp, rep, compat).filter("level = 'all'").collect()}
    assert f1(True)["select"] == 1.0       # reference quirk kept under compat
    assert f1(False)["select"] == 0.0


def test_fk_propagation_has_no_round_cap(spark):
    n = 20    # a chain: the label needs n-1 rounds to reach the far end
    cols = spark.createDataFrame([("d", i, 0, "t", f"c{i}", "number", False) for i in range(1, n + 1)],
                                 "db_id string, column_id int, table_id int, table_name string, column_name string, "
                                 "column_type string, is_pk boolean")
    fks = spark.createDataFrame([("d", i + 1, i) for i in range(1, n)], "db_id string, column_id int, other_column_id int")
    canon = {r.col_ident: r.canon_ident for r in S.fk_canonical(spark, cols, fks).collect()}
    assert len(canon) == n and set(canon.values()) == {"__t.c1__"}


# Expected values below are derived by hand from the scoring rules.
def test_nested_queries_to_any_depth(spark):
    sub = "SELECT c_name FROM customer WHERE c_custkey IN (SELECT {a}.o_custkey FROM orders AS {a} WHERE {a}.o_totalprice > 5)"
    deep = ("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity IN "
            "(SELECT {c} FROM lineitem{w}))")
    pairs = [
        (sub.format(a="T1"), sub.format(a="T9")),                                        # alias names do not count
        (deep.format(c="l_tax", w=""), deep.format(c="l_discount", w=" WHERE l_tax > 1")),    # differ at depth 2
        (deep.format(c="l_tax", w=""), deep.format(c="l_tax", w="")),
    ]
    rep, comp = _score(spark, pairs)
    assert [rep[i].exact for i in range(3)] == [1, 0, 1]
    where = {r.pair_id: r.f1 for r in comp.filter(F.col("comp") == "where").collect()}
    assert where == {0: 1, 1: 0, 2: 1}


def test_derived_tables_and_having_connectors(spark):
    having = "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1 {} max(o_totalprice) > 2 {} min(o_totalprice) > 3"
    pairs = [
        ("SELECT count(*) FROM (SELECT o_custkey FROM orders)", "SELECT count(*) FROM (SELECT l_orderkey FROM lineitem)"),
        ("SELECT count(*) FROM (SELECT o_custkey FROM orders)", "SELECT count(*) FROM (SELECT o_custkey FROM orders)"),
        (having.format("AND", "OR"), having.format("OR", "AND")),
        (having.format("AND", "OR"), having.format("and", "or")),
    ]
    rep, comp = _score(spark, pairs)
    assert [rep[i].exact for i in range(4)] == [0, 1, 0, 1]
    group = {r.pair_id: r.f1 for r in comp.filter(F.col("comp") == "group").collect()}
    assert group[2] == 0 and group[3] == 1


def test_texts_without_a_query_are_invalid_and_kept(spark):
    g = "SELECT n_name FROM nation"
    pairs = [(g, None), (g, ""), (g, "hello there"), (None, g), ("", ""), (g, "SELECT 1"), (g, "FROM nation"), (g, g + " UNION SELECT 2")]
    rep, _ = _score(spark, pairs)
    assert len(rep) == len(pairs)
    assert [rep[i].pred_invalid for i in range(8)] == [True, True, True, False, True, True, True, True]
    assert rep[3].gold_invalid and rep[4].gold_invalid and rep[3].hardness == rep[4].hardness == "easy"
    assert [rep[i].exact for i in range(8)] == [0, 0, 0, 0, 1, 0, 0, 0]


def test_first_valid_skips_texts_without_a_query(spark):
    from quarry.streaming.hypotheses import pick_first_valid
    cols = C.profile(spark, SF_SMALL)
    canon = S.fk_canonical(spark, cols, C.foreign_keys(spark, cols))
    rows = [(k, n, t) for k, bad in enumerate([None, "", "hello there", "SELECT nothing FROM nowhere"])
            for n, t in enumerate([bad, "SELECT n_name FROM nation"])]
    hyps = spark.createDataFrame(rows, "ex_id long, hyp_rank int, pred string")
    assert {r.pred_sql for r in pick_first_valid(hyps, cols, canon, "star").collect()} == {"SELECT n_name FROM nation"}


def test_many_databases_and_large_catalogs(spark):
    n = 50_000
    big = (spark.range(n).select(F.lit("big").alias("db_id"), (F.col("id") + 1).cast("int").alias("column_id"), F.lit(0).alias("table_id"),
                                 F.lit("wide").alias("table_name"), F.concat(F.lit("c"), F.col("id")).alias("column_name"),
                                 F.lit("number").alias("column_type"), F.lit(False).alias("is_pk")))
    star = C.profile(spark, SF_SMALL)
    cols = big.unionByName(star.select(*big.columns))
    pairs = spark.createDataFrame([
        (0, "SELECT c49999 FROM wide", "SELECT c49999 FROM wide", "big"), (1, "SELECT c49999 FROM wide", "SELECT c50001 FROM wide", "big"),
        (2, "SELECT n_name FROM nation", "SELECT n_name FROM nation", "star"), (3, "SELECT n_name FROM nation", "SELECT n_name FROM nation", "big"),
    ], "query_id long, gold string, pred string, db_id string")
    _, rep = S.score_pairs(spark, pairs, cols, C.foreign_keys(spark, star))
    got = {r.pair_id: (r.exact, r.gold_invalid, r.pred_invalid) for r in rep.collect()}
    assert got == {0: (1, False, False), 1: (0, False, True), 2: (1, False, False), 3: (1, True, True)}
