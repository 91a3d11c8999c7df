"""Schema serialization and prompt texts."""

from pyspark.sql import functions as F

from quarry.operators import prompt as P


def _fixture(spark):
    ex = spark.createDataFrame([(1, "db")], "ex_id long, db_id string")
    cols = spark.createDataFrame(
        [("db", 0, "Singer", 1, "Name"), ("db", 0, "Singer", 2, "Age"), ("db", 1, "Concert", 3, "Year"),
         ("db", 2, "Stadium", 4, "City"), ("db", 2, "Stadium", 5, "Capacity")],
        "db_id string, table_id int, table_name string, column_id int, column_name string")
    matches = spark.createDataFrame([(1, "Singer", "Name", ["Ann", "Bo"]), (1, "Stadium", "City", ["Oslo"])],
                                    "ex_id long, table_name string, column_name string, values array<string>")
    return ex, cols, matches


def test_piped_schema_matched_tables_first_reversed(spark):
    ex, cols, m = _fixture(spark)
    s = P.serialize_schema(ex, cols, m, "piped").first().serialized_schema
    # tables with linked values move to the front in reverse order; the rest keep their order
    assert s == " | db | stadium : city ( Oslo ) , capacity | singer : name ( Ann , Bo ) , age | concert : year"


def test_verbose_schema(spark):
    ex, cols, _ = _fixture(spark)
    s = P.serialize_schema(ex, cols, None, "verbose").first().serialized_schema
    assert s == "database: db. table: singer. columns: name, age. table: concert. columns: year. table: stadium. columns: city, capacity"


def test_parse_back_and_prefix_strip(spark):
    text = P.PROMPT + "select [col] from [tab] | question: how many? | database: db. table: singer. columns: name"
    df = spark.createDataFrame([(text, "db | select 1")], "t string, p string")
    st, db = P.parse_back(F.col("t"))
    r = df.select(st.alias("s"), db.alias("d"), P.strip_db_prefix(F.col("p")).alias("q")).first()
    assert (r.s, r.d, r.q) == ("select [col] from [tab]", "db", "select 1")


def test_quoted_token_repair(spark):
    df = spark.createDataFrame([("SELECT Name FROM T WHERE c = `` Oslo ''",)], "s string")
    assert df.select(P.repair_quoted_tokens(F.col("s"))).first()[0] == 'select name from t where c = "Oslo"'


def test_model_inputs(spark):
    df = spark.createDataFrame([(" how many singers ", " | db | singer : name ", ["hi | there ", " more"])],
                               "q string, s string, u array<string>")
    r = df.select(P.model_input(F.col("q"), F.col("s")).alias("a"),
                  P.model_input(F.col("q"), F.col("s"), append_qmark=True).alias("b"),
                  P.dialogue_input(F.col("u"), F.col("s")).alias("c")).first()
    assert r.a == "question: how many singers | | db | singer : name"
    assert r.b == "question: how many singers ? | | db | singer : name"
    assert r.c == "question: hi | there | more | | db | singer : name"
