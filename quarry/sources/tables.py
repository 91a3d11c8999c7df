"""Driver tables and the derived text-to-SQL tables built from them.

Every derived table exists twice: as a DataFrame built by Spark from the
driver parquet (so its size grows with the data), and as a DuckDB SQL text
used by the oracle queries (``with_views``). Both are written from the same
definitions (see FIXTURES.md §3) and were checked to return identical rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# The star-schema catalog (table order, foreign keys) used by the
# query-log jobs. Column order and types come from the parquet schemas.
STAR_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
STAR_DB = "star"
STAR_FOREIGN_KEYS = (
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Temp views over the parquet files (lazy; nothing is read here)."""
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def _case_mod(key: Column, m: int, branches: list[Column]) -> Column:
    k = (key % m).cast("int")
    expr = branches[-1]
    for i in range(len(branches) - 2, -1, -1):
        expr = F.when(k == i, branches[i]).otherwise(expr)
    return expr


# ---------------------------------------------------------------- workload
def workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold SQL log: one text per order, eight templates (FIXTURES.md §3)."""
    o = table(spark, sf_dir, "orders")
    s = lambda c: F.col(c).cast("string")
    t = [
        F.concat(F.lit('SELECT count(*) FROM orders WHERE o_orderpriority = "'), F.col("o_orderpriority"), F.lit('"')),
        F.concat(F.lit("SELECT o_orderstatus , sum(o_totalprice) FROM orders GROUP BY o_orderstatus HAVING count(*) > "), s("o_custkey")),
        F.concat(F.lit('SELECT T1.c_name FROM customer AS T1 JOIN orders AS T2 ON T1.c_custkey = T2.o_custkey WHERE T2.o_orderstatus = "'),
                 F.col("o_orderstatus"), F.lit('" ORDER BY T2.o_totalprice DESC LIMIT 1')),
        F.concat(F.lit("SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice BETWEEN 100 AND "), s("o_custkey"),
                 F.lit(' AND o_orderstatus = "F"')),
        F.concat(F.lit('SELECT c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = "'),
                 F.col("o_orderpriority"), F.lit('")')),
        F.lit("SELECT n_name FROM nation WHERE n_regionkey = 1 UNION SELECT n_name FROM nation WHERE n_nationkey > 10"),
        F.concat(F.lit('SELECT avg(c_acctbal) , max(c_acctbal) FROM customer WHERE c_mktsegment LIKE "%'), F.lower("o_orderstatus"),
                 F.lit('%" OR c_nationkey >= '), (F.col("o_custkey") % 25).cast("string")),
        F.concat(F.lit("SELECT T3.n_name , count(*) FROM orders AS T1 JOIN customer AS T2 ON T1.o_custkey = T2.c_custkey "
                       "JOIN nation AS T3 ON T2.c_nationkey = T3.n_nationkey WHERE T1.o_totalprice > (SELECT avg(o_totalprice) FROM orders) "
                       "GROUP BY T3.n_name ORDER BY count(*) DESC LIMIT "), (1 + F.col("o_custkey") % 9).cast("string")),
    ]
    return o.select(F.col("o_orderkey").alias("query_id"), _case_mod(F.col("o_orderkey"), 8, t).alias("gold"))


WORKLOAD_SQL = """
SELECT o_orderkey AS query_id,
 CASE CAST(o_orderkey % 8 AS INT)
  WHEN 0 THEN concat('SELECT count(*) FROM orders WHERE o_orderpriority = "', o_orderpriority, '"')
  WHEN 1 THEN concat('SELECT o_orderstatus , sum(o_totalprice) FROM orders GROUP BY o_orderstatus HAVING count(*) > ', CAST(o_custkey AS VARCHAR(20)))
  WHEN 2 THEN concat('SELECT T1.c_name FROM customer AS T1 JOIN orders AS T2 ON T1.c_custkey = T2.o_custkey WHERE T2.o_orderstatus = "', o_orderstatus, '" ORDER BY T2.o_totalprice DESC LIMIT 1')
  WHEN 3 THEN concat('SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice BETWEEN 100 AND ', CAST(o_custkey AS VARCHAR(20)), ' AND o_orderstatus = "F"')
  WHEN 4 THEN concat('SELECT c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = "', o_orderpriority, '")')
  WHEN 5 THEN 'SELECT n_name FROM nation WHERE n_regionkey = 1 UNION SELECT n_name FROM nation WHERE n_nationkey > 10'
  WHEN 6 THEN concat('SELECT avg(c_acctbal) , max(c_acctbal) FROM customer WHERE c_mktsegment LIKE "%', lower(o_orderstatus), '%" OR c_nationkey >= ', CAST(o_custkey % 25 AS VARCHAR(20)))
  ELSE concat('SELECT T3.n_name , count(*) FROM orders AS T1 JOIN customer AS T2 ON T1.o_custkey = T2.c_custkey JOIN nation AS T3 ON T2.c_nationkey = T3.n_nationkey WHERE T1.o_totalprice > (SELECT avg(o_totalprice) FROM orders) GROUP BY T3.n_name ORDER BY count(*) DESC LIMIT ', CAST(1 + o_custkey % 9 AS VARCHAR(20))) END AS gold
FROM orders"""


# ------------------------------------------------------------------- pairs
def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold/predicted pairs: seven perturbations of the workload."""
    w = workload(spark, sf_dir)
    g = F.col("gold")
    b = [
        g,
        F.lower(g),
        F.replace(g, F.lit("count(*)"), F.lit("count(DISTINCT o_custkey)")),
        F.replace(F.replace(g, F.lit("T1.c_custkey"), F.lit("T2.o_custkey")), F.lit(" DESC"), F.lit(" ASC")),
        F.replace(g, F.lit("o_orderstatus"), F.lit("o_status")),
        F.replace(g, F.lit(" OR "), F.lit(" AND ")),
        F.replace(g, F.lit('"'), F.lit("")),
    ]
    return w.select("query_id", "gold", _case_mod(F.col("query_id"), 7, b).alias("pred"))


PAIRS_SQL = """
SELECT query_id, gold, CASE CAST(query_id % 7 AS INT)
  WHEN 0 THEN gold
  WHEN 1 THEN lower(gold)
  WHEN 2 THEN replace(gold, 'count(*)', 'count(DISTINCT o_custkey)')
  WHEN 3 THEN replace(replace(gold, 'T1.c_custkey', 'T2.o_custkey'), ' DESC', ' ASC')
  WHEN 4 THEN replace(gold, 'o_orderstatus', 'o_status')
  WHEN 5 THEN replace(gold, ' OR ', ' AND ')
  ELSE replace(gold, '"', '') END AS pred FROM workload"""


# -------------------------------------------------------------- hypotheses
def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four ranked candidates per example; valid where (ex_id + rank) % 4 = 0."""
    w = workload(spark, sf_dir)
    ranks = F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("hyp_rank")
    x = w.select(F.col("query_id").alias("ex_id"), "gold", ranks)
    g = F.col("gold")
    pred = (F.when((F.col("ex_id") + F.col("hyp_rank")) % 4 == 0, g)
            .when(F.col("hyp_rank") == 0, F.replace(g, F.lit("c_"), F.lit("cc_")))
            .when(F.col("hyp_rank") == 1, F.replace(g, F.lit(")"), F.lit("")))
            .otherwise(F.replace(g, F.lit("orders"), F.lit("order_table"))))
    return x.select("ex_id", F.col("hyp_rank").cast("int").alias("hyp_rank"), pred.alias("pred"))


HYPOTHESES_SQL = """
SELECT query_id AS ex_id, r AS hyp_rank, CASE WHEN (query_id + r) % 4 = 0 THEN gold WHEN r = 0 THEN replace(gold, 'c_', 'cc_')
  WHEN r = 1 THEN replace(gold, ')', '') ELSE replace(gold, 'orders', 'order_table') END AS pred
FROM workload CROSS JOIN (SELECT 0 AS r UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) k"""


# --------------------------------------------------------------- questions
def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value-linking input: one question per part (exact values, case changes, plural drift)."""
    p = table(spark, sf_dir, "part")
    q = [
        F.concat(F.lit("Which suppliers sell the "), F.col("p_name"), F.lit(" from "), F.col("p_brand"), F.lit("?")),
        F.concat(F.lit("How many "), F.lower("p_type"), F.lit(" parts of size "), F.col("p_size").cast("string"), F.lit(" do we have?")),
        F.concat(F.lit("List all "), F.upper("p_name"), F.lit(" parts")),
        F.concat(F.lit("What is the price of "), F.col("p_name"), F.lit("s in stock, brand "), F.col("p_brand")),
    ]
    return p.select(F.col("p_partkey").alias("ex_id"), F.lit(STAR_DB).alias("db_id"),
                    _case_mod(F.col("p_partkey"), 4, q).alias("question"))


QUESTIONS_SQL = """
SELECT p_partkey AS ex_id, 'star' AS db_id,
 CASE CAST(p_partkey % 4 AS INT)
  WHEN 0 THEN concat('Which suppliers sell the ', p_name, ' from ', p_brand, '?')
  WHEN 1 THEN concat('How many ', lower(p_type), ' parts of size ', CAST(p_size AS VARCHAR(20)), ' do we have?')
  WHEN 2 THEN concat('List all ', upper(p_name), ' parts')
  ELSE concat('What is the price of ', p_name, 's in stock, brand ', p_brand) END AS question
FROM part"""


DERIVED_SQL = {
    "workload": WORKLOAD_SQL,
    "pairs": PAIRS_SQL,
    "hypotheses": HYPOTHESES_SQL,
    "questions": QUESTIONS_SQL,
}
_DERIVED_DEPS = {"pairs": ["workload"], "hypotheses": ["workload"]}


def with_views(sql: str, *names: str) -> str:
    """Prefix an oracle query with the derived tables it reads, as CTEs."""
    order: list[str] = []
    for n in names:
        for d in _DERIVED_DEPS.get(n, []) + [n]:
            if d not in order:
                order.append(d)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({DERIVED_SQL[n]})" for n in order)
    body = sql.lstrip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{body[14:]}"
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:]}"
    return f"WITH {ctes}\n{body}"
