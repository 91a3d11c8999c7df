"""The user-function surface (H01, H02). The execution plans (E17, E43, G23) run
one job per distinct SQL text from the driver, so they are functions for small
workloads and tests, not registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import udf as H
from ..operators import execution as X
from ..sources import tables as T
from .registry import register


# Oracle: the result size of every workload text, worked out per template
# directly in SQL (DuckDB cannot execute SQL texts held in a column).
G23_SQL = """
SELECT o.o_orderkey AS query_id, true AS ok, CAST(CASE CAST(o.o_orderkey % 8 AS INT)
  WHEN 0 THEN 1
  WHEN 1 THEN (SELECT count(*) FROM (SELECT 1 FROM orders o2 GROUP BY o2.o_orderstatus HAVING count(*) > o.o_custkey) g)
  WHEN 2 THEN least(1, (SELECT count(*) FROM customer c JOIN orders o2 ON c.c_custkey = o2.o_custkey
                        WHERE o2.o_orderstatus = o.o_orderstatus))
  WHEN 3 THEN (SELECT count(DISTINCT o2.o_custkey) FROM orders o2
               WHERE o2.o_totalprice BETWEEN 100 AND o.o_custkey AND o2.o_orderstatus = 'F')
  WHEN 4 THEN (SELECT count(*) FROM customer c WHERE c.c_custkey NOT IN
               (SELECT o2.o_custkey FROM orders o2 WHERE o2.o_orderpriority = o.o_orderpriority))
  WHEN 5 THEN (SELECT count(*) FROM (SELECT n_name FROM nation WHERE n_regionkey = 1
                                     UNION SELECT n_name FROM nation WHERE n_nationkey > 10) u)
  WHEN 6 THEN 1
  ELSE least(1 + o.o_custkey % 9, (SELECT count(DISTINCT n.n_name) FROM orders o2 JOIN customer c ON o2.o_custkey = c.c_custkey
                                    JOIN nation n ON c.c_nationkey = n.n_nationkey
                                    WHERE o2.o_totalprice > (SELECT avg(o_totalprice) FROM orders)))
  END AS BIGINT) AS n_rows
FROM orders o"""


def g23(spark, sf_dir):
    """Every distinct gold text of the workload run once; result row counts per query."""
    T.register_views(spark, sf_dir, T.STAR_TABLES)
    w = T.workload(spark, sf_dir)
    st, rows = X.run_texts(spark, w.select(F.col("gold").alias("sql")))
    counts = rows.groupBy("text_id").agg(F.count("*").alias("n_rows"))
    return (w.withColumn("text_id", F.xxhash64("gold")).join(st.select("text_id", "ok"), "text_id")
             .join(counts, "text_id", "left")
             .select("query_id", "ok", F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows")))


def e43(spark, sf_dir):
    T.register_views(spark, sf_dir, T.STAR_TABLES)
    p = T.pairs(spark, sf_dir).withColumnRenamed("query_id", "pair_id")
    st, rows = X.run_texts(spark, p.select(F.col("gold").alias("sql")).unionByName(p.select(F.col("pred").alias("sql"))))
    return X.bag_match(p, st, rows)


@register("h01_row_map", T.with_views("""
SELECT query_id, CAST(length(gold) AS BIGINT) AS n_chars, CAST(len(string_split(gold, ' ')) AS BIGINT) AS n_words,
  upper(split_part(gold, ' ', 1)) AS verb FROM workload""", "workload"), ops="H01")
def h01(spark, sf_dir):
    return H.row_map(T.workload(spark, sf_dir), H.text_stats, "query_id long, n_chars long, n_words long, verb string")


@register("h02_batched_map", """
SELECT doc_id, lang, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS n_lines FROM documents""",
          ops="H02")
def h02(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return H.batched_map(d, H.line_counts, "doc_id long, lang string, n_lines long", drop=["text"])
