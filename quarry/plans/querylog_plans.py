"""Registered query-log plans: tokens, segments, difficulty."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import querylog as Q
from ..sources import tables as T
from . import sql_querylog as S
from .registry import register



@register("e01_tokens", T.with_views(f"""WITH {S.tokens_cte('workload', 'gold')}
SELECT query_id, CAST(count(*) AS BIGINT) AS n_tokens, string_agg(tok, ' ' ORDER BY pos) AS tokens,
  CAST(count(*) FILTER (WHERE starts_with(tok, '"')) AS BIGINT) AS n_literals
FROM tok0 GROUP BY query_id""", "workload"), ops="E01")
def e01_tokens(spark, sf_dir):
    t = Q.tokenize(T.workload(spark, sf_dir), "gold")
    return t.groupBy("query_id").agg(
        F.count("*").alias("n_tokens"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"]), " ").alias("tokens"),
        F.count(F.when(F.col("is_lit"), 1)).alias("n_literals"))


@register("e02_odd_quotes", T.with_views("""
SELECT CAST(query_id % 7 AS BIGINT) AS variant, CAST(count(*) AS BIGINT) AS n,
  CAST(sum(CAST((length(replace(pred, '''', '"')) - length(replace(replace(pred, '''', '"'), '"', ''))) % 2 = 1 AS INT)) AS BIGINT) AS n_odd
FROM pairs GROUP BY 1""", "pairs"), ops="E02")
def e02_odd_quotes(spark, sf_dir):
    p = T.pairs(spark, sf_dir)
    return p.groupBy((F.col("query_id") % 7).alias("variant")).agg(
        F.count("*").alias("n"), F.sum(Q.odd_quotes(F.col("pred")).cast("int")).cast("bigint").alias("n_odd"))


@register("e04_segments", T.with_views(f"""WITH {S.tokens_cte('workload', 'gold')}, {S.segment_ctes()}, {S.items_cte()}
SELECT query_id, CAST(sel_depth AS BIGINT) AS sel_depth, CAST(sel_block AS BIGINT) AS sel_block,
  CAST(branch AS BIGINT) AS branch, clause, CAST(item_no AS BIGINT) AS item_no, text, op, CAST(has_not AS BIGINT) AS has_not,
  CAST(n_agg AS BIGINT) AS n_agg
FROM items""", "workload"), ops="E04 E05 E07 E10 E11 E12 E13")
def e04_segments(spark, sf_dir):
    it = Q.segment_facts(T.workload(spark, sf_dir), "gold", Q.items, ("text",))
    return it.select("query_id", *[F.col(c).cast("bigint").alias(c) for c in ("sel_depth", "sel_block", "branch")],
                     "clause", F.col("item_no").cast("bigint").alias("item_no"), "text", "op",
                     F.col("has_not").cast("bigint").alias("has_not"), F.col("n_agg").cast("bigint").alias("n_agg"))


@register("e26_hardness", T.with_views(f"WITH {S.hardness_sql('workload', 'gold')}\nSELECT * FROM feat", "workload"),
          ops="E22 E23 E24 E25 E26")
def e26_hardness(spark, sf_dir):
    return Q.hardness(T.workload(spark, sf_dir), "gold")


DIFFICULTY_SQL = T.with_views(f"""WITH {S.hardness_sql('workload', 'gold')}
SELECT hardness AS level, CAST(count(*) AS BIGINT) AS n_queries,
  CAST(sum(component1) AS BIGINT) AS sum_component1, CAST(sum(component2) AS BIGINT) AS sum_component2,
  CAST(sum(others) AS BIGINT) AS sum_others
FROM feat GROUP BY hardness""", "workload")


@register("difficulty_mix", DIFFICULTY_SQL, ops="E01 E04 E22 E23 E24 E25 E26")
def difficulty_mix(spark, sf_dir):
    """Flagship: the workload's difficulty classes (token table → segments → features)."""
    h = Q.hardness(T.workload(spark, sf_dir), "gold")
    return h.groupBy(F.col("hardness").alias("level")).agg(
        F.count("*").alias("n_queries"), F.sum("component1").cast("bigint").alias("sum_component1"),
        F.sum("component2").cast("bigint").alias("sum_component2"), F.sum("others").cast("bigint").alias("sum_others"))


@register("e03_alias_table", T.with_views(f"""WITH {S.tokens_cte('workload', 'gold')}, {S.segment_ctes()}
SELECT DISTINCT query_id, nxt AS alias, prv AS table_name FROM seg WHERE tok = 'as'""", "workload"), ops="E03")
def e03_alias_table(spark, sf_dir):
    return Q.segment_facts(T.workload(spark, sf_dir), "gold", Q.alias_table, ("alias", "table_name")).distinct()


@register("e11_e12_order_limit", T.with_views(f"""WITH {S.tokens_cte('workload', 'gold')}, {S.segment_ctes()}
SELECT query_id,
  CASE WHEN count(*) FILTER (WHERE kw = 'order') > 0
       THEN coalesce(arg_max(CASE WHEN clause = 'order' AND tok IN ('asc', 'desc') THEN tok END,
                             CASE WHEN clause = 'order' AND tok IN ('asc', 'desc') THEN pos END), 'asc') END AS order_dir,
  count(*) FILTER (WHERE kw = 'limit') > 0 AS has_limit,
  coalesce(CAST(arg_min(CASE WHEN clause = 'limit' AND regexp_matches(tok, '^[0-9]+$') THEN tok END,
               CASE WHEN clause = 'limit' AND regexp_matches(tok, '^[0-9]+$') THEN pos END) AS BIGINT), -1) AS limit_value
FROM seg WHERE sel_depth = 0 AND sel_block = 0 AND branch = 0 GROUP BY query_id""", "workload"), ops="E11 E12")
def e11_e12(spark, sf_dir):
    found = Q.segment_facts(T.workload(spark, sf_dir), "gold", Q.order_and_limit, ("limit_value",))
    return found.withColumn("limit_value", F.col("limit_value").cast("bigint"))


@register("e07_e09_condition_values", T.with_views(f"""WITH {S.tokens_cte('workload', 'gold')}, {S.segment_ctes()},
c AS (SELECT *, min(CASE WHEN at_top AND tok IN {S.OPS} THEN pos END)
        OVER (PARTITION BY query_id, sel_depth, sel_block, branch, clause, item_no) AS op_pos
      FROM seg WHERE clause IN ('on', 'where', 'having')),
b AS (SELECT *, CASE WHEN starts_with(tok, '"') THEN 'string' WHEN regexp_matches(tok, '^[0-9]') THEN 'number'
                     WHEN tok IN ('(', ')', '-', '+', 'not', 'null') THEN NULL ELSE 'column' END AS kind
      FROM c WHERE NOT is_struct AND sbo = 0 AND sbc = 0),
it AS (SELECT query_id, sel_depth, sel_block, branch, clause, item_no,
         arg_min(CASE WHEN at_top AND tok IN {S.OPS} THEN tok END, CASE WHEN at_top AND tok IN {S.OPS} THEN pos END) AS op,
         max(CAST(at_top AND tok = 'not' AS INT)) AS has_not,
         arg_min(CASE WHEN pos > op_pos THEN kind END, CASE WHEN pos > op_pos AND kind IS NOT NULL THEN pos END) AS vkind
       FROM b GROUP BY ALL),
subs AS (SELECT DISTINCT query_id, sel_depth - 1 AS sel_depth, p_sel_block AS sel_block, p_branch AS branch,
           p_clause AS clause, p_item_no AS item_no FROM seg WHERE sbo = 1)
SELECT it.query_id, CAST(it.sel_depth AS BIGINT) AS sel_depth, CAST(it.sel_block AS BIGINT) AS sel_block,
  CAST(it.branch AS BIGINT) AS branch, it.clause, CAST(it.item_no AS BIGINT) AS item_no, op, has_not = 1 AS is_not,
  CASE WHEN s.query_id IS NOT NULL THEN 'subquery' ELSE coalesce(vkind, 'none') END AS value_kind
FROM it LEFT JOIN subs s ON s.query_id = it.query_id AND s.sel_depth = it.sel_depth AND s.sel_block = it.sel_block
  AND s.branch = it.branch AND s.clause = it.clause AND s.item_no = it.item_no""", "workload"), ops="E07 E09 E14")
def e07_e09(spark, sf_dir):
    return Q.segment_facts(T.workload(spark, sf_dir), "gold", Q.condition_values)


@register("e22_keywords", T.with_views(f"""WITH {S.tokens_cte('workload', 'gold')}, {S.segment_ctes()}, {S.items_cte()},
k AS (SELECT query_id, kw AS k FROM seg WHERE sel_depth = 0 AND sel_block = 0 AND branch = 0
        AND kw IN ('where', 'group', 'having', 'order', 'limit')
      UNION SELECT query_id, tok FROM seg WHERE sel_depth = 0 AND sel_block = 0 AND tok IN {S.SETOPS} AND is_struct AND branch = 1
      UNION SELECT query_id, tok FROM seg WHERE sel_depth = 0 AND sel_block = 0 AND branch = 0 AND is_conn AND tok = 'or'
      UNION SELECT query_id, coalesce(arg_max(CASE WHEN clause = 'order' AND tok IN ('asc', 'desc') THEN tok END,
                                              CASE WHEN clause = 'order' AND tok IN ('asc', 'desc') THEN pos END), 'asc')
            FROM seg WHERE sel_depth = 0 AND sel_block = 0 AND branch = 0 GROUP BY query_id HAVING count(*) FILTER (WHERE kw = 'order') > 0
      UNION SELECT query_id, 'not' FROM items WHERE sel_depth = 0 AND branch = 0 AND clause IN ('on', 'where', 'having') AND has_not = 1
      UNION SELECT query_id, 'in' FROM items WHERE sel_depth = 0 AND branch = 0 AND clause IN ('on', 'where', 'having') AND op = 'in'
      UNION SELECT query_id, 'like' FROM items WHERE sel_depth = 0 AND branch = 0 AND clause IN ('on', 'where', 'having') AND op = 'like'),
q AS (SELECT DISTINCT query_id FROM seg)
SELECT q.query_id, coalesce(string_agg(k.k, ',' ORDER BY k.k), '') AS keywords FROM q LEFT JOIN k ON k.query_id = q.query_id
GROUP BY q.query_id""", "workload"), ops="E22 E35")
def e22(spark, sf_dir):
    return Q.segment_facts(T.workload(spark, sf_dir), "gold", Q.keyword_set)
