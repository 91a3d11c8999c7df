"""Scoring plans (E16, E18, E27-E42, E45, E46) over the derived ``pairs`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import metrics as M
from ..operators import querylog as Q
from ..operators import scoring as S
from ..sources import corpus as A
from ..sources import tables as T
from .catalog_plans import CATALOG_SQL, STATS_SQL
from .registry import register
from .sql_scoring import scoring_ctes


def _scored(spark, sf_dir):
    cols = C.profile(spark, sf_dir)
    fks = C.foreign_keys(spark, cols)
    return S.score_pairs(spark, T.pairs(spark, sf_dir), cols, fks, T.STAR_DB)


@register("e18_fk_canonical", CATALOG_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + STATS_SQL + """,
e AS (SELECT column_id AS a, other_column_id AS b FROM fks UNION SELECT other_column_id, column_id FROM fks),
reach(node, other) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON r.other = e.a),
lab AS (SELECT node, min(other) AS label FROM reach GROUP BY node)
SELECT c1.db_id, '__' || lower(c1.table_name) || '.' || lower(c1.column_name) || '__' AS col_ident,
  '__' || lower(c2.table_name) || '.' || lower(c2.column_name) || '__' AS canon_ident, n_values
FROM lab JOIN cols c1 ON c1.column_id = lab.node JOIN cols c2 ON c2.column_id = lab.label
JOIN stats s ON s.table_name = c1.table_name AND s.column_name = c1.column_name""", ops="E18")
def e18(spark, sf_dir):
    cols = C.profile(spark, sf_dir)
    ident = F.concat(F.lit("__"), F.lower("table_name"), F.lit("."), F.lower("column_name"), F.lit("__"))
    held = C.column_stats(spark, sf_dir).select("db_id", ident.alias("col_ident"), "n_values")
    return S.fk_canonical(spark, cols, C.foreign_keys(spark, cols)).join(held, ["db_id", "col_ident"])


@register("e36_partial_scores", T.with_views(f"WITH RECURSIVE {scoring_ctes()}\nSELECT * FROM comp", "pairs"), ops="E05 E06 E07 E08 E09 E10 E11 E12 E13 E14 E15 E19 E20 E21 E27 E28 E29 E30 E31 E32 E33 E34 E35 E36")
def e36(spark, sf_dir):
    comp, _ = _scored(spark, sf_dir)
    return comp


@register("e38_pair_report", T.with_views(f"""WITH RECURSIVE {scoring_ctes()}
SELECT r.*, p.pred AS predicted, p.gold AS gold FROM report r JOIN pairs p ON p.query_id = r.pair_id""", "pairs"),
          ops="E16 E37 E38 E39")
def e38(spark, sf_dir):
    """Per pair: predicted, gold, parse-error flags, hardness, exact (partials: e36)."""
    _, rep = _scored(spark, sf_dir)
    p = T.pairs(spark, sf_dir).select(F.col("query_id").alias("pair_id"), F.col("pred").alias("predicted"), "gold")
    return rep.join(p, "pair_id")


ROLLUP_SQL = """,
lv AS (SELECT pair_id, hardness AS level, exact FROM report UNION ALL SELECT pair_id, 'all', exact FROM report),
counts AS (SELECT level, count(*) AS cnt, sum(exact) AS exact_sum FROM lv GROUP BY level),
sums AS (SELECT lv.level, c.comp, sum(CASE WHEN pred_total > 0 THEN acc ELSE 0 END) AS acc_sum,
           count(*) FILTER (WHERE pred_total > 0) AS acc_count,
           sum(CASE WHEN label_total > 0 THEN rec ELSE 0 END) AS rec_sum, count(*) FILTER (WHERE label_total > 0) AS rec_count
         FROM comp c JOIN lv ON lv.pair_id = c.pair_id GROUP BY lv.level, c.comp),
rs2 AS (SELECT *, CASE WHEN acc_count = 0 THEN 0.0 ELSE acc_sum / acc_count END AS acc,
         CASE WHEN rec_count = 0 THEN 0.0 ELSE rec_sum / rec_count END AS rec FROM sums),
scores AS (
  SELECT level, comp AS component, round(acc, 6) AS acc, round(rec, 6) AS rec,
    round(CASE WHEN acc = 0 AND rec = 0 THEN 1.0 ELSE 2.0 * acc * rec / (acc + rec) END, 6) AS f1 FROM rs2
  UNION ALL SELECT level, 'exact match', NULL, NULL, round(exact_sum / cnt, 6) FROM counts
  UNION ALL SELECT level, 'count', NULL, NULL, CAST(cnt AS DOUBLE) FROM counts)"""


@register("e41_score_table", T.with_views(f"WITH RECURSIVE {scoring_ctes()}{ROLLUP_SQL}\nSELECT * FROM scores", "pairs"),
          ops="E40 E41")
def e41(spark, sf_dir):
    comp, rep = _scored(spark, sf_dir)
    return S.roll_up(comp, rep)


@register("e42_score_pivot", T.with_views(f"""WITH RECURSIVE {scoring_ctes()}{ROLLUP_SQL}
SELECT * FROM (PIVOT (SELECT component, level, f1 FROM scores) ON level IN ('easy', 'medium', 'hard', 'extra', 'all')
  USING first(f1) GROUP BY component)""", "pairs"), ops="E42")
def e42(spark, sf_dir):
    comp, rep = _scored(spark, sf_dir)
    return S.pivot_scores(S.roll_up(comp, rep))


@register("e45_final_turn_skip", """
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_scored FROM (
  SELECT conv_id, CAST(turn AS INT) AS turn_idx FROM conversations
  UNION ALL SELECT conv_id, -1 FROM conversations GROUP BY conv_id) t
WHERE turn_idx >= 0 GROUP BY conv_id""", ops="E45")
def e45(spark, sf_dir):
    t = A.dialogue_turns(T.table(spark, sf_dir, "conversations"))
    return t.filter(F.col("turn_idx") >= 0).groupBy("conv_id").agg(F.count("*").alias("n_scored"))


@register("e46_metric_row", T.with_views(f"""WITH RECURSIVE {scoring_ctes()}
SELECT round(avg(exact), 6) AS exact_match, count(*) AS n_pairs FROM report""", "pairs"), ops="E46 H03")
def e46(spark, sf_dir):
    comp, rep = _scored(spark, sf_dir)
    return S.metric_row(rep, mode="exact_match")


@register("h03_user_metric", T.with_views("""
WITH w AS (SELECT query_id % 7 AS variant, list_filter(list_distinct(string_split(gold, ' ')), lambda x: x <> '') AS g,
  list_filter(list_distinct(string_split(pred, ' ')), lambda x: x <> '') AS p FROM pairs),
s AS (SELECT variant, count(*) AS n, sum(len(g)) AS ng, sum(len(p)) AS np, sum(len(list_intersect(g, p))) AS nb FROM w GROUP BY variant)
SELECT variant, n AS n_pairs, round(nb / np, 6) AS word_precision, round(nb / ng, 6) AS word_recall FROM s""", "pairs"), ops="H03")
def h03(spark, sf_dir):
    """A metric registered by name, folded per task and merged per variant."""
    p = T.pairs(spark, sf_dir).withColumn("variant", F.col("query_id") % 7).select("variant", "gold", "pred")
    return M.run_metric(p, "word_overlap", by=("variant",))
