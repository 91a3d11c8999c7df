"""DuckDB texts of the query-log jobs (oracle side of the correctness gate).

Written independently of the DataFrame code in ``operators/querylog.py`` as
plain window SQL over the same token table, so the two engines cross-check
the segmentation recipe.
"""

from __future__ import annotations

from ..functions.fixed import AGG_OPS, SQL_OPS, TOKEN_PATTERN, WHERE_OPS


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


AGGS = _in([a for a in AGG_OPS if a != "none"])
OPS = _in([o for o in WHERE_OPS if o != "not"])
SETOPS = _in(SQL_OPS)
RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def tokens_cte(src: str, text_col: str, id_col: str = "query_id", name: str = "tok0") -> str:
    return f"""{name} AS (
  SELECT query_id, unnest(generate_series(0, len(t) - 1)) AS pos, unnest(t) AS tok
  FROM (SELECT {id_col} AS query_id,
          list_transform(regexp_extract_all(replace({text_col}, '''', '"'), '{TOKEN_PATTERN}', 0),
                         lambda x: CASE WHEN starts_with(x, '"') THEN x ELSE lower(x) END) AS t
        FROM {src}) z)"""


def segment_ctes(src: str = "tok0", out: str = "seg") -> str:
    return f"""s1 AS (
  SELECT *, CAST(tok = '(' AS INT) AS open, CAST(tok = ')' AS INT) AS close,
    lag(tok) OVER (PARTITION BY query_id ORDER BY pos) AS prv,
    lead(tok) OVER (PARTITION BY query_id ORDER BY pos) AS nxt FROM {src}),
s2 AS (SELECT *, sum(open - close) OVER (PARTITION BY query_id ORDER BY pos {RUN}) + close AS depth FROM s1),
s3 AS (SELECT *, sum(open) OVER (PARTITION BY query_id, depth ORDER BY pos {RUN}) AS blk FROM s2),
s4 AS (SELECT *, first_value(coalesce(CAST(open = 1 AND nxt = 'select' AS INT), 0))
         OVER (PARTITION BY query_id, depth, blk ORDER BY pos) AS sb,
       first_value(coalesce(CAST(open = 1 AND prv = 'in' AND nxt <> 'select' AS INT), 0))
         OVER (PARTITION BY query_id, depth, blk ORDER BY pos) AS in_list FROM s3),
s5 AS (SELECT *, open * sb AS sbo, close * sb AS sbc FROM s4),
s6 AS (SELECT *, sum(sbo - sbc) OVER (PARTITION BY query_id ORDER BY pos {RUN}) + sbc AS sel_depth FROM s5),
s7 AS (SELECT *, sum(sbo) OVER (PARTITION BY query_id, sel_depth ORDER BY pos {RUN}) AS sel_block FROM s6),
s8 AS (SELECT *, sum(CAST(tok IN {SETOPS} AS INT)) OVER (PARTITION BY query_id, sel_depth, sel_block ORDER BY pos {RUN}) AS branch,
    CASE WHEN tok IN ('select', 'from', 'where', 'group', 'having', 'order', 'limit') THEN tok
         WHEN tok = 'join' THEN 'from' WHEN tok = 'on' THEN 'on' END AS kw FROM s7),
s9 AS (SELECT *, last_value(kw IGNORE NULLS) OVER (PARTITION BY query_id, sel_depth, sel_block, branch ORDER BY pos {RUN}) AS clause,
    min(depth) OVER (PARTITION BY query_id, sel_depth, sel_block) AS block_depth FROM s8),
s10 AS (SELECT *, depth = block_depth AS at_top,
    last_value(CASE WHEN tok IN ('between', 'and', 'or') THEN tok END IGNORE NULLS) OVER (
      PARTITION BY query_id, sel_depth, sel_block, branch, clause ORDER BY pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_bao FROM s9),
s11 AS (SELECT *,
    coalesce(clause IN ('on', 'where', 'having') AND at_top AND tok IN ('and', 'or')
             AND NOT (tok = 'and' AND coalesce(prev_bao = 'between', false)), false) AS is_conn,
    coalesce(at_top AND ((tok = ',' AND clause IN ('select', 'from', 'group', 'order'))
                         OR (tok = 'join' AND clause = 'from')), false) AS is_sep FROM s10),
{out}0 AS (SELECT *,
    sum(CAST(is_conn OR is_sep OR tok = 'on' AS INT)) OVER (
      PARTITION BY query_id, sel_depth, sel_block, branch, clause ORDER BY pos {RUN}) AS item_no,
    coalesce(kw IS NOT NULL OR is_conn OR is_sep OR tok IN {SETOPS}
             OR (tok = 'by' AND prv IN ('group', 'order')) OR (tok = 'distinct' AND prv = 'select'), false) AS is_struct,
    CASE WHEN sbo = 1 THEN lag(sel_block) OVER (PARTITION BY query_id ORDER BY pos) END AS p_sel_block,
    CASE WHEN sbo = 1 THEN lag(branch) OVER (PARTITION BY query_id ORDER BY pos) END AS p_branch,
    CASE WHEN sbo = 1 THEN lag(clause) OVER (PARTITION BY query_id ORDER BY pos) END AS p_clause
  FROM s11),
{out} AS (SELECT *, CASE WHEN sbo = 1 THEN lag(item_no) OVER (PARTITION BY query_id ORDER BY pos) END AS p_item_no FROM {out}0)"""


def items_cte(seg: str = "seg", out: str = "items") -> str:
    op = f"at_top AND tok IN {OPS}"
    return f"""{out} AS (
  SELECT query_id, sel_depth, sel_block, branch, clause, item_no,
    string_agg(tok, ' ' ORDER BY pos) AS text, arg_min(tok, pos) AS first_tok,
    arg_min(CASE WHEN {op} THEN tok END, CASE WHEN {op} THEN pos END) AS op,
    max(CAST(at_top AND tok = 'not' AS INT)) AS has_not,
    sum(CAST(tok IN {AGGS} AND nxt = '(' AS INT)) AS n_agg, min(pos) AS pos
  FROM {seg} WHERE NOT is_struct AND clause IS NOT NULL AND sbo = 0 AND sbc = 0
  GROUP BY query_id, sel_depth, sel_block, branch, clause, item_no)"""


def features_ctes(seg: str = "seg", items: str = "items", out: str = "feat", compat: bool = True) -> str:
    cond_agg = "has_not = 1" if compat else "n_agg > 0"
    having_conn = "n_having_conn" if compat else "0"
    return f"""fi AS (
  SELECT query_id,
    count(*) FILTER (WHERE clause = 'select') AS n_select,
    count(*) FILTER (WHERE clause = 'select' AND first_tok IN {AGGS}) AS n_select_agg,
    count(*) FILTER (WHERE clause = 'where') AS n_where,
    count(*) FILTER (WHERE clause = 'where' AND {cond_agg}) AS n_where_agg,
    count(*) FILTER (WHERE clause = 'group') AS n_group,
    count(*) FILTER (WHERE clause = 'group' AND first_tok IN {AGGS}) AS n_group_agg,
    coalesce(sum(n_agg) FILTER (WHERE clause = 'order'), 0) AS n_order_agg,
    count(*) FILTER (WHERE clause = 'having' AND {cond_agg}) AS n_having_agg,
    count(*) FILTER (WHERE clause IN ('on', 'where', 'having') AND op = 'like') AS n_like
  FROM {items} WHERE sel_depth = 0 AND branch = 0 GROUP BY query_id),
ft AS (
  SELECT query_id,
    count(*) FILTER (WHERE sel_depth = 0 AND sel_block = 0 AND branch = 0 AND kw = 'where') > 0 AS has_where,
    count(*) FILTER (WHERE sel_depth = 0 AND sel_block = 0 AND branch = 0 AND kw = 'group') > 0 AS has_group,
    count(*) FILTER (WHERE sel_depth = 0 AND sel_block = 0 AND branch = 0 AND kw = 'order') > 0 AS has_order,
    count(*) FILTER (WHERE sel_depth = 0 AND sel_block = 0 AND branch = 0 AND kw = 'limit') > 0 AS has_limit,
    count(*) FILTER (WHERE sel_depth = 0 AND sel_block = 0 AND branch = 0 AND clause = 'from' AND at_top
                     AND tok IN ('from', 'join', ',')) AS n_tables,
    count(*) FILTER (WHERE sel_depth = 0 AND sel_block = 0 AND branch = 0 AND is_conn AND tok = 'or') AS n_or,
    count(*) FILTER (WHERE sel_depth = 0 AND sel_block = 0 AND branch = 0 AND is_conn AND clause = 'having') AS n_having_conn,
    count(*) FILTER (WHERE sbo = 1 AND sel_depth = 1 AND p_sel_block = 0 AND p_branch = 0
                     AND p_clause IN ('on', 'where', 'having')) AS n_nested,
    coalesce(max(branch) FILTER (WHERE sel_depth = 0 AND sel_block = 0), 0) AS max_branch
  FROM {seg} GROUP BY query_id),
fj AS (
  SELECT ft.query_id,
    CAST(has_where AS INT) + CAST(has_group AS INT) + CAST(has_order AS INT) + CAST(has_limit AS INT)
      + greatest(n_tables - 1, 0) + n_or + coalesce(n_like, 0) AS c1,
    n_nested + CAST(max_branch > 0 AS INT) AS c2,
    CAST(coalesce(n_select_agg + n_where_agg + n_group_agg + n_order_agg + n_having_agg, 0) + {having_conn} > 1 AS INT)
      + CAST(coalesce(n_select, 0) > 1 AS INT) + CAST(coalesce(n_where, 0) > 1 AS INT)
      + CAST(coalesce(n_group, 0) > 1 AS INT) AS oth
  FROM ft LEFT JOIN fi ON ft.query_id = fi.query_id),
{out} AS (
  SELECT query_id, CAST(c1 AS BIGINT) AS component1, CAST(c2 AS BIGINT) AS component2, CAST(oth AS BIGINT) AS others,
    CASE WHEN c1 <= 1 AND oth = 0 AND c2 = 0 THEN 'easy'
         WHEN (oth <= 2 AND c1 <= 1 AND c2 = 0) OR (c1 <= 2 AND oth < 2 AND c2 = 0) THEN 'medium'
         WHEN (oth > 2 AND c1 <= 2 AND c2 = 0) OR (c1 > 2 AND c1 <= 3 AND oth <= 2 AND c2 = 0)
              OR (c1 <= 1 AND oth = 0 AND c2 <= 1) THEN 'hard'
         ELSE 'extra' END AS hardness
  FROM fj)"""


def hardness_sql(src: str, text_col: str, id_col: str = "query_id", compat: bool = True) -> str:
    """CTE list ending in ``feat(query_id, component1, component2, others, hardness)``."""
    return ",\n".join([tokens_cte(src, text_col, id_col), segment_ctes(), items_cte(),
                       features_ctes(compat=compat)])
