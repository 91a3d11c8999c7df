"""DuckDB texts of the pair-scoring job (oracle side), written as joins over
the token table rather than the windows/literal lookups of the Spark side."""

from __future__ import annotations

from ..functions.fixed import PARTIAL_TYPES
from ..operators.scoring import MASK, NOT_COLUMNS
from .catalog_plans import CATALOG_SQL
from .sql_querylog import OPS, SETOPS, _in, features_ctes, items_cte, segment_ctes, tokens_cte

CATALOG_CTES = CATALOG_SQL[len("WITH "):]
_COMPS = ", ".join(f"('{c}')" for c in PARTIAL_TYPES)


PAIR_SIDES = """SELECT query_id * 2 AS qid, query_id AS pair_id, 0 AS side, gold AS sql FROM pairs
          UNION ALL SELECT query_id * 2 + 1, query_id, 1, pred FROM pairs"""


def scoring_ctes(sides_sql: str = PAIR_SIDES) -> str:
    """CTEs over ``pairs`` ending in ``comp`` (per pair × component) and ``report`` (per pair);
    ``bad(query_id)`` lists the texts that fail E02/E16 or are unbalanced."""
    ref_re = r"^([a-z_][a-z0-9_.]*|\*)$"
    return f"""{CATALOG_CTES},
e AS (SELECT column_id AS a, other_column_id AS b FROM fks UNION SELECT other_column_id, column_id FROM fks),
reach(node, other) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON r.other = e.a),
lab AS (SELECT node, min(other) AS label FROM reach GROUP BY node),
canon AS (SELECT '__' || lower(c1.table_name) || '.' || lower(c1.column_name) || '__' AS col_ident,
            '__' || lower(c2.table_name) || '.' || lower(c2.column_name) || '__' AS canon_ident,
            lower(c1.table_name) AS ctable
          FROM lab JOIN cols c1 ON c1.column_id = lab.node JOIN cols c2 ON c2.column_id = lab.label),
catc AS (SELECT lower(table_name) AS ct, lower(column_name) AS cc FROM cols WHERE column_id > 0),
catt AS (SELECT DISTINCT ct FROM catc),
sides AS ({sides_sql}),
{tokens_cte('sides', 'sql', 'qid')},
{segment_ctes()},
ftab AS (SELECT query_id, sel_depth, sel_block, branch, pos, tok FROM seg
         WHERE clause = 'from' AND at_top AND NOT is_struct AND tok <> 'as' AND NOT coalesce(prv = 'as', false)
           AND tok NOT IN ('(', ')')),
aliases AS (SELECT query_id, nxt AS a, min(prv) AS t FROM seg WHERE tok = 'as' GROUP BY query_id, nxt),
refs AS (SELECT * FROM seg WHERE clause IN ('select', 'where', 'group', 'having', 'order', 'on') AND NOT is_struct
           AND NOT starts_with(tok, '"') AND regexp_matches(tok, '{ref_re}') AND tok NOT IN {_in(NOT_COLUMNS)}
           AND sbo = 0 AND sbc = 0),
dotted AS (SELECT r.query_id, r.pos, coalesce(al.t, split_part(r.tok, '.', 1)) AS rtable,
             split_part(r.tok, '.', -1) AS rcol
           FROM refs r LEFT JOIN aliases al ON al.query_id = r.query_id AND al.a = split_part(r.tok, '.', 1)
           WHERE contains(r.tok, '.')),
bare AS (SELECT r.query_id, r.pos, arg_min(f.tok, f.pos) AS rtable, r.tok AS rcol
         FROM refs r LEFT JOIN ftab f ON f.query_id = r.query_id AND f.sel_depth = r.sel_depth
              AND f.sel_block = r.sel_block AND f.branch = r.branch
              AND EXISTS (SELECT 1 FROM catc WHERE ct = f.tok AND cc = r.tok)
         WHERE NOT contains(r.tok, '.') AND r.tok <> '*' GROUP BY r.query_id, r.pos, r.tok),
res0 AS (SELECT query_id, pos, '__all__' AS ident, CAST(NULL AS VARCHAR) AS rtable FROM refs WHERE tok = '*'
         UNION ALL
         SELECT d.query_id, d.pos, CASE WHEN c.ct IS NOT NULL THEN '__' || d.rtable || '.' || d.rcol || '__' END, d.rtable
         FROM (SELECT * FROM dotted UNION ALL SELECT * FROM bare) d LEFT JOIN catc c ON c.ct = d.rtable AND c.cc = d.rcol),
scope AS (SELECT DISTINCT query_id, tok AS rtable FROM ftab WHERE sel_depth = 0 AND branch = 0),
res AS (SELECT r.query_id, r.pos, r.ident AS ident0,
          CASE WHEN sc.rtable IS NOT NULL AND cn.canon_ident IS NOT NULL THEN cn.canon_ident ELSE r.ident END AS ident
        FROM res0 r LEFT JOIN scope sc ON sc.query_id = r.query_id AND sc.rtable = r.rtable
        LEFT JOIN canon cn ON cn.col_ident = r.ident),
bad AS (SELECT DISTINCT query_id FROM res WHERE ident0 IS NULL
        UNION SELECT DISTINCT query_id FROM ftab WHERE tok NOT IN (SELECT ct FROM catt)
        UNION SELECT DISTINCT query_id FROM seg
              WHERE tok IN ('exists', 'is')
                 OR (clause = 'from' AND tok IN ('left', 'right', 'outer', 'full', 'cross', 'natural'))
                 OR (clause = 'from' AND at_top AND tok = ',')
                 OR (clause = 'from' AND tok = 'as' AND prv = ')')
                 OR (tok = ',' AND in_list = 1)
        UNION SELECT query_id FROM seg GROUP BY query_id
              HAVING sum(length(tok) - length(replace(tok, '"', ''))) % 2 <> 0 OR sum(open) <> sum(close)),
rs AS (SELECT s.*, r.ident, b.query_id IS NOT NULL AS invalid,
         CASE WHEN r.ident IS NOT NULL THEN r.ident WHEN starts_with(s.tok, '"') OR regexp_matches(s.tok, '^[0-9]') THEN '{MASK}'
              WHEN s.tok = 'distinct' THEN NULL ELSE s.tok END AS sig
       FROM seg s LEFT JOIN res r ON r.query_id = s.query_id AND r.pos = s.pos LEFT JOIN bad b ON b.query_id = s.query_id),
rv AS (SELECT *, min(CASE WHEN at_top AND tok IN {OPS} THEN pos END)
         OVER (PARTITION BY query_id, sel_depth, sel_block, branch, clause, item_no) AS op_pos FROM rs WHERE NOT invalid),
subs AS (SELECT query_id, sel_depth, sel_block, string_agg(sig, ' ' ORDER BY pos) AS sub_sig FROM rv
         WHERE sel_depth >= 1 AND sig IS NOT NULL GROUP BY ALL),
nested AS (SELECT o.query_id, o.sel_depth - 1 AS sel_depth, o.p_sel_block AS sel_block, o.p_branch AS branch,
             o.p_clause AS clause, o.p_item_no AS item_no, string_agg(s.sub_sig, ' ; ' ORDER BY s.sub_sig) AS nested
           FROM rv o JOIN subs s ON s.query_id = o.query_id AND s.sel_depth = o.sel_depth AND s.sel_block = o.sel_block
           WHERE o.sbo = 1 GROUP BY ALL),
it AS (SELECT query_id, sel_depth, sel_block, branch, clause, item_no,
         string_agg(sig, ' ' ORDER BY pos) AS text,
         coalesce(string_agg(CASE WHEN pos < op_pos AND tok <> 'not' THEN sig END, ' ' ORDER BY pos), '') AS lhs,
         max(CASE WHEN at_top AND tok = 'not' THEN 1 ELSE 0 END) AS has_not,
         arg_min(CASE WHEN at_top AND tok IN {OPS} THEN tok END, CASE WHEN at_top AND tok IN {OPS} THEN pos END) AS op,
         min(pos) AS ipos
       FROM rv WHERE NOT is_struct AND clause IS NOT NULL AND sbo = 0 AND sbc = 0 AND sel_depth = 0 AND sig IS NOT NULL
       GROUP BY ALL),
itn AS (SELECT it.*, n.nested,
          concat_ws('|', CASE WHEN has_not = 1 THEN 'not' ELSE '' END, coalesce(op, ''), lhs, coalesce(n.nested, '{MASK}')) AS cond
        FROM it LEFT JOIN nested n ON n.query_id = it.query_id AND n.sel_depth = it.sel_depth AND n.sel_block = it.sel_block
          AND n.branch = it.branch AND n.clause = it.clause AND n.item_no = it.item_no),
top AS (SELECT * FROM rv WHERE sel_depth = 0 AND sel_block = 0),
bw AS (SELECT query_id, branch, max(CAST(kw = 'group' AS INT)) AS has_group, max(CAST(kw = 'order' AS INT)) AS has_order,
         max(CAST(kw = 'limit' AS INT)) AS has_limit,
         arg_max(CASE WHEN clause = 'order' AND tok IN ('asc', 'desc') THEN tok END,
                 CASE WHEN clause = 'order' AND tok IN ('asc', 'desc') THEN pos END) AS dir,
         coalesce(array_to_string(list_sort(list_distinct(list(tok) FILTER (WHERE is_conn AND clause = 'where'))), ','), '') AS ao
       FROM top GROUP BY query_id, branch),
og AS (SELECT query_id, branch,
         coalesce(string_agg(text, ' , ' ORDER BY ipos) FILTER (WHERE clause = 'group'), '') AS group_list,
         coalesce(string_agg(cond, ' & ' ORDER BY ipos) FILTER (WHERE clause = 'having'), '') AS having_sig,
         coalesce(string_agg(trim(regexp_replace(text, '\\b(asc|desc)\\b', '', 'g')), ' , ' ORDER BY ipos) FILTER (WHERE clause = 'order'), '') AS order_list
       FROM itn GROUP BY query_id, branch),
bwo AS (SELECT bw.*, coalesce(og.group_list, '') AS group_list, coalesce(og.having_sig, '') AS having_sig,
          coalesce(og.order_list, '') AS order_list
        FROM bw LEFT JOIN og ON og.query_id = bw.query_id AND og.branch = bw.branch),
setops AS (SELECT query_id, branch - 1 AS branch, tok AS sig FROM top WHERE tok IN {SETOPS} AND is_struct),
ci AS (
  SELECT query_id, branch, 'select' AS comp, text AS sig FROM itn WHERE clause = 'select'
  UNION ALL SELECT query_id, branch, 'select(no AGG)', regexp_replace(text, '^(max|min|count|sum|avg) \\( (.*) \\)$', '\\2') FROM itn WHERE clause = 'select'
  UNION ALL SELECT query_id, branch, 'where', cond FROM itn WHERE clause = 'where'
  UNION ALL SELECT query_id, branch, 'where(no OP)', lhs FROM itn WHERE clause = 'where'
  UNION ALL SELECT query_id, branch, 'group(no Having)', CASE WHEN contains(text, '.') THEN split_part(text, '.', -1) ELSE text END
            FROM itn WHERE clause = 'group'
  UNION ALL SELECT query_id, branch, 'group', concat_ws('#', group_list, having_sig) FROM bwo WHERE has_group = 1
  UNION ALL SELECT query_id, branch, 'order', concat_ws('#', coalesce(dir, 'asc'), order_list, CAST(has_limit AS VARCHAR))
            FROM bwo WHERE has_order = 1
  UNION ALL SELECT query_id, branch, 'and/or', ao FROM bwo WHERE ao <> ''
  UNION ALL SELECT DISTINCT query_id, branch, 'keywords', sig FROM (
      SELECT query_id, branch, 'not' AS sig FROM itn WHERE clause IN ('on', 'where', 'having') AND has_not = 1
      UNION ALL SELECT query_id, branch, 'in' FROM itn WHERE clause IN ('on', 'where', 'having') AND op = 'in'
      UNION ALL SELECT query_id, branch, 'like' FROM itn WHERE clause IN ('on', 'where', 'having') AND op = 'like'
      UNION ALL SELECT query_id, branch, kw FROM top WHERE kw IN ('where', 'group', 'having', 'order', 'limit')
      UNION ALL SELECT query_id, branch, tok FROM top WHERE is_conn AND tok = 'or'
      UNION ALL SELECT query_id, branch, coalesce(dir, 'asc') FROM bwo WHERE has_order = 1
      UNION ALL SELECT query_id, branch, sig FROM setops) k
  UNION ALL SELECT query_id, branch, 'tables', '__' || tok || '__' FROM top
            WHERE clause = 'from' AND at_top AND NOT is_struct AND tok <> 'as' AND NOT coalesce(prv = 'as', false) AND tok NOT IN ('(', ')')
  UNION ALL SELECT query_id, branch, 'setop', sig FROM setops),
b0 AS (SELECT ci.*, s.pair_id, s.side FROM ci JOIN sides s ON s.qid = ci.query_id WHERE ci.branch = 0),
ms AS (SELECT pair_id, comp, sum(g) AS label_total, sum(p) AS pred_total, sum(least(g, p)) AS cnt FROM (
         SELECT pair_id, comp, sig, sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS g, sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS p
         FROM b0 WHERE comp IN ('select', 'select(no AGG)', 'where', 'where(no OP)', 'group(no Having)', 'keywords')
         GROUP BY ALL) x GROUP BY pair_id, comp),
sg0 AS (SELECT pair_id, comp, max(CASE WHEN side = 0 THEN sig END) AS gs, max(CASE WHEN side = 1 THEN sig END) AS ps
        FROM b0 WHERE comp IN ('group', 'order', 'and/or') GROUP BY pair_id, comp),
sg AS (SELECT pair_id, comp,
         CASE WHEN comp = 'and/or' THEN (CASE WHEN gs IS NOT DISTINCT FROM ps THEN 1 ELSE coalesce(len(string_split(ps, ',')), 0) END)
              ELSE CAST(gs IS NOT NULL AS INT) END AS label_total,
         CASE WHEN comp = 'and/or' THEN (CASE WHEN gs IS NOT DISTINCT FROM ps THEN 1 ELSE coalesce(len(string_split(gs, ',')), 0) END)
              ELSE CAST(ps IS NOT NULL AS INT) END AS pred_total,
         CASE WHEN comp = 'and/or' THEN CAST(gs IS NOT DISTINCT FROM ps AS INT) ELSE CAST(coalesce(gs = ps, false) AS INT) END AS cnt
       FROM sg0),
pb AS (SELECT query_id, branch, string_agg(comp || ':' || sig, chr(1) ORDER BY comp || ':' || sig) AS bsig
       FROM ci WHERE comp <> 'setop' GROUP BY query_id, branch),
kinds AS (SELECT query_id, branch, sig AS kind FROM ci WHERE comp = 'setop'),
later AS (SELECT pb.query_id, string_agg(concat_ws('@', coalesce(k.kind, ''), pb.bsig), chr(2) ORDER BY pb.branch) AS operand
          FROM pb LEFT JOIN kinds k ON k.query_id = pb.query_id AND k.branch = pb.branch WHERE pb.branch >= 1 GROUP BY pb.query_id),
iq AS (SELECT k.query_id, k.kind AS setop, l.operand, s.pair_id, s.side FROM kinds k LEFT JOIN later l ON l.query_id = k.query_id
       JOIN sides s ON s.qid = k.query_id WHERE k.branch = 0),
iu AS (SELECT pair_id, 'IUEN' AS comp, CAST(max(CASE WHEN side = 0 THEN setop END) IS NOT NULL AS INT) AS label_total,
         CAST(max(CASE WHEN side = 1 THEN setop END) IS NOT NULL AS INT) AS pred_total,
         CAST(coalesce(max(CASE WHEN side = 0 THEN setop END) = max(CASE WHEN side = 1 THEN setop END), false)
              AND (max(CASE WHEN side = 0 THEN operand END) IS NOT DISTINCT FROM max(CASE WHEN side = 1 THEN operand END)) AS INT) AS cnt
       FROM iq GROUP BY pair_id),
comps(comp) AS (VALUES {_COMPS}),
grid AS (SELECT DISTINCT pair_id, comp FROM sides, comps),
comp0 AS (SELECT g.pair_id, g.comp, coalesce(u.label_total, 0) AS label_total, coalesce(u.pred_total, 0) AS pred_total,
            coalesce(u.cnt, 0) AS cnt
          FROM grid g LEFT JOIN (SELECT * FROM ms UNION ALL SELECT * FROM sg UNION ALL SELECT * FROM iu) u
            ON u.pair_id = g.pair_id AND u.comp = g.comp),
comp AS (SELECT pair_id, comp, CAST(label_total AS BIGINT) AS label_total, CAST(pred_total AS BIGINT) AS pred_total,
           CAST(cnt AS BIGINT) AS cnt,
           CAST(CASE WHEN label_total = pred_total AND cnt = pred_total THEN 1 ELSE 0 END AS BIGINT) AS acc,
           CAST(CASE WHEN label_total = pred_total AND cnt = pred_total THEN 1 ELSE 0 END AS BIGINT) AS rec,
           CAST(CASE WHEN label_total = pred_total AND cnt = pred_total THEN 1 ELSE 0 END AS BIGINT) AS f1
         FROM comp0),
tabs AS (SELECT pair_id, list_sort(list(sig) FILTER (WHERE side = 0)) AS gt, list_sort(list(sig) FILTER (WHERE side = 1)) AS pt
         FROM b0 WHERE comp = 'tables' GROUP BY pair_id),
ex AS (SELECT c.pair_id, CAST(min(c.f1) = 1 AND (coalesce(len(any_value(t.gt)), 0) = 0
                                                 OR coalesce(any_value(t.gt) = any_value(t.pt), false)) AS BIGINT) AS exact
       FROM comp c LEFT JOIN tabs t ON t.pair_id = c.pair_id GROUP BY c.pair_id),
{items_cte()},
{features_ctes()},
flags AS (SELECT s.pair_id, bool_or(CASE WHEN s.side = 0 THEN b.query_id IS NOT NULL END) AS gold_invalid,
            bool_or(CASE WHEN s.side = 1 THEN b.query_id IS NOT NULL END) AS pred_invalid
          FROM sides s LEFT JOIN bad b ON b.query_id = s.qid GROUP BY s.pair_id),
report AS (SELECT ex.pair_id, ex.exact, f.gold_invalid, f.pred_invalid,
             CASE WHEN f.gold_invalid THEN 'easy' ELSE ft.hardness END AS hardness
           FROM ex JOIN flags f ON f.pair_id = ex.pair_id JOIN sides s ON s.pair_id = ex.pair_id AND s.side = 0
           JOIN feat ft ON ft.query_id = s.qid)"""
