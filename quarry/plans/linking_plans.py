"""Value-linking plans (D01-D14) over ``questions`` × picklists of the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed import COMMON_DB_TERMS, COMMON_WORDS, MATCH_THRESHOLD, STOPWORDS
from ..operators import linking as D
from ..sources import tables as T
from .registry import register
from .sql_querylog import _in

LINK_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
# text columns of the picklist tables (DuckDB side lists them from information_schema)
_TABLES_IN = ", ".join(f"'{t}'" for t in LINK_TABLES)


def _picks(spark, sf_dir):
    return D.picklist({t: T.table(spark, sf_dir, t) for t in LINK_TABLES})


def _picks_sql() -> str:
    # unpivot every VARCHAR column of the picklist tables
    cols = {
        "part": ["p_name", "p_brand", "p_type"], "customer": ["c_name", "c_mktsegment"], "nation": ["n_name"],
        "region": ["r_name"], "supplier": ["s_name"], "orders": ["o_orderstatus", "o_orderpriority"],
        "lineitem": ["l_returnflag", "l_linestatus"], "events": ["event_type", "props"],
    }
    parts = [f"SELECT DISTINCT '{t}' AS table_name, '{c}' AS column_name, {c} AS value FROM {t} WHERE {c} IS NOT NULL"
             for t, cs in cols.items() for c in cs]
    return "picks AS (" + "\nUNION ".join(parts) + ")"


PICKS_SQL = _picks_sql()
SEP_SQL = D.SEP_CLASS.replace("'", "''")
NUM_SQL = D.NUMBER_RE
STOP_SQL = _in(STOPWORDS)
EXCL_SQL = f"""NOT regexp_matches(replace(trim(c_value), ',', ''), '{NUM_SQL}') AND c_value NOT IN {_in(COMMON_DB_TERMS)}
  AND trim(c_value) NOT IN {STOP_SQL}"""


@register("d01_picklist", f"WITH {PICKS_SQL} SELECT * FROM picks", ops="D01 D02")
def d01(spark, sf_dir):
    return _picks(spark, sf_dir)


LINKABLE_SQL = f"length(c_value) > 1 AND {EXCL_SQL}"
EXACT_SQL = f"""{PICKS_SQL},
v AS (SELECT *, lower(trim(value)) AS c_value FROM picks),
vf AS (SELECT * FROM v WHERE {LINKABLE_SQL} AND NOT regexp_matches(c_value, '^{SEP_SQL}|{SEP_SQL}$')),
qt AS (SELECT ex_id, lower(trim(question)) AS lq FROM questions),
firsts AS (SELECT ex_id, lq, i AS f FROM qt, range(1, length(lq) + 1) r(i) WHERE NOT regexp_matches(substring(lq, i, 1), '{SEP_SQL}')
           AND (i = 1 OR regexp_matches(substring(lq, i - 1, 1), '{SEP_SQL}'))),
spans AS (SELECT DISTINCT ex_id, substring(lq, f, e) AS span FROM firsts, range(1, length(lq) + 1) r(e)
          WHERE f + e - 1 <= length(lq) AND NOT regexp_matches(substring(lq, f + e - 1, 1), '{SEP_SQL}')
            AND (f + e - 1 = length(lq) OR regexp_matches(substring(lq, f + e, 1), '{SEP_SQL}'))),
exact AS (SELECT s.ex_id, vf.table_name, vf.column_name, vf.value, s.span AS match_str, 1.0 AS score,
            CAST(length(vf.c_value) AS INT) AS size FROM spans s JOIN vf ON s.span = vf.c_value)"""


@register("d06_exact_links", T.with_views(f"WITH {EXACT_SQL} SELECT * FROM exact", "questions"), ops="D06 D11")
def d06(spark, sf_dir):
    return D.exact_links(T.questions(spark, sf_dir), _picks(spark, sf_dir))


@register("d07_containment", T.with_views(f"""WITH {PICKS_SQL}
SELECT DISTINCT q.ex_id, p.table_name, p.column_name, p.value FROM questions q JOIN picks p
  ON length(p.value) > 0 AND contains(lower(q.question), lower(p.value))""", "questions"), ops="D07")
def d07(spark, sf_dir):
    return D.containment_links(T.questions(spark, sf_dir), _picks(spark, sf_dir))


CANDS_SQL = f"""{PICKS_SQL},
v AS (SELECT *, lower(trim(value)) AS c_value FROM picks),
vf AS (SELECT *, length(c_value) AS L, CAST(greatest(1, ceil(length(c_value) * 0.739 - 2)) AS INT) AS q,
         substring(regexp_replace(c_value, '^{SEP_SQL}+', ''), 1, 1) AS head FROM v WHERE {LINKABLE_SQL}),
pieces AS (SELECT DISTINCT table_name, column_name, value, c_value, L, q, head, substring(c_value, i, q) AS g
           FROM vf, range(1, L - q + 2) r(i)),
qs AS (SELECT ex_id, question, lower(trim(question)) AS lq FROM questions),
starts AS (SELECT ex_id, question, lq, i AS w FROM qs, range(1, length(lq) + 1) r(i)
           WHERE NOT regexp_matches(substring(lq, i, 1), '{SEP_SQL}') AND (i = 1 OR regexp_matches(substring(lq, i - 1, 1), '{SEP_SQL}'))),
grams AS (SELECT ex_id, question, lq, w, n AS q, substring(lq, w, n) AS g FROM starts, (SELECT DISTINCT q AS n FROM vf)
          WHERE length(substring(lq, w, n)) = n),
cands AS (SELECT DISTINCT g.ex_id, g.question, g.lq, g.w, p.table_name, p.column_name, p.value, p.c_value, p.L
          FROM grams g JOIN pieces p ON g.q = p.q AND g.g = p.g AND substring(g.g, 1, 1) = p.head)"""


@register("d09_blocking", T.with_views(f"""WITH {CANDS_SQL}
SELECT table_name, column_name, CAST(count(DISTINCT (ex_id, value)) AS BIGINT) AS n_pairs FROM cands GROUP BY 1, 2""",
                                       "questions"), ops="D09")
def d09(spark, sf_dir):
    picks = _picks(spark, sf_dir)
    return D.count_by_column(T.questions(spark, sf_dir), lambda q: D.fuzzy_candidates(q, picks), by_text=False)


PRUNED_SQL = f"""{CANDS_SQL},
sp AS (SELECT c.*, e, regexp_replace(substring(substring(lq, w), 1, e), '{SEP_SQL}+$', '') AS s
       FROM cands c, range(1, greatest(length(substring(lq, w)), 1) + 1) r(e)
       WHERE (e = length(substring(lq, w)) OR regexp_matches(substring(substring(lq, w), e + 1, 1), '{SEP_SQL}'))
         AND e >= L * 0.739 - 2 AND e <= L * 1.353 + 2),
ok AS (SELECT DISTINCT ex_id, question, table_name, column_name, value FROM sp
       WHERE levenshtein(s, c_value) <= floor((L + length(s)) * 0.15 + 1))"""


@register("d10_prune", T.with_views(f"""WITH {PRUNED_SQL}
SELECT table_name, column_name, CAST(count(*) AS BIGINT) AS n_pairs FROM ok GROUP BY 1, 2""", "questions"), ops="D10")
def d10(spark, sf_dir):
    picks = _picks(spark, sf_dir)
    return D.count_by_column(T.questions(spark, sf_dir), lambda q: D.prune_candidates(D.fuzzy_candidates(q, picks)), by_text=True)


def _any(rule: str) -> str:
    return "(" + " OR ".join(rule.format(x=x) for x in ("m", "s", "v")) + ")"


# The longest substring of the value that stands in the question; D05: the
# words around it; D08: twice the longest common subsequence (row by row, each a
# running maximum) over both lengths, and the acceptance rules
FACTS_SQL = f"""{PRUNED_SQL},
qv AS (SELECT DISTINCT question, value, trim(question) AS qs, lower(trim(question)) AS t, trim(value) AS plain, lower(trim(value)) AS c FROM ok),
subs AS (SELECT qv.*, j, n, strpos(t, substring(c, j, n)) AS i FROM qv, range(1, length(c) + 1) r1(j), range(1, length(c) - j + 2) r2(n)),
blk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question, value ORDER BY n DESC, i, j) AS k FROM subs WHERE i > 0) WHERE k = 1),
edges AS (SELECT question, value, qs, t, plain, i, j, n, min(e) AS stop FROM blk b, range(i + n - 1, i + n + 3) x(e)
          WHERE (i = 1 OR regexp_matches(substring(t, i, 1), '{SEP_SQL}') OR regexp_matches(substring(t, i - 1, 1), '{SEP_SQL}'))
            AND (e > length(t) OR regexp_matches(substring(t, e, 1), '{SEP_SQL}')) GROUP BY question, value, qs, t, plain, i, j, n),
words AS (SELECT *, i + length(substring(t, i)) - length(regexp_replace(substring(t, i), '^{SEP_SQL}+', '')) AS w1,
            length(regexp_replace(substring(t, 1, least(stop, length(t))), '{SEP_SQL}+$', '')) AS w2 FROM edges),
facts0 AS (SELECT question, value, substring(plain, j, n) AS match_str, substring(qs, w1, w2 - w1 + 1) AS source_str,
             CAST(n AS INT) AS size FROM words WHERE w2 > w1),
chars AS (SELECT *, string_split(lower(trim(value)), '') AS ac, string_split(trim(lower(source_str)), '') AS bc FROM facts0),
lcs AS (SELECT *, list_reduce(list_prepend(list_transform(bc, lambda d: 0), list_transform(ac, lambda x: list_transform(bc, lambda d: CAST(x = d AS INT)))),
          lambda p, m: list_transform(range(1, len(p) + 1), lambda k: CAST(list_max(list_transform(range(1, k + 1),
            lambda u: greatest(p[u], coalesce(p[u - 1], 0) + m[u]))) AS INT))) AS last_row FROM chars),
facts AS (SELECT question, value, match_str, source_str, size, lower(trim(match_str)) AS m, lower(trim(source_str)) AS s, lower(trim(value)) AS v,
            2.0 * last_row[len(last_row)] / (len(ac) + len(bc)) AS ratio FROM lcs),
scored AS (SELECT *, CASE WHEN ends_with(s, m || chr(39) || 's') THEN 1.0
                          WHEN substring(regexp_replace(v, '^{SEP_SQL}+', ''), 1, 1) = substring(regexp_replace(s, '^{SEP_SQL}+', ''), 1, 1) THEN ratio
                          ELSE 0.0 END AS score FROM facts),
links AS (SELECT * FROM scored WHERE m <> '' AND NOT regexp_matches(replace(trim(m), ',', ''), '{NUM_SQL}') AND m NOT IN {_in(COMMON_DB_TERMS)}
            AND NOT {_any("trim({x}) IN " + STOP_SQL)} AND score >= {MATCH_THRESHOLD}
            AND (score >= 1 OR NOT ({_any("trim({x}) IN " + _in(COMMON_WORDS))} OR (upper(trim(value)) = trim(value) AND v <> trim(value))))),
fuzzy AS (SELECT ok.ex_id, ok.table_name, ok.column_name, ok.value, l.match_str, l.source_str, CAST(l.score AS DOUBLE) AS score, l.size
          FROM ok JOIN links l ON l.question = ok.question AND l.value = ok.value)"""


@register("d08_fuzzy_links", T.with_views(f"WITH {FACTS_SQL} SELECT * FROM fuzzy", "questions"), ops="D04 D05 D08")
def d08(spark, sf_dir):
    return D.fuzzy_links(T.questions(spark, sf_dir), _picks(spark, sf_dir))


@register("d13_exact_top2", T.with_views(f"""WITH {EXACT_SQL},
named AS (SELECT * FROM exact WHERE NOT (contains(column_name, 'name') AND score < 1)),
pm AS (SELECT *, row_number() OVER (PARTITION BY ex_id, table_name, column_name, match_str ORDER BY score DESC, size DESC, value) AS m FROM named),
rk AS (SELECT *, row_number() OVER (PARTITION BY ex_id, table_name, column_name ORDER BY score DESC, size DESC, value) AS rank FROM pm WHERE m = 1)
SELECT ex_id, table_name, column_name, value, CAST(rank AS INT) AS rank FROM rk WHERE rank <= 2""", "questions"),
          ops="D12 D13")
def d13(spark, sf_dir):
    r = D.rank_links(D.exact_links(T.questions(spark, sf_dir), _picks(spark, sf_dir)))
    return r.select("ex_id", "table_name", "column_name", "value", "rank")


VALUE_LINKS_SQL = f"""{FACTS_SQL},
spans AS (SELECT DISTINCT ex_id, substring(lq, w, e) AS span FROM starts, range(1, length(lq) + 1) r(e)
          WHERE w + e - 1 <= length(lq) AND NOT regexp_matches(substring(lq, w + e - 1, 1), '{SEP_SQL}')
            AND (w + e - 1 = length(lq) OR regexp_matches(substring(lq, w + e, 1), '{SEP_SQL}'))),
whole AS (SELECT *, lower(trim(value)) AS c_value FROM picks),
exact AS (SELECT s.ex_id, x.table_name, x.column_name, x.value, s.span AS match_str, s.span AS source_str, CAST(1.0 AS DOUBLE) AS score,
            CAST(length(x.c_value) AS INT) AS size
          FROM spans s JOIN (SELECT * FROM whole WHERE {LINKABLE_SQL} AND NOT regexp_matches(c_value, '^{SEP_SQL}|{SEP_SQL}$')) x
            ON s.span = x.c_value),
both_ AS (SELECT * FROM exact UNION ALL SELECT * FROM fuzzy),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ex_id, table_name, column_name, value
           ORDER BY score DESC, size DESC, match_str DESC, source_str DESC) AS b FROM both_) WHERE b = 1),
pm AS (SELECT *, row_number() OVER (PARTITION BY ex_id, table_name, column_name, match_str ORDER BY score DESC, size DESC, value) AS m1
       FROM best WHERE NOT (contains(column_name, 'name') AND score < 1)),
rk AS (SELECT *, row_number() OVER (PARTITION BY ex_id, table_name, column_name ORDER BY score DESC, size DESC, value) AS rank FROM pm WHERE m1 = 1)"""


@register("d14_value_links", T.with_views(f"""WITH {VALUE_LINKS_SQL}
SELECT ex_id, table_name, column_name, string_agg(value, ' , ' ORDER BY rank) AS "values", CAST(max(score) AS DOUBLE) AS best_score
FROM rk WHERE rank <= 2 GROUP BY 1, 2, 3""", "questions"), ops="D14 D04 D05 D08 D13")
def d14(spark, sf_dir):
    r = D.value_links(T.questions(spark, sf_dir), _picks(spark, sf_dir))
    return r.groupBy("ex_id", "table_name", "column_name").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]), " , ").alias("values"),
        F.max("score").alias("best_score"))


@register("d03_byte_decoding", """
SELECT doc_id, decode(encode(text)) = text AS round_trip_ok, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM documents""",
          ops="D03")
def d03(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents")
    b = F.encode("text", "UTF-8")
    return d.select("doc_id", (D.decode_bytes(b) == F.col("text")).alias("round_trip_ok"),
                    F.octet_length(b).cast("bigint").alias("n_bytes"))
