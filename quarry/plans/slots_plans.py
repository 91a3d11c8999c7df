"""Structure/content plans (F01-F11, C01, C13) over the workload, pairs and hypotheses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import querylog as Q
from ..operators import scoring as S
from ..operators import slots as L
from ..session import cut_lineage
from ..sources import tables as T
from . import sql_querylog as SQ
from .registry import register
from .sql_scoring import scoring_ctes

HYP_SIDES = "SELECT ex_id * 4 + hyp_rank AS qid, ex_id AS pair_id, hyp_rank AS side, pred AS sql FROM hypotheses"

_STAR = ", ".join(f"'{t}'" for t in T.STAR_TABLES)
_KEEP = SQ._in(L.KEEP)


def _norm_sql(x: str) -> str:
    """DuckDB twin of slots.normalize_sql."""
    return (f"replace(regexp_replace(regexp_replace(array_to_string(list_transform(regexp_extract_all({x}, '\\w+|\\W+', 0), "
            f"lambda p, i: CASE WHEN regexp_matches(p, '^\\w') "
            f"AND NOT coalesce(regexp_matches(regexp_extract_all({x}, '\\w+|\\W+', 0)[i - 1], '[''\"]$'), false) "
            f"AND NOT coalesce(regexp_matches(regexp_extract_all({x}, '\\w+|\\W+', 0)[i + 1], '^[''\"]'), false) "
            f"THEN lower(p) ELSE p END), ''), '\\s+', ' ', 'g'), '^ | $', '', 'g'), ' , ', ', ')")


def _tight_sql(x: str) -> str:
    return (f"regexp_replace(regexp_replace(regexp_replace({x}, '\\b(count|avg|sum|max|min) \\(', '\\1(', 'g'), "
            f"'\\( ', '(', 'g'), ' \\)', ')', 'g')")


def decompose_sql(src: str, text_col: str, id_col: str = "query_id") -> str:
    """CTEs ending in ``dec(query_id, structure, content)``."""
    return f"""{SQ.tokens_cte(src, text_col, id_col)}, {SQ.segment_ctes()},
cnames AS (SELECT DISTINCT lower(column_name) AS cname FROM information_schema.columns WHERE table_name IN ({_STAR})
           UNION SELECT '*'),
kd AS (SELECT seg.*, CASE WHEN clause IN ('from', 'on') AND tok <> 'from' AND sbo = 0 AND sbc = 0 THEN 'tab'
                          WHEN starts_with(tok, '"') THEN 'val' WHEN tok IN {_KEEP} THEN 'keep'
                          WHEN tok = '*' OR contains(tok, '.') OR cname IS NOT NULL THEN 'col' ELSE 'val' END AS kind
       FROM seg LEFT JOIN cnames ON seg.tok = cnames.cname),
rn AS (SELECT *, sum(CAST(kind <> 'val' AS INT)) OVER (PARTITION BY query_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM kd),
pc AS (SELECT query_id, CASE kind WHEN 'tab' THEN 't:' || sel_depth || ':' || sel_block || ':' || branch
                                  WHEN 'val' THEN 'v:' || run ELSE 'p:' || pos END AS pk,
         min(pos) AS ppos, min(kind) AS kind,
         string_agg(CASE WHEN kind <> 'tab' OR tok NOT IN ('(', ')') THEN tok END, ' ' ORDER BY pos) AS body
       FROM rn GROUP BY 1, 2),
dec0 AS (SELECT query_id,
           string_agg(CASE WHEN kind = 'keep' THEN body ELSE '[' || kind || ']' END, ' ' ORDER BY ppos) AS s,
           string_agg(CASE WHEN kind <> 'keep' THEN '[' || kind || '] ' || body END, ' ' ORDER BY ppos) AS content
         FROM pc GROUP BY query_id),
dec AS (SELECT query_id, {_norm_sql(_tight_sql('s'))} AS structure, content FROM dec0)"""


def _dec(spark, sf_dir, df, text_col="gold", id_col="query_id", per_shape=None):
    """(query_id, structure, content, …); decomposed once per distinct shape.

    ``per_shape`` adds columns that depend on structure and content; literals
    are marks there, and those in ``content`` and added columns are filled in
    for each distinct text."""
    cols = C.profile(spark, sf_dir).select(F.lower("column_name").alias("column_name"))
    texts, shapes = Q.text_shapes(df, text_col)
    d = L.decompose(Q.shape_rows(shapes), cols)
    if per_shape is not None:
        d = per_shape(d)
    with_marks = [c for c in d.columns if c not in ("query_id", "structure")]
    d = texts.join(cut_lineage(d), F.col("query_id") == F.col("text_id")).drop("query_id", "text_id")
    d = Q.fill_columns(d, with_marks, F.col("text"))
    return df.select(F.col(id_col).alias("query_id"), F.col(text_col).alias("text")).join(d, "text").drop("text")


@register("f01_structure_content", T.with_views(f"WITH {decompose_sql('workload', 'gold')}\nSELECT * FROM dec", "workload"),
          ops="F01 F02")
def f01(spark, sf_dir):
    return _dec(spark, sf_dir, T.workload(spark, sf_dir))


_SLOTS = "regexp_extract_all({x}, '\\[(col|tab|val)\\]', 1)"


@register("f03_slot_counts", T.with_views(f"""WITH {decompose_sql('workload', 'gold')}
SELECT query_id, CAST(len(list_filter({_SLOTS.format(x='structure')}, lambda k: k = 'col')) AS BIGINT) AS n_col,
  CAST(len(list_filter({_SLOTS.format(x='structure')}, lambda k: k = 'tab')) AS BIGINT) AS n_tab,
  CAST(len(list_filter({_SLOTS.format(x='structure')}, lambda k: k = 'val')) AS BIGINT) AS n_val FROM dec""", "workload"),
          ops="F03")
def f03(spark, sf_dir):
    d = _dec(spark, sf_dir, T.workload(spark, sf_dir))
    return d.select("query_id", L.slot_counts(F.col("structure")).alias("c")).select(
        "query_id", *[F.col(f"c.n_{k}").cast("bigint").alias(f"n_{k}") for k in ("col", "tab", "val")])


def _combine_sql(st: str, ct: str) -> str:
    sk = _SLOTS.format(x=st)
    ck = _SLOTS.format(x=ct)
    pieces = f"string_split_regex({st}, '\\[(?:col|tab|val)\\]')"
    ctexts = f"list_transform(string_split_regex({ct}, '\\[(?:col|tab|val)\\]')[2:], lambda x: trim(x))"
    same = " AND ".join(f"len(list_filter({sk}, lambda x: x = '{k}')) = len(list_filter({ck}, lambda x: x = '{k}'))"
                        for k in ("col", "tab", "val"))
    val_i = (f"list_filter(list_zip({ck}, {ctexts}), lambda z: z[1] = {sk}[i])"
             f"[len(list_filter({sk}[1:i], lambda y: y = {sk}[i]))][2]")
    filled = (f"CASE WHEN len({sk}) = 0 THEN {st} ELSE {pieces}[1] || array_to_string(list_transform(range(1, len({sk}) + 1), "
              f"lambda i: coalesce({val_i}, '') || {pieces}[i + 1]), '') END")
    return f"CASE WHEN {same} THEN regexp_replace({filled}, '^ ', '') ELSE {st} END"


@register("f05_round_trip", T.with_views(f"""WITH {decompose_sql('workload', 'gold')}
SELECT query_id, {_combine_sql('structure', 'content')} AS rebuilt FROM dec""", "workload"), ops="F04 F05")
def f05(spark, sf_dir):
    d = _dec(spark, sf_dir, T.workload(spark, sf_dir),
             per_shape=lambda x: x.withColumn("rebuilt", L.combine(F.col("structure"), F.col("content"))))
    return d.select("query_id", "rebuilt")


@register("f06_structure_accuracy", T.with_views(f"""WITH sides AS (
  SELECT query_id * 2 AS qid, query_id AS pair_id, gold AS sql FROM pairs UNION ALL SELECT query_id * 2 + 1, query_id, pred FROM pairs),
{decompose_sql('sides', 'sql', 'qid')}
SELECT CAST(g.pair_id % 7 AS BIGINT) AS variant,
  round(avg(CAST(lower(dg.structure) = lower(dp.structure) AS DOUBLE)), 6) AS structure_acc_folded,
  round(avg(CAST(dg.structure = dp.structure AS DOUBLE)), 6) AS structure_acc_exact
FROM sides g JOIN dec dg ON dg.query_id = g.qid JOIN dec dp ON dp.query_id = g.qid + 1
WHERE g.qid % 2 = 0 GROUP BY 1""", "pairs"), ops="F06")
def f06(spark, sf_dir):
    s = S.sides(T.pairs(spark, sf_dir))
    d = _dec(spark, sf_dir, s, "sql")
    k = s.select("query_id", "pair_id", "side")
    dd = d.join(k, "query_id")
    g = dd.filter("side = 0").select("pair_id", F.col("structure").alias("gs"))
    p = dd.filter("side = 1").select("pair_id", F.col("structure").alias("ps"))
    j = g.join(p, "pair_id")
    return j.groupBy((F.col("pair_id") % 7).alias("variant")).agg(
        F.round(F.avg((F.lower("gs") == F.lower("ps")).cast("double")), 6).alias("structure_acc_folded"),
        F.round(F.avg((F.col("gs") == F.col("ps")).cast("double")), 6).alias("structure_acc_exact"))


@register("f07_f08_candidate_filters", T.with_views(f"""WITH {decompose_sql('workload', 'gold')}
SELECT query_id,
  len(list_filter(regexp_extract_all(structure, '\\[(?:col|tab|val)\\]|[a-z_]+|>=|<=|!=|[=<>(),*!]|\\S', 0),
      lambda w: NOT list_contains({SQ._in(L.STRUCTURE_WORDS).replace('(', '[', 1)[:-1] + ']'}, w))) = 0 AS vocab_ok,
  {_SLOTS.format(x='structure')}[1:len({_SLOTS.format(x='content')})] = {_SLOTS.format(x='content')}
    AND length(content) - length(replace(content, '[', '')) = length(content) - length(replace(content, ']', ''))
    AND len({_SLOTS.format(x='content')}) = length(content) - length(replace(content, '[', ''))
    AND NOT regexp_matches(content, '\\[table\\]|\\[Col|\\[value\\]|\\[col\\)') AND NOT starts_with(content, '[col ') AS order_ok
FROM dec""", "workload"), ops="F07 F08")
def f07(spark, sf_dir):
    d = _dec(spark, sf_dir, T.workload(spark, sf_dir))
    return d.select("query_id", L.structure_vocab_ok(F.col("structure")).alias("vocab_ok"),
                    L.slot_order_ok(F.col("structure"), F.col("content")).alias("order_ok"))


@register("f09_hypothesis_grouping", T.with_views("""
SELECT CAST(ex_id * 4 + hyp_rank AS BIGINT) AS gen_idx, CAST((ex_id * 4 + hyp_rank) // 4 AS BIGINT) AS ex_no,
  CAST((ex_id * 4 + hyp_rank) % 4 AS INT) AS hyp_rank, (ex_id * 4 + hyp_rank) % 4 = 0 AS is_top FROM hypotheses""", "hypotheses"),
          ops="F09")
def f09(spark, sf_dir):
    h = T.hypotheses(spark, sf_dir).select((F.col("ex_id") * 4 + F.col("hyp_rank")).alias("gen_idx"))
    g = L.group_hypotheses(h, 4)
    return g.select(F.col("gen_idx").cast("bigint"), F.col("ex_no").cast("bigint"), "hyp_rank", (F.col("hyp_rank") == 0).alias("is_top"))


@register("f10_first_valid", T.with_views(f"""WITH RECURSIVE {scoring_ctes(HYP_SIDES)},
hv AS (SELECT h.ex_id, h.hyp_rank, h.pred, b.query_id IS NULL AS valid FROM hypotheses h
       LEFT JOIN bad b ON b.query_id = h.ex_id * 4 + h.hyp_rank)
SELECT ex_id, arg_min(hyp_rank, (CASE WHEN valid THEN 0 ELSE 1 END) * 1000000 + hyp_rank) AS chosen_rank,
  arg_min(pred, (CASE WHEN valid THEN 0 ELSE 1 END) * 1000000 + hyp_rank) AS pred_sql, bool_or(valid) AS found_valid
FROM hv GROUP BY ex_id""", "hypotheses"), ops="F10 E02 E16")
def f10(spark, sf_dir):
    from ..streaming.hypotheses import pick_first_valid
    cols = C.profile(spark, sf_dir)
    canon = S.fk_canonical(spark, cols, C.foreign_keys(spark, cols))
    return pick_first_valid(T.hypotheses(spark, sf_dir), cols, canon, T.STAR_DB)


@register("f11_best_run", T.with_views("""
WITH r AS (SELECT CAST(query_id % 7 AS BIGINT) AS run, avg(CAST(gold = pred AS DOUBLE)) AS em FROM pairs GROUP BY 1)
SELECT arg_max(run, em * 1000 - run) AS best_run, round(max(em), 6) AS best_em FROM r""", "pairs"), ops="F11")
def f11(spark, sf_dir):
    p = T.pairs(spark, sf_dir)
    r = p.groupBy((F.col("query_id") % 7).alias("run")).agg(F.avg((F.col("gold") == F.col("pred")).cast("double")).alias("em"))
    # strictly higher replaces: on ties the earliest run is kept
    return r.agg(F.max_by("run", F.struct("em", (-F.col("run")).alias("nr"))).alias("best_run"),
                 F.round(F.max("em"), 6).alias("best_em"))


@register("c01_normalize_sql", T.with_views(f"SELECT query_id, {_norm_sql('gold')} AS normalized FROM workload", "workload"),
          ops="C01")
def c01(spark, sf_dir):
    return T.workload(spark, sf_dir).select("query_id", L.normalize_sql(F.col("gold")).alias("normalized"))


@register("c13_comparator_decode", T.with_views(f"""WITH {decompose_sql('workload', 'gold')}
SELECT query_id, replace(replace(replace(replace(structure, '<', 'before'), '>', 'after'), 'before', '<'), 'after', '>') AS decoded
FROM dec""", "workload"), ops="C13")
def c13(spark, sf_dir):
    d = _dec(spark, sf_dir, T.workload(spark, sf_dir))
    enc = F.replace(F.replace(F.col("structure"), F.lit("<"), F.lit("before")), F.lit(">"), F.lit("after"))
    return d.select("query_id", L.decode_comparators(enc).alias("decoded"))
