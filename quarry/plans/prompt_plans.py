"""Prompt-assembly plans (C02-C12) over examples = questions ⨝ workload (ex_id = query_id)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import linking as D
from ..operators import prompt as P
from ..operators import querylog as Q
from ..operators import slots as L
from ..sources import tables as T
from .catalog_plans import CATALOG_SQL

CATALOG_CTES = CATALOG_SQL[len("WITH "):]
from .linking_plans import EXACT_SQL, LINK_TABLES, PICKS_SQL, _picks
from .registry import register
from .slots_plans import _dec, _norm_sql, decompose_sql


def _columns(spark, sf_dir):
    return C.profile(spark, sf_dir).filter("column_id > 0").select("db_id", "table_id", "table_name", "column_id", "column_name")


def _exact_matches(spark, sf_dir):
    r = D.rank_links(D.exact_links(T.questions(spark, sf_dir), _picks(spark, sf_dir)))
    return r.groupBy("ex_id", "table_name", "column_name").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("values"))


def _schema(spark, sf_dir, style):
    return P.serialize_schema(T.questions(spark, sf_dir), _columns(spark, sf_dir), _exact_matches(spark, sf_dir), style)


def _schema_sql(style: str) -> str:
    db_t, tsep, ttab, csep, cval, vsep = P.STYLES[style]
    col_v = cval.replace("{column}", "' || lower(column_name) || '").replace("{values}", "' || vals || '")
    tt = ttab.replace("{table}", "' || lower(table_name) || '").replace("{columns}", "' || cols || '")
    head = db_t.replace("{db}", "' || db_id || '")
    return f"""{CATALOG_CTES},
{EXACT_SQL},
named AS (SELECT * FROM exact WHERE NOT (contains(column_name, 'name') AND score < 1)),
pm AS (SELECT *, row_number() OVER (PARTITION BY ex_id, table_name, column_name, match_str ORDER BY score DESC, size DESC, value) AS m FROM named),
rk AS (SELECT *, row_number() OVER (PARTITION BY ex_id, table_name, column_name ORDER BY score DESC, size DESC, value) AS rank FROM pm WHERE m = 1),
mt AS (SELECT ex_id, table_name, column_name, string_agg(value, '{vsep}' ORDER BY rank) AS vals FROM rk WHERE rank <= 2 GROUP BY ALL),
xc AS (SELECT q.ex_id, q.db_id, c.table_id, c.table_name, c.column_id, c.column_name, mt.vals
       FROM questions q JOIN cols c ON c.db_id = q.db_id AND c.column_id > 0
       LEFT JOIN mt ON mt.ex_id = q.ex_id AND mt.table_name = c.table_name AND mt.column_name = c.column_name),
pt AS (SELECT ex_id, db_id, table_id, table_name,
         string_agg(CASE WHEN vals IS NOT NULL THEN '{col_v}' ELSE lower(column_name) END, '{csep}' ORDER BY column_id) AS cols
       FROM xc GROUP BY ALL),
tt AS (SELECT *, '{tt}' AS ttext FROM pt),
sch AS (SELECT ex_id, '{head}' || string_agg(ttext, '{tsep}' ORDER BY CASE WHEN contains(ttext, '(') THEN 0 ELSE 1 END,
                                              CASE WHEN contains(ttext, '(') THEN -table_id ELSE table_id END) AS serialized_schema
        FROM tt GROUP BY ex_id, db_id)""".replace("'' || ", "").replace(" || ''", "")


@register("c02_quoted_token_repair", T.with_views("""
SELECT query_id, array_to_string(list_transform(string_split(regexp_replace(
    regexp_replace(gold, '"([^" ]+)"', '`` \\1 ''''', 'g'), '`` (\\S+) ''''', '"\\1"', 'g'), ' '),
  lambda w: CASE WHEN contains(w, '"') OR contains(w, '''') THEN w ELSE lower(w) END), ' ') AS repaired FROM workload""", "workload"),
          ops="C02")
def c02(spark, sf_dir):
    w = T.workload(spark, sf_dir)
    nltk_style = F.regexp_replace("gold", r'"([^" ]+)"', "`` $1 ''")
    return w.select("query_id", P.repair_quoted_tokens(nltk_style).alias("repaired"))


@register("c03_schema_verbose", T.with_views(f"WITH {_schema_sql('verbose')} SELECT * FROM sch", "questions"), ops="C03 C05 D14")
def c03(spark, sf_dir):
    return _schema(spark, sf_dir, "verbose")


@register("c04_schema_piped", T.with_views(f"WITH {_schema_sql('piped')} SELECT * FROM sch", "questions"), ops="C04 C05 D14")
def c04(spark, sf_dir):
    return _schema(spark, sf_dir, "piped")


@register("c04_schema_piped_fuzzy", None, ops="C04 C05 D14")
def c04f(spark, sf_dir):
    q = T.questions(spark, sf_dir)
    r = D.value_links(q, _picks(spark, sf_dir))
    m = r.groupBy("ex_id", "table_name", "column_name").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("values"))
    return P.serialize_schema(q, _columns(spark, sf_dir), m, "piped")


@register("c06_example_values", T.with_views(f"""WITH {CATALOG_CTES}, {PICKS_SQL},
fb AS (SELECT table_name, column_name, arg_min(value, md5(concat_ws('|', '42', table_name, column_name, value))) AS fallback
       FROM picks GROUP BY ALL),
hit AS (SELECT q.ex_id, p.table_name, p.column_name, min(lower(p.value)) AS hit FROM questions q JOIN picks p
        ON length(p.value) > 0 AND contains(lower(q.question), lower(p.value)) GROUP BY ALL),
xc AS (SELECT q.ex_id, c.table_id, c.table_name, c.column_id, c.column_name, coalesce(hit.hit, fb.fallback) AS pick_value
       FROM questions q JOIN cols c ON c.db_id = q.db_id AND c.column_id > 0 AND c.table_name IN ({", ".join(f"'{t}'" for t in LINK_TABLES)})
       LEFT JOIN hit ON hit.ex_id = q.ex_id AND hit.table_name = c.table_name AND hit.column_name = c.column_name
       LEFT JOIN fb ON fb.table_name = c.table_name AND fb.column_name = c.column_name),
pt0 AS (SELECT ex_id, table_id, table_name,
         string_agg(column_name || ' (' || coalesce(pick_value, 'None') || ')', ',' ORDER BY column_id) AS cs
       FROM xc GROUP BY ex_id, table_id, table_name),
pt AS (SELECT ex_id, table_id, 'table: ' || table_name || '. columns: ' || cs AS ttext FROM pt0)
SELECT ex_id, 'database: star. ' || string_agg(ttext, '. ' ORDER BY table_id) AS serialized_schema FROM pt GROUP BY ex_id""",
                                             "questions"), ops="C06 D07")
def c06(spark, sf_dir):
    q = T.questions(spark, sf_dir)
    picks = _picks(spark, sf_dir)
    cols = _columns(spark, sf_dir).filter(F.col("table_name").isin(*LINK_TABLES))
    ev = P.example_values(q, cols, D.containment_links(q, picks), picks)
    return P.one_db_schema(ev, T.STAR_DB)


@register("c08_targets", T.with_views(f"""
SELECT query_id, 'star | ' || {_norm_sql('gold')} AS target,
  trim(string_split('star | ' || {_norm_sql('gold')}, '|')[1 + 1:][1]) AS stripped FROM workload""", "workload"),
          ops="C08 C12")
def c08(spark, sf_dir):
    w = T.workload(spark, sf_dir)
    t = P.target(L.normalize_sql(F.col("gold")), F.lit(T.STAR_DB), True)
    both = Q.let(t, lambda x: F.struct(x.alias("target"), P.strip_db_prefix(x).alias("stripped")))     # normalized once
    return w.select("query_id", both.alias("b")).select("query_id", "b.target", "b.stripped")


_EX_SQL = "examples AS (SELECT q.ex_id, q.question, w.gold FROM questions q JOIN workload w ON q.ex_id = w.query_id)"


@register("c09_c10_stage_pairs", T.with_views(f"""WITH {_EX_SQL}, {decompose_sql('examples', 'gold', 'ex_id')}, {_schema_sql('verbose')}
SELECT e.ex_id,
  '{P.PROMPT} | ' || '{P.SOURCE_PREFIX}' || trim(e.question) || ' | ' || trim(s.serialized_schema) AS structure_input,
  d.structure AS structure_target,
  '{P.PROMPT}' || d.structure || ' | ' || '{P.SOURCE_PREFIX}' || trim(e.question) || ' | ' || trim(s.serialized_schema) AS content_input,
  d.content AS content_target
FROM examples e JOIN dec d ON d.query_id = e.ex_id JOIN sch s ON s.ex_id = e.ex_id""", "questions", "workload"),
          ops="C07 C09 C10")
def c09(spark, sf_dir):
    ex = T.questions(spark, sf_dir).join(T.workload(spark, sf_dir), F.col("ex_id") == F.col("query_id")).select("ex_id", "question", "gold")
    d = _dec(spark, sf_dir, ex, "gold", "ex_id").withColumnRenamed("query_id", "ex_id")
    s = _schema(spark, sf_dir, "verbose")
    j = ex.join(d, "ex_id").join(s, "ex_id")
    inp = P.model_input(F.col("question"), F.col("serialized_schema"))
    si, st = P.structure_pair(inp, F.col("structure"))
    ci, ct = P.content_pair(inp, F.col("structure"), F.col("content"))
    return j.select("ex_id", si.alias("structure_input"), st.alias("structure_target"), ci.alias("content_input"),
                    ct.alias("content_target"))


_SIDES_SQL = """sides AS (SELECT q.ex_id * 2 AS qid, p.gold AS sql FROM questions q JOIN pairs p ON q.ex_id = p.query_id
  UNION ALL SELECT q.ex_id * 2 + 1, p.pred FROM questions q JOIN pairs p ON q.ex_id = p.query_id WHERE q.ex_id % 11 <> 0)"""


@register("c10_predicted_content", T.with_views(f"""WITH {_SIDES_SQL}, {decompose_sql('sides', 'sql', 'qid')}, {_schema_sql('verbose')}
SELECT q.ex_id, dp.structure IS NOT NULL AS from_prediction,
  '{P.PROMPT}' || coalesce(dp.structure, dg.structure) || ' | ' || '{P.SOURCE_PREFIX}' || trim(q.question) || ' | ' || trim(s.serialized_schema) AS content_input,
  dg.content AS content_target
FROM questions q JOIN dec dg ON dg.query_id = q.ex_id * 2 LEFT JOIN dec dp ON dp.query_id = q.ex_id * 2 + 1
JOIN sch s ON s.ex_id = q.ex_id""", "questions", "pairs"), ops="C10")
def c10(spark, sf_dir):
    """The content stage on predicted structures; every eleventh example has no prediction and keeps the gold one."""
    both = T.questions(spark, sf_dir).join(T.pairs(spark, sf_dir), F.col("ex_id") == F.col("query_id")).select("ex_id", "question", "gold", "pred")
    sides = both.select("ex_id", F.posexplode(F.array("gold", "pred")).alias("side", "sql")).where("side = 0 OR ex_id % 11 <> 0")
    d = _dec(spark, sf_dir, sides.select((F.col("ex_id") * 2 + F.col("side")).alias("qid"), "sql"), "sql", "qid")
    said = d.where("query_id % 2 = 1").select(F.expr("query_id div 2").alias("ex_id"), F.col("structure").alias("predicted"))
    gold = d.where("query_id % 2 = 0").select(F.expr("query_id div 2").alias("ex_id"), "structure", "content")
    ex = both.select("ex_id", "question").join(gold, "ex_id").join(_schema(spark, sf_dir, "verbose"), "ex_id")
    ci, ct = P.content_pair(P.model_input(F.col("question"), F.col("serialized_schema")), F.col("used"), F.col("content"))
    return P.with_predicted_structure(ex, said).select("ex_id", "from_prediction", ci.alias("content_input"), ct.alias("content_target"))


@register("c11_parse_back", T.with_views(f"""WITH {_EX_SQL}, {decompose_sql('examples', 'gold', 'ex_id')}, {_schema_sql('verbose')},
ci AS (SELECT e.ex_id, '{P.PROMPT}' || d.structure || ' | ' || '{P.SOURCE_PREFIX}' || trim(e.question) || ' | ' || trim(s.serialized_schema) AS t
       FROM examples e JOIN dec d ON d.query_id = e.ex_id JOIN sch s ON s.ex_id = e.ex_id)
SELECT ex_id, trim(regexp_extract(replace(t, '{P.PROMPT}', ''), '^(.*?) \\| question:', 1)) AS structure,
  regexp_extract(t, '\\| database: (.*?)\\. table: ', 1) AS db_id FROM ci""", "questions", "workload"), ops="C11")
def c11(spark, sf_dir):
    pairs = c09(spark, sf_dir)
    st, db = P.parse_back(F.col("content_input"))
    return pairs.select("ex_id", st.alias("structure"), db.alias("db_id"))


@register("c07_model_inputs", T.with_views(f"""
WITH said AS (SELECT conv_id, CAST(turn AS INT) AS turn_idx, string_agg(trim(text), ' | ') OVER (PARTITION BY conv_id ORDER BY turn
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS u FROM conversations)
SELECT 'dialogue' AS kind, conv_id AS id, turn_idx, '{P.SOURCE_PREFIX}' || u || ' | database: star' AS model_input FROM said
UNION ALL SELECT 'one_db', ex_id, -1, '{P.SOURCE_PREFIX}' || trim(question || '?') || ' | database: star' FROM questions""", "questions"), ops="C07")
def c07(spark, sf_dir):
    """Dialogue turns (all utterances so far) and one-database questions with '?'."""
    schema = F.lit("database: star")
    so_far = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    c = T.table(spark, sf_dir, "conversations").withColumn("said", F.collect_list("text").over(so_far))
    turns = c.select(F.lit("dialogue").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").cast("int").alias("turn_idx"),
                     P.dialogue_input(F.col("said"), schema).alias("model_input"))
    asked = T.questions(spark, sf_dir).select(F.lit("one_db").alias("kind"), F.col("ex_id").alias("id"), F.lit(-1).alias("turn_idx"),
                                              P.model_input(F.col("question"), schema, append_qmark=True).alias("model_input"))
    return turns.unionByName(asked)
