"""Reader and sink plans (A01, A15, A16, A17): data Spark derives from the
driver tables is written in the corpus file formats into the shared
checkpoint folder and read back through the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..session import checkpoint_dir
from ..sources import corpus as A
from ..sources import sinks as K
from ..sources import tables as T
from .catalog_plans import STATS_SQL
from .corpus_plans import _STRIP, aliased_workload
from .registry import register
from .scoring_plans import ROLLUP_SQL
from .sql_scoring import scoring_ctes

_E41_ORACLE = T.with_views(f"WITH RECURSIVE {scoring_ctes()}{ROLLUP_SQL}\nSELECT * FROM scores", "pairs")


def _scratch(spark, tag):
    return f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


@register("a01_example_reader", T.with_views("""
SELECT 'star' AS db_id, w.gold AS query, CAST(len(string_split(w.gold, ' ')) AS BIGINT) AS n_query_toks, q.question
FROM questions q JOIN workload w ON q.ex_id = w.query_id""", "questions", "workload"), ops="A01")
def a01(spark, sf_dir):
    ex = (T.questions(spark, sf_dir).join(T.workload(spark, sf_dir), F.col("ex_id") == F.col("query_id"))
           .select("db_id", F.col("gold").alias("query"), F.split("gold", " ").alias("query_toks"), "question"))
    path = _scratch(spark, "a01")
    ex.write.mode("overwrite").json(path)
    r = A.read_single_turn(spark, path, "train", multi_line=False)
    return r.select("db_id", "query", F.size("query_toks").cast("bigint").alias("n_query_toks"), "question")


@register("a02_dialogue_reader", f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_idx, text, turn FROM conversations),
c AS (SELECT conv_id, turn_idx, 'SELECT ' || turn AS query,
        flatten(list(list_transform(string_split(text, '|'), lambda u: {_STRIP.format(x='u')}))
                OVER (PARTITION BY conv_id ORDER BY turn_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS u FROM t
      UNION ALL SELECT conv_id, -1, 'SELECT ' || max(turn), [arg_max(text, turn)] FROM t GROUP BY conv_id)
SELECT 'db' || conv_id AS db_id, CAST(turn_idx AS INT) AS turn_idx, array_to_string(u, ' | ') AS utterances, query FROM c""",
          ops="A02 A03")
def a02_reader(spark, sf_dir):
    """The conversations as nested dialogue files, read back through the reader."""
    c = T.table(spark, sf_dir, "conversations")
    said = F.struct(F.col("text").alias("utterance"), F.concat(F.lit("SELECT "), F.col("turn")).alias("query"))
    d = c.groupBy("conv_id").agg(
        F.max_by(said, "turn").alias("final"),
        F.transform(F.array_sort(F.collect_list(F.struct("turn", said.alias("s")))), lambda x: x["s"]).alias("interaction"))
    path = _scratch(spark, "a02")
    d.select(F.concat(F.lit("db"), "conv_id").alias("database_id"), "final", "interaction").write.mode("overwrite").json(path)
    r = A.read_dialogues(spark, path, multi_line=False)
    return r.select("db_id", "turn_idx", F.array_join("utterances", " | ").alias("utterances"), "query")


@register("a04_one_db_json", T.with_views("""
SELECT 'question ' || query_id AS question,
  CASE WHEN query_id % 8 = 7 THEN replace(replace(replace(gold, 'T1', 'T_'), 'T2', 'T1'), 'T_', 'T2') ELSE gold END AS query, CAST(len(regexp_split_to_array(trim(gold), '\\s+')) AS BIGINT) AS n_query_toks,
  'star' AS db_id FROM workload""", "workload"), ops="A04 A05")
def a04_json(spark, sf_dir):
    """The aliased workload as one-database files; the reader numbers the aliases by
    table order (customer before orders, so template 7 gets T2 and T1)."""
    w = aliased_workload(spark, sf_dir)
    path = _scratch(spark, "a04")
    w.select(F.concat(F.lit("question "), "query_id").alias("query"), "sql").write.mode("overwrite").json(path)
    r = A.read_one_db(spark, path, ["customer", "orders", "nation"], T.STAR_DB, multi_line=False)
    return r.select("question", "query", F.size("query_toks").cast("bigint").alias("n_query_toks"), "db_id")


_STAR = ", ".join(f"'{t}'" for t in T.STAR_TABLES)


@register("a15_schema_json", f"""
WITH {STATS_SQL}
SELECT lower(c.table_name) AS table_name, CAST(ordinal_position - 1 AS INT) AS col_pos, lower(c.column_name) AS column_name, n_values
FROM information_schema.columns c JOIN stats s ON s.table_name = c.table_name AND s.column_name = c.column_name
WHERE c.table_name IN ({_STAR})""", ops="A15")
def a15(spark, sf_dir):
    cols = C.profile(spark, sf_dir).filter("column_id > 0")
    desc = cols.groupBy(F.col("table_name").alias("table")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("column_id", "column_name"))),
                    lambda x: F.struct(x["column_name"].alias("column_name"))).alias("col_data"))
    path = _scratch(spark, "a15")
    desc.write.mode("overwrite").json(path)
    read = A.schema_from_json(spark, path, multi_line=False).select("table_name", F.col("col_pos").cast("int"), "column_name")
    return read.join(C.column_stats(spark, sf_dir).drop("db_id"), ["table_name", "column_name"])


@register("a16_prediction_lines", T.with_views("SELECT coalesce(pred, '') AS value FROM pairs", "pairs"), ops="A16")
def a16(spark, sf_dir):
    p = T.pairs(spark, sf_dir).select(F.col("query_id").alias("ex_id"), F.col("pred").alias("pred_sql"))
    path = _scratch(spark, "a16")
    K.write_prediction_lines(p, path)
    return spark.read.text(path)


@register("a17_prediction_records", T.with_views("""
SELECT query_id AS ex_id, pred AS prediction, gold AS label, CAST(gold = pred AS BIGINT) AS score, pred AS pred_sql, gold AS gold_sql
FROM pairs""", "pairs"), ops="A17")
def a17(spark, sf_dir):
    p = T.pairs(spark, sf_dir).select(F.col("query_id").alias("ex_id"), F.col("pred").alias("prediction"),
                                      F.col("gold").alias("label"), (F.col("gold") == F.col("pred")).cast("bigint").alias("score"),
                                      F.col("pred").alias("pred_sql"), F.col("gold").alias("gold_sql"))
    path = _scratch(spark, "a17")
    K.write_prediction_records(p, path, "parquet")
    return spark.read.parquet(path)


@register("a18_hypothesis_append", T.with_views("""
SELECT CAST(ex_id // 2048 AS INT) AS batch_id, CAST(count(*) AS BIGINT) AS n_candidates, CAST(count(DISTINCT ex_id) AS BIGINT) AS n_examples
FROM hypotheses GROUP BY 1""", "hypotheses"), ops="A18")
def a18(spark, sf_dir):
    h = T.hypotheses(spark, sf_dir).withColumn("batch_id", F.expr("ex_id div 2048").cast("int"))
    path = _scratch(spark, "a18")
    K.append_hypothesis_batches(h, path)
    r = spark.read.parquet(path)
    return r.groupBy("batch_id").agg(F.count("*").alias("n_candidates"), F.count_distinct("ex_id").alias("n_examples"))


@register("a19_score_report", _E41_ORACLE, ops="A19")
def a19(spark, sf_dir):
    from ..operators import scoring as S
    cols = C.profile(spark, sf_dir)
    comp, rep = S.score_pairs(spark, T.pairs(spark, sf_dir), cols, C.foreign_keys(spark, cols), T.STAR_DB)
    path = _scratch(spark, "a19")
    K.write_score_report(rep, S.roll_up(comp, rep), path)
    return spark.read.schema("level string, component string, acc double, rec double, f1 double").json(f"{path}/total_scores")
