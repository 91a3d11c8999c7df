"""Corpus and sampling plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as B
from ..sources import corpus as A
from ..sources import tables as T
from .registry import register

_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


@register("a02_dialogue_flatten", """
SELECT conv_id, CAST(turn AS INT) AS turn_idx, text AS utterance, role FROM conversations
UNION ALL
SELECT conv_id, -1, arg_max(text, turn), arg_max(role, turn) FROM conversations GROUP BY conv_id""", ops="A02")
def a02(spark, sf_dir):
    return A.dialogue_turns(T.table(spark, sf_dir, "conversations"))


@register("a03_cumulative_utterances", f"""
WITH t AS (SELECT conv_id, CAST(turn AS INT) AS turn_idx, text AS utterance FROM conversations),
c AS (SELECT conv_id, turn_idx,
        flatten(list(list_transform(string_split(utterance, '|'), lambda u: {_STRIP.format(x='u')}))
                OVER (PARTITION BY conv_id ORDER BY turn_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS u
      FROM t
      UNION ALL
      SELECT conv_id, -1, [arg_max(text, turn)] FROM conversations GROUP BY conv_id)
SELECT conv_id, turn_idx, CAST(len(u) AS BIGINT) AS n_utterances, array_to_string(u, ' | ') AS utterances FROM c""", ops="A03 C07")
def a03(spark, sf_dir):
    c = A.cumulative_utterances(A.dialogue_turns(T.table(spark, sf_dir, "conversations")))
    return c.select("conv_id", "turn_idx", F.size("utterances").cast("bigint").alias("n_utterances"),
                    F.array_join("utterances", " | ").alias("utterances"))


@register("a04_one_db_reader", T.with_views("""
SELECT query_id, 'star' AS db_id, CAST(len(string_split(gold, ' ')) AS BIGINT) AS n_query_toks,
  string_split(gold, ' ')[1] AS first_tok FROM workload""", "workload"), ops="A04")
def a04(spark, sf_dir):
    w = T.workload(spark, sf_dir)
    e = A.one_db_examples(w.withColumn("q", F.col("query_id")), "q", "gold", T.STAR_DB)
    return e.select(F.col("question").alias("query_id"), "db_id", F.size("query_toks").cast("bigint").alias("n_query_toks"),
                    F.get("query_toks", 0).alias("first_tok"))


# the workload with generated aliases in place of T1/T2/T3 (templates 2 and 7)
ALIASED_SQL = """CASE CAST(query_id % 8 AS INT)
      WHEN 2 THEN replace(replace(gold, 'T1', 'CUSTOMERalias0'), 'T2', 'ORDERSalias0')
      WHEN 7 THEN replace(replace(replace(gold, 'T1', 'ORDERSalias0'), 'T2', 'CUSTOMERalias0'), 'T3', 'NATIONalias0')
      ELSE gold END"""
_CANDS = "[" + ", ".join(f"'{t}alias{d}'" for t in [x.upper() for x in T.STAR_TABLES] + ["DERIVED_FIELD", "DERIVED_TABLE"]
                         for d in range(7)) + "]"


def aliased_workload(spark, sf_dir):
    w = T.workload(spark, sf_dir)
    g, k = F.col("gold"), (F.col("query_id") % 8).cast("int")
    r = lambda c, a, b: F.replace(c, F.lit(a), F.lit(b))
    return w.select("query_id", F.when(k == 2, r(r(g, "T1", "CUSTOMERalias0"), "T2", "ORDERSalias0"))
                    .when(k == 7, r(r(r(g, "T1", "ORDERSalias0"), "T2", "CUSTOMERalias0"), "T3", "NATIONalias0"))
                    .otherwise(g).alias("sql"))


@register("a05_alias_renaming", T.with_views(f"""
WITH a AS (SELECT query_id, {ALIASED_SQL} AS sql FROM workload),
p AS (SELECT query_id, sql, list_filter({_CANDS}, lambda c: contains(sql, c)) AS present FROM a)
SELECT query_id, list_reduce(list_transform(present, lambda c, i: [c, 'T' || CAST(i AS VARCHAR)]),
                             lambda acc, x: [replace(acc[1], x[1], x[2])], [sql])[1] AS sql
FROM p""", "workload"), ops="A05")
def a05(spark, sf_dir):
    return A.normalize_aliases(aliased_workload(spark, sf_dir), "sql", list(T.STAR_TABLES))


@register("a06_named_splits", T.with_views("""
SELECT CASE WHEN md5(CAST(query_id AS VARCHAR)) < '33333333' THEN 'validation' ELSE 'train' END AS split,
  CAST(count(*) AS BIGINT) AS n_samples FROM workload GROUP BY 1""", "workload"), ops="A06 B07")
def a06(spark, sf_dir):
    return B.split_counts(A.assign_split(T.workload(spark, sf_dir), "query_id"))


@register("b01_few_shot_head", """
SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT (SELECT CAST(floor(count(*) * 0.05) AS BIGINT) FROM documents)""", ops="B01")
def b01(spark, sf_dir):
    return B.few_shot_head(T.table(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"], 0.05)


@register("b02_seeded_sample", """
SELECT doc_id, source FROM documents ORDER BY md5(concat_ws('|', CAST(doc_id AS VARCHAR), '42')), doc_id
LIMIT (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM documents)""", ops="B02")
def b02(spark, sf_dir):
    return B.seeded_sample(T.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 0.1, 42)


_ORD = ", ".join(str(i) for i in B.FIXED_ORDINALS)


@register("b03_fixed_indexes", f"""
SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS ordinal FROM conversations)
WHERE ordinal IN ({_ORD})""", ops="B03")
def b03(spark, sf_dir):
    c = T.table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return B.fixed_index_selection(c, [F.col("conv_id"), F.col("turn")]).select("conv_id", "turn")


@register("b04_eval_cap", T.with_views("""
SELECT query_id, gold FROM workload ORDER BY query_id LIMIT 1034""", "workload"), ops="B04")
def b04(spark, sf_dir):
    return B.evaluation_cap(T.workload(spark, sf_dir), ["query_id"], 1034)


@register("b05_duplicates", """
WITH d AS (SELECT CASE WHEN md5(CAST(doc_id AS VARCHAR)) < '33333333' THEN 'validation' ELSE 'train' END AS split,
             text, lang, source, n_chars FROM documents),
g AS (SELECT split, count(*) AS c FROM d GROUP BY split, text, lang, source, n_chars)
SELECT split, CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(c - 1) AS BIGINT) AS n_duplicates FROM g GROUP BY split""", ops="B05")
def b05(spark, sf_dir):
    d = A.assign_split(T.table(spark, sf_dir, "documents"), "doc_id")
    return B.duplicate_count(d, ["text", "lang", "source", "n_chars"])


@register("b06_length_budget", f"""
WITH s AS (SELECT doc_id, {_STRIP.format(x='text')} AS t FROM documents),
w AS (SELECT doc_id, CASE WHEN t = '' THEN []::VARCHAR[] ELSE regexp_split_to_array(t, '\\s+') END AS words FROM s)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, len(words) > 512 AS truncated,
  array_to_string(words[1:512], ' ') AS text_budget FROM w""", ops="B06")
def b06(spark, sf_dir):
    d = B.length_budget(T.table(spark, sf_dir, "documents"), "text", 512)
    return d.select("doc_id", "n_words", "truncated", "text_budget")
