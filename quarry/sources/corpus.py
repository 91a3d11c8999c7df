"""Example corpora as DataFrames.

Readers take declared schemas (no inference). The driver tables stand in for
the corpora: ``conversations`` is the dialogue corpus (dialogue = conv_id,
utterance = text, turns in ``turn`` order; its last turn plays the final
summary utterance), the SQL ``workload`` is the one-database corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SINGLE_TURN_SCHEMA = T.StructType([
    T.StructField("db_id", T.StringType()), T.StructField("query", T.StringType()),
    T.StructField("query_toks", T.ArrayType(T.StringType())), T.StructField("question", T.StringType()),
])
DIALOGUE_SCHEMA = T.StructType([
    T.StructField("database_id", T.StringType()),
    T.StructField("final", T.StructType([T.StructField("utterance", T.StringType()), T.StructField("query", T.StringType())])),
    T.StructField("interaction", T.ArrayType(T.StructType([T.StructField("utterance", T.StringType()),
                                                           T.StructField("query", T.StringType())]))),
])
ONE_DB_SCHEMA = T.StructType([T.StructField("query", T.StringType()), T.StructField("sql", T.StringType())])
SCHEMA_JSON_SCHEMA = T.StructType([
    T.StructField("table", T.StringType()),
    T.StructField("col_data", T.ArrayType(T.StructType([T.StructField("column_name", T.StringType())]))),
])


def strip(c: Column) -> Column:
    """Python-style str.strip(): leading and trailing white space."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


# ----------------------------------------------------------------- A01 / A06
def read_single_turn(spark: SparkSession, paths, split: str = "train", multi_line: bool = True) -> DataFrame:
    """JSON array files (or JSON lines) → examples with the split (A06) and an
    ex_id that depends on the example's content only; equal examples are told
    apart by a running number."""
    df = spark.read.schema(SINGLE_TURN_SCHEMA).json(paths, multiLine=multi_line)
    content = F.xxhash64("db_id", "query", F.to_json("query_toks"), "question")
    same = W.partitionBy("_content", "db_id", "query", "question").orderBy("_content")
    return (df.withColumn("_content", content).withColumn("_nth", F.row_number().over(same))
              .withColumn("split", F.lit(split)).withColumn("ex_id", F.xxhash64("_content", "_nth")).drop("_content", "_nth"))


def assign_split(df: DataFrame, key: str, validation_share_hex: str = "33333333") -> DataFrame:
    """Deterministic named split (train / validation) from md5 of the key."""
    return df.withColumn("split", F.when(F.md5(F.col(key).cast("string")) < validation_share_hex, "validation")
                         .otherwise("train"))


# --------------------------------------------------------------- A02 / A03
def dialogue_turns(conv: DataFrame) -> DataFrame:
    """One row per turn plus one ``turn_idx = -1`` row per dialogue (its final utterance)."""
    turns = conv.select("conv_id", F.col("turn").cast("int").alias("turn_idx"), F.col("text").alias("utterance"), "role")
    final = (conv.groupBy("conv_id").agg(F.max_by(F.struct("text", "role"), "turn").alias("f"))
                 .select("conv_id", F.lit(-1).alias("turn_idx"), F.col("f.text").alias("utterance"), F.col("f.role").alias("role")))
    return turns.unionByName(final)


def cumulative_utterances(turns: DataFrame) -> DataFrame:
    """Per turn, every utterance so far, each split on ``|`` and stripped.

    The final row (turn_idx -1) carries only its own utterance, unsplit.
    """
    inter = turns.filter(F.col("turn_idx") >= 0)
    w = W.partitionBy("conv_id").orderBy("turn_idx").rowsBetween(W.unboundedPreceding, W.currentRow)
    pieces = F.transform(F.split(F.col("utterance"), r"\|"), strip)
    inter = inter.withColumn("utterances", F.flatten(F.collect_list(pieces).over(w)))
    final = turns.filter(F.col("turn_idx") < 0).withColumn("utterances", F.array(F.col("utterance")))
    return inter.unionByName(final)


def read_dialogues(spark: SparkSession, paths, multi_line: bool = True) -> DataFrame:
    """A02/A03 from JSON files ``{database_id, final, interaction[]}``: one row per
    dialogue with turn_idx -1 (the final utterance alone) and one per turn with
    every utterance so far, split on ``|`` and stripped; each with its query."""
    d = spark.read.schema(DIALOGUE_SCHEMA).json(paths, multiLine=multi_line)
    said = F.transform("interaction", lambda t: F.transform(F.split(t["utterance"], r"\|"), strip))
    turns = d.select(F.col("database_id").alias("db_id"), said.alias("said"), F.posexplode("interaction").alias("turn_idx", "turn"))
    turns = turns.select("db_id", "turn_idx", F.flatten(F.slice("said", F.lit(1), F.col("turn_idx") + 1)).alias("utterances"),
                         F.col("turn.query").alias("query"))
    final = d.filter(F.col("final").isNotNull()).select(F.col("database_id").alias("db_id"), F.lit(-1).alias("turn_idx"),
                     F.array("final.utterance").alias("utterances"), F.col("final.query").alias("query"))
    return final.unionByName(turns)


# --------------------------------------------------------------------- A04
def one_db_examples(df: DataFrame, question_col: str, sql_col: str, db_id: str) -> DataFrame:
    """question/sql pairs of a single database; query_toks = whitespace split."""
    return df.select(F.col(question_col).alias("question"), F.col(sql_col).alias("query"),
                     F.split(F.col(sql_col), " ").alias("query_toks"), F.lit(db_id).alias("db_id"))


def read_one_db(spark: SparkSession, paths, table_names: list[str], db_id: str, multi_line: bool = True) -> DataFrame:
    """A04 from JSON files ``{query: question, sql}``: generated aliases renamed
    (A05), tokens by white space."""
    d = normalize_aliases(spark.read.schema(ONE_DB_SCHEMA).json(paths, multiLine=multi_line), "sql", table_names)
    words = F.filter(F.split(strip(F.col("sql")), r"\s+"), lambda w: w != "")
    return d.select(F.col("query").alias("question"), F.col("sql").alias("query"), words.alias("query_toks"), F.lit(db_id).alias("db_id"))


# --------------------------------------------------------------------- A05
def normalize_aliases(df: DataFrame, sql_col: str, table_names: list[str]) -> DataFrame:
    """Generated aliases ``TABLEaliasN`` → T1, T2, … in (table order, N) order
    among those present, then ``DERIVED_FIELD``/``DERIVED_TABLE`` aliases. Whole
    identifiers are taken, with any N, so one table's name may end another's."""
    names = F.array(*[F.lit(t.upper()) for t in table_names] + [F.lit("DERIVED_FIELD"), F.lit("DERIVED_TABLE")])
    sql = F.col(sql_col)
    found = F.array_distinct(F.regexp_extract_all(sql, F.lit(r"(?<![A-Za-z0-9_])[A-Z][A-Z0-9_]*alias[0-9]+"), 0))
    keyed = F.transform(found, lambda a: F.struct(
        F.array_position(names, F.regexp_replace(a, "alias[0-9]+$", "")).alias("table"),
        F.regexp_extract(a, "([0-9]+)$", 1).cast("decimal(38,0)").alias("n"), a.alias("old")))
    known = F.array_sort(F.filter(keyed, lambda x: x["table"] > 0))
    numbered = F.transform(known, lambda x, i: F.struct(x["old"].alias("old"), F.concat(F.lit("T"), (i + 1).cast("string")).alias("new")))
    return df.withColumn(sql_col, F.aggregate(numbered, sql, lambda acc, x: F.regexp_replace(
        acc, F.concat(F.lit("(?<![A-Za-z0-9_])"), x["old"], F.lit("(?![0-9])")), x["new"])))


# --------------------------------------------------------------------- A15
def schema_from_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``[{table, col_data: [{column_name}]}]`` → (table, column) rows, lower-cased."""
    d = spark.read.schema(SCHEMA_JSON_SCHEMA).json(path, multiLine=multi_line)
    return d.select(F.lower("table").alias("table_name"),
                    F.posexplode("col_data").alias("col_pos", "c")).select(
        "table_name", "col_pos", F.lower("c.column_name").alias("column_name"))
