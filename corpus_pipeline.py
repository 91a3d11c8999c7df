"""Cleaning pipeline over ``documents``: language, lines, copies, benchmarks, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns a DataFrame; all but the last return the columns of ``documents``
(``n_chars`` follows the text). ``run`` writes every stage as Parquet in the
shared checkpoint folder and reads it again as the next one's docs.

Cases: see the operators; a row whose id is null or repeated is named by a number
of its own inside a stage, so it is judged by its own text; an empty table stays
empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import sha256_hex, written
from quarry.llm.decontam import leaks
from quarry.llm.language_id import UND, identify, train
from quarry.llm.line_dedup import line_dedup
from quarry.llm.near_dedup import near_groups
from quarry.llm.piece_codec import encode_decode
from quarry.sources.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the learned languages; the model
    decides by the text alone."""
    found = identify(docs, train(docs), carry=COLUMNS[2:], keep_text=True, judge=True)
    return found.where((F.col("lang_pred") != UND) & F.col("learned")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its site's boilerplate lines."""
    cleaned = line_dedup(docs.select(*COLUMNS))
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


KEY = "__row"


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a number per row: the id, or far below zero where it is null or
    repeated (such rows are numbered once and written)."""
    repeated = docs.groupBy(F.col("doc_id").alias("again")).agg(F.count("*").alias("n")).where("n > 1 OR again IS NULL").select("again")
    if repeated.isEmpty():
        return docs.withColumn(KEY, F.col("doc_id").cast("bigint"))
    marked = docs.join(repeated.withColumn("own", F.lit(True)), F.col("doc_id").eqNullSafe(F.col("again")), "left")
    number = F.when(F.col("own"), F.lit(-2**62) + F.monotonically_increasing_id()).otherwise(F.col("doc_id").cast("bigint"))
    return written(marked.withColumn(KEY, number).drop("again", "own"), "keyed")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    return docs.join(gone.distinct(), KEY, "left_anti").select(*COLUMNS)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    rows = keyed(docs)
    return without(rows, near_groups(rows, id_col=KEY).where("NOT kept").select(F.col("doc_id").alias(KEY)))


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    rows = keyed(docs)
    return without(rows, leaks(rows, table(spark, sf_dir, "benchmark"), id_col=KEY).select(KEY))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of ids and decoded text."""
    done = encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                       sha256_hex(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
                       sha256_hex(F.col("decoded")).alias("decoded_sha256"))


STAGES = [
    ("language", language),
    ("lines", lines),
    ("copies", copies),
    ("benchmarks", benchmarks),
    ("pieces", pieces),
]

# Language model and token ids are no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
