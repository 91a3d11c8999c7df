"""The registered queries of this subpackage: name → callable, and DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .common import sha256_hex, text_or_empty, written
from .decontam import leaks
from .fingerprints import fingerprint_documents
from .hard_negatives import hard_negatives
from .language_id import held_out, identify, train
from .license_scan import license_scan
from .line_dedup import line_dedup, line_dedup_sql
from .near_dedup import near_groups
from .piece_codec import encode_decode
from .pii import replace_entities
from .prefix_trie import ends_digest, numbered, prefix_trie, shared_heads, turn_keys
from .suffix_dedup import remove_repeats
from .token_counts import count_tokens
from .toxicity import held_out as toxicity_held_out
from .toxicity import score_toxicity
from .toxicity import train as train_toxicity

SURROGATE_KEY = b"replace this key in production"   # a parameter of the operator

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boilerplate lines of every site (source) of documents dropped."""
    done = line_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", sha256_hex(text_or_empty("text")).alias("kept_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text of documents."""
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License rules over every whole text of documents."""
    return license_scan(table(spark, sf_dir, "documents"))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with personal data, their texts with keyed surrogates."""
    return replace_entities(table(spark, sf_dir, "documents"), SURROGATE_KEY).drop("spans")


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of documents; digests of both."""
    done = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       sha256_hex(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
                       sha256_hex(F.col("decoded")).alias("decoded_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of documents."""
    docs = table(spark, sf_dir, "documents")
    done = identify(docs, train(docs))
    return done.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op7_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every whole text covered by a 200-byte string that occurs elsewhere."""
    done = remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of every whole text of documents."""
    return near_groups(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item: (doc_id, item_id) pairs."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of every whole text and of its edited text."""
    done = fingerprint_documents(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_chars", sha256_hex(F.col("edited")).alias("edited_sha256"), "fingerprint",
                       "edited_fingerprint", "near_edited", "near_next")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of documents."""
    docs = table(spark, sf_dir, "documents")
    done = score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))
    return done.select("doc_id", toxicity_held_out("doc_id").alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits", "n_quoted")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of conversations, rebuilt with shared heads."""
    turns = written(numbered(turn_keys(table(spark, sf_dir, "conversations"))), "turns")
    nodes, ends = prefix_trie(shared_heads(turns), turns)
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return nodes.join(ends_digest(ends), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector of embeddings, labels shifted for every seventh."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", shifted)
    return hard_negatives(rows, F.col("id") % 100 == 0)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_line_dedup,
    op2_token_counts,
    op3_license_scan,
    op4_pii_surrogates,
    op5_piece_codec,
    op6_language_id,
    op7_repeat_removal,
    op8_near_dedup,
    op9_decontamination,
    op10_document_fingerprints,
    op11_toxicity,
    op12_prefix_trie,
    op13_hard_negatives,
)}

ORACLE: dict[str, str] = {
    "op1_line_dedup": line_dedup_sql(),
}
