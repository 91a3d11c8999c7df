"""Sampling, caps and hygiene.

"First n rows" needs a total order; all selections here are exact: heads and
samples by selection of the n-th key and a filter (``plan_utils.first_k``), fixed
positions by a range-partitioned sort (``with_position``).
Random sampling is replaced by an md5 order of (id, seed) — deterministic and
reproducible in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.plan_utils import first_k
from ..session import cut_lineage

# The published 50 training ordinals of the one-database corpus (ratio 0.094).
FIXED_ORDINALS = (19, 514, 375, 341, 274, 492, 221, 515, 360, 58, 413, 418, 333, 487, 28, 122, 344, 208, 475, 108,
                  264, 155, 0, 23, 4, 73, 129, 27, 61, 8, 74, 469, 500, 396, 362, 430, 17, 203, 171, 33, 139, 80,
                  503, 206, 243, 5, 486, 423, 244, 130)


def few_shot_head(df: DataFrame, order_cols: list[str], ratio: float) -> DataFrame:
    """The first int(n·ratio) rows in input order."""
    k = int(df.count() * ratio)
    return first_k(df, [F.col(c) for c in order_cols], k)


def seeded_sample(df: DataFrame, id_col: str, ratio: float, seed: int = 42) -> DataFrame:
    """int(n·ratio) rows without replacement, order md5(id|seed) then id."""
    k = int(df.count() * ratio)
    key = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))
    return first_k(df, [key, F.col(id_col)], k)


def with_position(df: DataFrame, order_cols: list[Column], name: str = "ordinal") -> DataFrame:
    """0-based global position in a total order, without an un-partitioned window:
    range-partitioned sort + per-partition offsets (one row per partition)."""
    s = cut_lineage(df.orderBy(*order_cols).withColumn("_mid", F.monotonically_increasing_id())
                      .withColumn("_pid", F.spark_partition_id()))
    parts = s.groupBy("_pid").agg(F.min("_mid").alias("_m0"), F.count("*").alias("_n")).orderBy("_pid").collect()
    rows, acc = [], 0
    for r in parts:
        rows.append((r["_pid"], r["_m0"], acc))
        acc += r["_n"]
    off = df.sparkSession.createDataFrame(rows, "_pid int, _m0 long, _off long")
    return (s.join(F.broadcast(off), "_pid")
             .withColumn(name, F.col("_off") + F.col("_mid") - F.col("_m0"))
             .drop("_mid", "_pid", "_m0", "_off"))


def fixed_index_selection(df: DataFrame, order_cols: list[Column], ordinals=FIXED_ORDINALS) -> DataFrame:
    """Keep the rows at a published list of ordinals (broadcast semi-join)."""
    ids = df.sparkSession.createDataFrame([(int(i),) for i in ordinals], "ordinal long")
    return with_position(df, order_cols).join(F.broadcast(ids), "ordinal", "left_semi")


def evaluation_cap(df: DataFrame, order_cols: list[str], max_samples: int | None) -> DataFrame:
    """First max_val_samples rows (no cap when None)."""
    return df if max_samples is None else first_k(df, [F.col(c) for c in order_cols], max_samples)


def duplicate_count(df: DataFrame, cols: list[str], by: str = "split") -> DataFrame:
    """Rows − distinct rows per split. Wide text rows are grouped on an
    xxhash64 of the columns first (map-side partial counts), and only hash
    groups of 2+ rows are confirmed on the full values."""
    h = df.withColumn("_h", F.xxhash64(*cols))
    per_hash = h.groupBy(by, "_h").agg(F.count("*").alias("_n"))
    multi = per_hash.filter("_n > 1")
    confirm = (h.join(multi.select(by, "_h"), [by, "_h"], "left_semi")
                .groupBy(by, "_h", *cols).agg(F.count("*").alias("_c"))
                .groupBy(by).agg(F.sum(F.col("_c") - 1).alias("n_duplicates")))
    rows = per_hash.groupBy(by).agg(F.sum("_n").alias("n_rows"))
    return (rows.join(confirm, by, "left")
                .select(by, F.col("n_rows").cast("bigint"), F.coalesce("n_duplicates", F.lit(0)).cast("bigint").alias("n_duplicates")))


def length_budget(df: DataFrame, text_col: str, budget: int) -> DataFrame:
    """Cut text to a whitespace-token budget; keep the flag and word count."""
    s = F.regexp_replace(F.col(text_col), r"^\s+|\s+$", "")
    words = F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, r"\s+"))
    return df.withColumns({
        "n_words": F.size(words).cast("bigint"),
        "truncated": F.size(words) > budget,
        f"{text_col}_budget": F.array_join(F.slice(words, 1, budget), " "),
    })


def split_counts(df: DataFrame, by: str = "split") -> DataFrame:
    """Number of samples per split."""
    return df.groupBy(by).agg(F.count("*").alias("n_samples"))
