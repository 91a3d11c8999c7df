"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def text_runs(column: pa.Array, size: int = 2_000_000) -> Iterator[list[str | None]]:
    """The texts of an Arrow column in runs of about ``size`` bytes (one text
    at least), so that per-run scratch lists stay small."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for k, n in enumerate(lengths):
        if total and total + n > size:
            yield column.slice(start, k - start).to_pylist()
            start, total = k, 0
        total += n
    if start < len(lengths):
        yield column.slice(start).to_pylist()


_KEPT: dict[str, tuple[Hashable, object]] = {}


def kept_in_worker(name: str, key: Hashable, make: Callable[[], object]):
    """An object that a Python worker keeps from task to task (one per name, of
    the last key): tables and memos that are dear to build. Never a result."""
    if name not in _KEPT or _KEPT[name][0] != key:
        _KEPT[name] = (key, make())
    return _KEPT[name][1]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: later jobs start from files that every executor can read."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def sha256_hex(col: Column) -> Column:
    return F.sha2(F.encode(col, "utf-8"), 256)


FILTER_BITS = 1 << 24          # 2 MB; a fuller filter only lets more rows through


def id_slot(col: Column) -> Column:
    """Bit of an id in the filter of ``id_filter``."""
    return F.pmod(F.xxhash64(col), F.lit(FILTER_BITS)).cast("int")


def id_filter(ids: DataFrame, col: str) -> np.ndarray:
    """Bit set of fixed size that has the slot of every id. It only thins out
    rows before a join that decides exactly; it never decides itself. The
    driver sees at most FILTER_BITS / 64 words."""
    words = (ids.select(id_slot(F.col(col)).alias("s"))
             .groupBy((F.col("s") / 64).cast("int").alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, s % 64)")).alias("bits")).collect())
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words:
        out[r["w"]] = r["bits"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(np.bool_)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node in ``edges`` (a, b): comp is the smallest node
    reachable. Alternating large-star and small-star rounds; each round's edges
    are written, and the driver sees one count and one checksum per round. The
    rounds end by themselves: each moves edges to smaller nodes or is the last."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = written(small, "cc")
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
