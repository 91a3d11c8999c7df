"""Planning helpers shared by the operators: sizes of tasks, selection by rank and components."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..session import cut_lineage

SAMPLE = 4_000       # sampled keys a round of the selection brings to the driver, about
TAIL = 4_000         # keys of the last, exact step

MOST_TASKS = 200     # a shuffle of more parts holds a writing task's rows in memory (spark.shuffle.sort.bypassMergeThreshold)


def bounded_tasks(*shares: float) -> int:
    """How many tasks to deal rows to, by the tasks that their number and their bytes call for."""
    return min(MOST_TASKS, 1 + int(max(shares)))


def _literal(row: Row, fields) -> Column:
    return F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in fields])


def kth_key(keys: DataFrame, k: int, n: int) -> tuple[Row, int]:
    """The k-th smallest of the ``n`` rows' keys (1 <= k <= n, nulls first) and how
    many keys are below it.

    Selection by sampling: two keys of a sample close in on rank k, one pass counts
    what is below and between them, and the search goes on with the part that holds
    rank k, until that part is small enough to be sorted. A round is a pass over the
    key columns; nothing is sorted, shuffled or written but the last few keys.
    """
    fields = keys.schema.fields
    names = [f.name for f in fields]
    key = F.struct(*names)
    part, below, size, seed = keys, 0, n, 0
    while size > TAIL:
        rank, seed = k - below, seed + 1
        seen = part.sample(min(1.0, SAMPLE / size), seed=seed).orderBy(*names).collect()
        if not seen:
            continue
        slack = 3 * math.sqrt(len(seen)) * 0.5 + 1
        at = rank / size * len(seen)
        low, high = seen[max(0, int(at - slack))], seen[min(len(seen) - 1, int(at + slack))]
        lo, hi = _literal(low, fields), _literal(high, fields)
        under, to_low, to_high = part.agg(F.count_if(key < lo), F.count_if(key <= lo), F.count_if(key <= hi)).first()
        if under < rank <= to_low:
            return low, below + under
        if rank <= under:
            part, size = part.where(key < lo), under
        elif rank <= to_high:
            if to_high - to_low == size:                   # everything but the least key: no progress without its top
                under_high = part.where(key < hi).count()
                if rank > under_high:
                    return high, below + under_high
                part, size = part.where(key < hi), under_high
                continue
            part, below, size = part.where((key > lo) & (key <= hi)), below + to_low, to_high - to_low
        else:
            part, below, size = part.where(key > hi), below + to_high, size - to_high
    rows = part.orderBy(*names).limit(k - below).collect()       # TAIL keys at most
    found = rows[-1]
    return found, below + next(i for i, r in enumerate(rows) if r == found)


def first_k(df: DataFrame, order_cols: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of ``df`` in a total order, exactly, for any k: the k-th
    key by selection, then a filter. Among rows that share the k-th key any may
    fill the rest (there are none in a total order)."""
    if k <= 0:
        return df.limit(0)
    keyed = [c.alias(f"_k{i}") for i, c in enumerate(order_cols)]
    n = df.count()
    if k >= n:
        return df
    keys = df.select(*keyed)
    kth, below = kth_key(keys, k, n)
    limit = _literal(kth, keys.schema.fields)
    key = F.struct(*keyed)
    ties = keys.where(F.struct(*keys.columns) == limit).count()
    if below + ties == k:
        return df.where(key <= limit)
    return df.where(key < limit).unionByName(df.where(key == limit).limit(k - below))


def components(edges: DataFrame, by: list[str]) -> tuple[DataFrame, int]:
    """(by..., node, comp) of the nodes of ``edges`` (by..., a, b): the smallest
    node reachable; and the number of rounds, about the logarithm of the longest
    path. Each round links the larger neighbours of a node to its smallest one,
    then the smaller ones; its edges are checkpointed."""
    on = lambda u: [*by, u]
    now = cut_lineage(edges.where("a <> b").select(*by, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen, rounds = None, 0
    while True:
        rounds += 1
        both = now.unionByName(now.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*on("u")).agg(F.min("v").alias("m")).select(*on("u"), F.least("u", "m").alias("m"))
        large = both.join(least, on("u")).where("v > u").select(*by, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(*on("u")).agg(F.min("v").alias("m"))
        small = (large.join(least, on("u")).where("v <> m").select(*by, F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
                 .unionByName(least.select(*on("u"), F.col("m").alias("v"))).distinct())
        now = cut_lineage(small)
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64(*now.columns))).first())
        if state == seen:
            break
        seen = state
    star = now.select(*by, F.col("u").alias("node"), F.col("v").alias("comp"))
    return star.unionByName(now.select(*by, F.col("v").alias("node"), F.col("v").alias("comp")).distinct()), rounds
