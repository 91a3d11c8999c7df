"""User-function surface.

H01 row map: a per-example function adding columns; H02 batched map with
column replacement: a function over a pandas batch (dict of columns) whose
output replaces the input columns. Both run as ``mapInPandas`` (Arrow
batches, one Python worker per task); built-in column expressions should be
preferred whenever they can say the same thing. H03 metric plug-ins are in
``operators/metrics.py``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def row_map(df: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """``fn(row_dict) -> row_dict`` applied to every row, vectorized per batch."""
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [fn(r) for r in pdf.to_dict("records")]
            yield pd.DataFrame(out, columns=names)
    return df.mapInPandas(run, schema)


def batched_map(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
                drop: list[str] | None = None) -> DataFrame:
    """``fn(batch) -> batch``; columns in ``drop`` are removed from the output."""
    drop = drop or []
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = fn(pdf).drop(columns=[c for c in drop if c in pdf.columns], errors="ignore")
            yield out[names]
    return df.mapInPandas(run, schema)


# Example functions used by the registered plans.
def text_stats(r: dict) -> dict:
    g = r["gold"]
    return {"query_id": r["query_id"], "n_chars": len(g), "n_words": len(g.split(" ")), "verb": g.split(" ", 1)[0].upper()}


def line_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.assign(n_lines=pdf["text"].str.count("\n") + 1)
