"""User metrics as mergeable partial states.

A metric says how a state begins (``init``), takes a pandas batch of rows
(``update``), meets another state (``merge``) and becomes the result
(``finish``); states and results are dicts whose columns are declared, so they
travel as Arrow rows. Each task folds its rows into one state per group before
anything is shuffled; states meet in two levels, so no task sees more than about
the square root of all partitions' states of a group.

Cases: an empty table without groups gives the result of the empty state, with
groups no rows; null group values are a group of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

State = dict[str, object]
HELD = 10_000        # groups a task holds before it passes their states on
LANES = 64           # first-level merges of one group


@dataclass(frozen=True)
class Metric:
    state: str                                        # DDL of the partial state
    result: str                                       # DDL of the result
    init: Callable[[], State]
    update: Callable[[State, pd.DataFrame], State]
    merge: Callable[[State, State], State]
    finish: Callable[[State], State]


METRICS: dict[str, Metric] = {}


def register_metric(name: str, metric: Metric) -> Metric:
    METRICS[name] = metric
    return metric


def run_metric(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The registered metric over ``df``: one row, or one per group of ``by``."""
    metric = METRICS[name]
    if by:
        keys = list(by)
    else:
        df, keys = df.withColumn("__all", F.lit(0)), ["__all"]
    groups = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    partial = f"{groups}, {metric.state}"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, State] = {}
        for batch in batches:
            for key, rows in batch.groupby(keys, dropna=False, sort=False):
                key = tuple(None if pd.isna(k) else k for k in key)
                held[key] = metric.update(held.get(key) or metric.init(), rows)
            if len(held) > HELD:
                yield _frame(held, keys)
                held = {}
        if held:
            yield _frame(held, keys)

    def meet(rows: pd.DataFrame) -> State:
        state = metric.init()
        for row in rows.drop(columns=[*keys, "__lane"], errors="ignore").to_dict("records"):
            state = metric.merge(state, row)
        return state

    def first_level(rows: pd.DataFrame) -> pd.DataFrame:
        return _frame({tuple(rows[keys].iloc[0]): meet(rows)}, keys)

    def second_level(rows: pd.DataFrame) -> pd.DataFrame:
        return _frame({tuple(rows[keys].iloc[0]): metric.finish(meet(rows))}, keys)

    states = df.mapInPandas(fold, partial).withColumn("__lane", F.spark_partition_id() % LANES)
    merged = states.groupBy(*keys, "__lane").applyInPandas(first_level, partial)
    done = merged.groupBy(*keys).applyInPandas(second_level, f"{groups}, {metric.result}")
    if by:
        return done
    # no rows at all: the result of the empty state
    empty = df.sparkSession.createDataFrame([metric.finish(metric.init())], metric.result)
    nothing = done.select(F.count("*").alias("__n")).where("__n = 0")
    return done.drop("__all").unionByName(empty.join(F.broadcast(nothing), F.lit(True)).drop("__n"))


def _frame(states: dict[tuple, State], keys: list[str]) -> pd.DataFrame:
    return pd.DataFrame([dict(zip(keys, key)) | state for key, state in states.items()])


# ---------------------------------------------------------------- an example: words in common
def _add(a: State, b: State) -> State:
    return {k: a[k] + b[k] for k in a}


def _words(state: State, rows: pd.DataFrame) -> State:
    gold, pred = ([set((t or "").split(" ")) - {""} for t in rows[c]] for c in ("gold", "pred"))
    return _add(state, {"n": len(rows), "n_gold": sum(map(len, gold)), "n_pred": sum(map(len, pred)),
                        "n_both": sum(len(g & p) for g, p in zip(gold, pred))})


def _shares(state: State) -> State:
    share = lambda total: round(state["n_both"] / total, 6) if total else 0.0
    return {"n_pairs": state["n"], "word_precision": share(state["n_pred"]), "word_recall": share(state["n_gold"])}


register_metric("word_overlap", Metric(
    state="n bigint, n_gold bigint, n_pred bigint, n_both bigint",
    result="n_pairs bigint, word_precision double, word_recall double",
    init=lambda: {"n": 0, "n_gold": 0, "n_pred": 0, "n_both": 0}, update=_words, merge=_add, finish=_shares))
