"""Sinks (A16-A19): prediction lines, prediction records, hypothesis append, score report.

All are plain DataFrame writers; ordering, where the format needs one, is a
global sort on the example key done by Spark (range-partitioned), never a
driver-side loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_prediction_lines(pred: DataFrame, path: str, key: str = "ex_id", col: str = "pred_sql") -> None:
    """One predicted SQL per line, in input order (part files in key order)."""
    pred.orderBy(key).select(F.coalesce(F.col(col), F.lit("")).alias("value")).write.mode("overwrite").text(path)


def write_prediction_records(pred: DataFrame, path: str, fmt: str = "json") -> None:
    """Input, prediction, label, score flag, pred_sql, gold_sql (+turn_idx)."""
    cols = [c for c in ("ex_id", "input", "prediction", "label", "score", "pred_sql", "gold_sql", "turn_idx") if c in pred.columns]
    pred.select(*cols).write.mode("overwrite").format(fmt).save(path)


def append_hypotheses(hyp: DataFrame, path: str, batch_id: int) -> None:
    """Grow the top-k table batch by batch (append, partitioned by batch)."""
    hyp.withColumn("batch_id", F.lit(batch_id)).write.mode("append").partitionBy("batch_id").parquet(path)


def write_score_report(per_item: DataFrame, totals: DataFrame, path: str) -> None:
    """Per-item rows and total scores as two JSON outputs."""
    per_item.write.mode("overwrite").json(f"{path}/per_item")
    totals.write.mode("overwrite").json(f"{path}/total_scores")


def append_hypothesis_batches(hyp: DataFrame, path: str, batch_col: str = "batch_id") -> None:
    """A18 for many batches at once (one job): rows carry their batch id and meet
    by it before the write, so a batch is one file per shuffle partition at most."""
    hyp.repartition(batch_col).write.mode("append").partitionBy(batch_col).parquet(path)
