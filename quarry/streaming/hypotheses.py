"""Incremental first-valid selection over an appended hypotheses folder (A18 → F10).

All candidates of one example are appended in the same batch (the decoder
writes an example's top-k together), so first-valid selection is complete per
micro-batch: ``foreachBatch`` runs the batch pipeline (tokenize → segment →
schema check → pick) on each new slice and appends the chosen predictions,
idempotently keyed by the micro-batch id. The streaming checkpoint gives
exactly-once progress across restarts and executor loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plan_utils import bounded_tasks
from ..operators import catalog as C
from ..operators import querylog as Q
from ..operators import scoring as S
from ..operators import slots as L
from ..session import cut_lineage

HYP_SCHEMA = "ex_id long, hyp_rank int, pred string, batch_id int"
TASK_ROWS = 150_000             # candidates of one task, about
TASK_BYTES = 32 * 1024 * 1024   # and bytes of their texts
HEAVY_TEXTS = 1_000             # a text is heavy with more than this part of all candidates


def pick_first_valid(batch: DataFrame, cols: DataFrame, canon: DataFrame, db_id: str) -> DataFrame:
    """F10 on one slice of candidates; each distinct shape of a text is checked once.

    Candidates meet the verdict on their text, then the others of their example, in
    tasks of bounded size: SQL texts shrink so much in a shuffle that the planner's
    sizes say nothing about the memory of a sort. The few texts that hold a large
    share of all candidates are broadcast and their candidates dealt by example and
    rank, as are those without a text.
    """
    texts, shapes = Q.text_shapes(batch, "pred", counted=True)
    seg = Q.shape_rows(shapes)
    inv = cut_lineage(S.resolve(seg, cols, canon, db_id).select(F.col("query_id").alias("text_id"), "invalid").distinct())
    n, size = texts.agg(F.sum("n_rows"), F.sum(F.col("n_rows") * F.octet_length("text"))).first()
    tasks = bounded_tasks((n or 0) / TASK_ROWS, (size or 0) / TASK_BYTES)
    # empty and token-less texts have no row: invalid, as are NULL ones
    verdicts = texts.join(inv, "text_id", "left").select(F.col("text").alias("pred"), F.coalesce("invalid", F.lit(True)).alias("invalid"), "n_rows")
    heavy = F.col("n_rows") * HEAVY_TEXTS > (n or 0)
    known = F.broadcast(verdicts.where(heavy).select("pred", F.col("invalid").alias("known")))      # HEAVY_TEXTS rows at most
    rows = batch.select("ex_id", "hyp_rank", "pred").join(known, "pred", "left")
    at = F.when(F.col("known").isNull() & F.col("pred").isNotNull(), F.xxhash64("pred")).otherwise(F.xxhash64("ex_id", "hyp_rank"))
    rows = rows.withColumn("at", at).repartition(tasks, "at", "pred")
    rest = verdicts.where(~heavy).select(F.xxhash64("pred").alias("at"), "pred", "invalid").repartition(tasks, "at", "pred")
    hv = rows.hint("merge").join(rest, ["at", "pred"], "left").select(
        "ex_id", "hyp_rank", "pred", (~F.coalesce("known", "invalid", F.lit(True))).alias("valid"))
    return L.first_valid(hv.repartition(tasks, "ex_id"))


def stream_first_valid(spark: SparkSession, source: str, sink: str, checkpoint: str, sf_dir: str, db_id: str,
                       available_now: bool = True):
    """Start the stream; returns the StreamingQuery."""
    cols = C.profile(spark, sf_dir)
    canon = S.fk_canonical(spark, cols, C.foreign_keys(spark, cols)).cache()

    def each(batch: DataFrame, epoch: int) -> None:
        chosen = pick_first_valid(batch, cols, canon, db_id).withColumn("epoch", F.lit(epoch))
        # idempotent per epoch: a replayed epoch overwrites its own partition only
        (chosen.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
               .partitionBy("epoch").parquet(sink))

    reader = spark.readStream.schema(HYP_SCHEMA).parquet(source)
    w = reader.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
