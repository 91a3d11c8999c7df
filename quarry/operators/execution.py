"""Execution match (E17, E43, E44, G23): run SQL texts on Spark and compare result bags.

This is the one driver-bound family (kind D): Spark can only execute a SQL
*text* through ``spark.sql``, so the distinct texts of a workload are listed on
the driver. They are analyzed one by one (cheap, no data touched), then
executed in batches: each batch is one ``UNION ALL`` job whose rows
``(text_id, to_json(struct(*)))`` are written to a table in the shared
checkpoint folder, so lineage stays short and a lost executor only re-runs
its batch. Result comparison is a distributed bag comparison (join on
``(pair, row)``), never a driver loop over rows.
"""

from __future__ import annotations

import logging
import re
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

_LIKE = re.compile(r"\blike\b", re.IGNORECASE)


def sqlite_dialect(sql: str) -> str:
    """SQLite LIKE ignores ASCII case → ILIKE (outside string literals)."""
    parts = re.split(r'("[^"]*"|\'[^\']*\')', sql)
    return "".join(p if i % 2 else _LIKE.sub("ILIKE", p) for i, p in enumerate(parts))


class quiet_log:
    """Analysis failures are expected here (invalid predictions): silence the
    driver log while texts are analyzed, then restore its level."""

    def __init__(self, spark: SparkSession):
        self.sc = spark.sparkContext
        self.level = None

    def __enter__(self):
        try:
            self.level = str(self.sc._jvm.org.apache.logging.log4j.LogManager.getRootLogger().getLevel())
        except Exception:  # noqa: BLE001
            self.level = "WARN"
        self.sc.setLogLevel("OFF")
        self.py = logging.getLogger("SQLQueryContextLogger")
        self.py_level = self.py.level
        self.py.setLevel(logging.CRITICAL)
        return self

    def __exit__(self, *exc):
        self.sc.setLogLevel(self.level or "WARN")
        self.py.setLevel(self.py_level)
        return False


def result_columns(spark: SparkSession, sql: str) -> list[str] | None:
    """Column names of the text's result, or None when Spark rejects it (no data is read)."""
    try:
        return spark.sql(sqlite_dialect(sql)).columns
    except (AnalysisException, ParseException):
        return None
    except Exception:  # noqa: BLE001  (other analyzer errors count as not executable)
        return None


def executable(spark: SparkSession, sql: str) -> bool:
    """Does Spark accept (parse + analyze) the text?"""
    return result_columns(spark, sql) is not None


def _row_expr(names: list[str]) -> str:
    """One result row as text that ignores the column order: the sorted
    ``name=value`` pairs (columns are compared by what they select, not where)."""
    def lit(x: str) -> str:
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    pairs = ", ".join(f"concat({lit(n)}, '=', coalesce(to_json(named_struct('v', c{i})), 'null'))" for i, n in enumerate(names))
    return f"array_join(array_sort(array({pairs})), '\u0001')"


def run_texts(spark: SparkSession, texts: DataFrame, text_col: str = "sql", batch: int = 256,
              analyze_threads: int = 8, concurrent_jobs: int = 3) -> tuple[DataFrame, DataFrame]:
    """Run every distinct text once.

    Returns ``(status(text_id, sql, ok), rows(text_id, row))`` where ``text_id``
    is ``xxhash64`` of the text and ``row`` one result row as sorted
    ``name=value`` pairs.
    """
    distinct = texts.select(F.col(text_col).alias("sql")).filter(F.col("sql").isNotNull()).distinct() \
                    .withColumn("text_id", F.xxhash64("sql"))
    listed = [(r.text_id, r.sql) for r in distinct.collect()]     # the workload's distinct texts
    # analysis is driver work (no data read): run it on a few threads
    with quiet_log(spark), ThreadPoolExecutor(max_workers=analyze_threads) as pool:
        names = list(pool.map(lambda x: result_columns(spark, x[1]), listed))
    status = [(tid, sql, n is not None) for (tid, sql), n in zip(listed, names)]
    good = [(tid, sqlite_dialect(sql), n) for (tid, sql), n in zip(listed, names) if n is not None]
    out = f"{checkpoint_dir(spark).rstrip('/')}/exec-{uuid.uuid4().hex}"
    schema = "text_id long, row string"

    def run_batch(k: int) -> None:
        chunk = good[k:k + batch]
        sql = " UNION ALL ".join(
            f"SELECT CAST({tid} AS BIGINT) AS text_id, {_row_expr(n)} AS row "
            f"FROM ({q}) q{i}({', '.join(f'c{j}' for j in range(len(n)))})"
            for i, (tid, q, n) in enumerate(chunk))
        spark.sql(sql).write.mode("append").parquet(f"{out}/b={k // batch}")

    # a few batch jobs in flight at once keep the executors busy between the
    # (driver-side) planning of consecutive batches
    with ThreadPoolExecutor(max_workers=concurrent_jobs) as pool:
        list(pool.map(run_batch, range(0, len(good), batch)))
    rows = spark.read.schema(schema).parquet(out) if good else spark.createDataFrame([], schema)
    st = spark.createDataFrame(status, "text_id long, sql string, ok boolean")
    return st, rows


def bag_match(pairs: DataFrame, status: DataFrame, rows: DataFrame) -> DataFrame:
    """Per pair, 1 when the predicted text ran and its result bag equals the gold's.

    ``pairs``: (pair_id, gold, pred). Distinct (gold, pred) text pairs are
    compared once with a full outer join of row counts, then joined back.
    """
    p = pairs.select("pair_id", F.xxhash64("gold").alias("g_id"), F.xxhash64("pred").alias("p_id"))
    tp = p.select("g_id", "p_id").distinct()
    bag = rows.groupBy("text_id", "row").agg(F.count("*").alias("n"))
    g = tp.join(bag.withColumnRenamed("text_id", "g_id").withColumnRenamed("n", "ng"), "g_id")
    q = tp.join(bag.withColumnRenamed("text_id", "p_id").withColumnRenamed("n", "np"), "p_id")
    diff = (g.join(q, ["g_id", "p_id", "row"], "full")
             .filter(F.coalesce("ng", F.lit(0)) != F.coalesce("np", F.lit(0)))
             .select("g_id", "p_id").distinct().withColumn("differs", F.lit(True)))
    okp = status.select(F.col("text_id").alias("p_id"), F.col("ok").alias("p_ok"))
    okg = status.select(F.col("text_id").alias("g_id"), F.col("ok").alias("g_ok"))
    res = (tp.join(diff, ["g_id", "p_id"], "left").join(okp, "p_id", "left").join(okg, "g_id", "left")
             .withColumn("exec_match", (F.coalesce("p_ok", F.lit(False)) & F.coalesce("g_ok", F.lit(False))
                                        & ~F.coalesce("differs", F.lit(False))).cast("int")))
    return p.join(res.select("g_id", "p_id", "exec_match"), ["g_id", "p_id"]).select("pair_id", "exec_match")


def multi_instance_match(spark: SparkSession, pairs: DataFrame, instances: list, register) -> DataFrame:
    """The pair must match on every database instance (``register(sf_dir)``
    points the views at one instance)."""
    out = None
    for inst in instances:
        register(inst)
        st, rows = run_texts(spark, pairs.select(F.col("gold").alias("sql")).unionByName(pairs.select(F.col("pred").alias("sql"))))
        m = bag_match(pairs, st, rows).withColumnRenamed("exec_match", "m")
        out = m if out is None else out.join(m, "pair_id").select("pair_id", F.least("exec_match", "m").alias("exec_match"))
        if "exec_match" not in out.columns:
            out = out.withColumnRenamed("m", "exec_match")
    return out
