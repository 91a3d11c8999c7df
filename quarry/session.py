"""Spark session settings shared by the library, tests and bench.

On a cluster the session is created by the platform; ``configure`` only sets
what is unset, and ``checkpoint_dir`` reads ``spark.checkpoint.dir`` from the
session (a shared folder) and only falls back to a scratch folder when the
setting is absent, as in local tests.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: ANSI semantics are Spark 4's default, the
# session zone is pinned so timestamps compare equal with DuckDB, AQE re-plans
# joins and splits skewed partitions at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Broadcast only below a checked size; the library never forces a
    # broadcast of a side whose size grows with the data.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def build(master: str | None = None, shuffle_partitions: int | None = None,
          app: str = "quarry") -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    b = b.config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "8g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply DEFAULTS to an existing session without overriding cluster settings,
    and send the package to the executors' Python workers."""
    for k, v in DEFAULTS.items():
        if spark.conf.get(k, None) in (None, ""):
            spark.conf.set(k, v)
    _ship_package(spark)
    return spark


def _ship_package(spark: SparkSession) -> None:
    """Functions of this package are pickled by module name, so the workers must
    be able to import it wherever the driver was started. Once per context;
    in local mode the workers inherit the driver's import path through it too."""
    sc = spark.sparkContext
    if getattr(sc, "_quarry_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="quarry-py-"), "quarry_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(here)))
    sc.addPyFile(archive)
    sc._quarry_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the context's, else the one the cluster
    names in ``spark.checkpoint.dir``, else (local tests only) a scratch folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="quarry-ckpt-")   # one machine: tests and local runs
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
