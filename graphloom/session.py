"""Session construction and the shared folder for checkpoints."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "graphloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans here are written for.

    Nothing is forced on a cluster: values already in ``spark-defaults`` or passed in ``conf`` win.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``. Where it is unset, a folder of this process on a
    local master, which ends with it; on a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that every executor can reach")
        path = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        folder = "file://" + path
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with a reliable checkpoint, so that a lost executor costs no recomputation. Sessions of
    ``build_session`` delete its files when nothing refers to it any more."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def task_count(spark: SparkSession) -> int:
    """Partitions for stages whose cost is in Python and not in bytes: adaptive coalescing, which goes by
    bytes, would leave such a stage to a few tasks. A repartition by number is not coalesced."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package where the session's own path does not lead to it. On a cluster the
    path has to be shared, or the package given with ``--py-files``."""
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        context.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
