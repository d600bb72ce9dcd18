"""Session settings shared by tests, the benchmark and the driver entry."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Rows of one window group that a single task may sort before the range-sliced
# path of operators.running takes over.  Overridable per session.
GROUP_ROWS_KEY = "spark.verdikt.window.maxGroupRows"
GROUP_ROWS_DEFAULT = 2_000_000


def build_session(app: str = "verdikt", cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use your own."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Operators with Python functions need it wherever the package is not
    installed on the executors, whatever folder the driver was started in.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="verdikt-package-"), root.name)
    context.addPyFile(shutil.make_archive(target, "zip", root_dir=root.parent, base_dir=root.name))
    _SHIPPED.add(context.applicationId)


def max_group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(GROUP_ROWS_KEY, str(GROUP_ROWS_DEFAULT)))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts lineage and pins the partition layout.

    The folder comes from ``spark.checkpoint.dir``.  Only a local master may
    fall back to a temporary folder, because executors elsewhere cannot see it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="verdikt-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
