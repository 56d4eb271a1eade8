"""Session settings and lineage cuts."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: A group with more rows than this is never handled by one task (see operators/skew.py).
MAX_GROUP_ROWS = "spark.faultline.maxGroupRows"
DEFAULT_MAX_GROUP_ROWS = 4_000_000


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster the submitter's session is used."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("faultline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def max_group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(MAX_GROUP_ROWS, str(DEFAULT_MAX_GROUP_ROWS)))


def _shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. A scratch folder of this machine only where
    driver and executors are one process; anywhere else executors would not see it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {context.master} share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for intermediate files in the shared folder."""
    return f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table written to the shared folder, so that a result read by
    several downstream plans is computed once, survives the loss of executors, is read by
    column and gives the planner its true size. ``discard`` deletes it when its last reader is done."""
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    step = df.sparkSession.read.schema(df.schema).parquet(path)
    step.step_path = path
    return step


def discard(*steps: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing reads any more."""
    for step in steps:
        jvm = step.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(step.step_path)
        path.getFileSystem(step.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy row work (text parsing) to all cores when the input comes in fewer
    pieces than there are cores, as one small file does. Large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/{root.name}", "zip", root.parent, root.name)
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
