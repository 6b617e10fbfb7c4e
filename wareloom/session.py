"""Session defaults and checkpoint-folder lookup."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Plans hold thousands of expressions; noting the Python line of each costs as much as building it.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Pages travel to Python whole, so batches are kept short.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "wareloom") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


class NoSharedFolder(RuntimeError):
    """A cluster session names no folder that all executors share."""


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A local session (tests, benchmarks) that names none gets a temporary folder, removed when the process ends; on a cluster a folder
    of one machine would lose data, so a session without the setting is refused.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="wareloom-ckpt-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def stored_once(df: DataFrame) -> DataFrame:
    """A small table that several joins read, computed once and kept in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder of written data that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def data_folder(spark: SparkSession, name: str) -> str:
    """A named sub-folder of the shared checkpoint folder, for written intermediate tables."""
    return os.path.join(checkpoint_folder(spark), name)
