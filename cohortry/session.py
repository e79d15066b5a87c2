"""Session helpers: nothing here sets up a cluster, it only fills in what a caller left unset."""

from __future__ import annotations

import re
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "cohortry", cpus: int | str = "*", shuffle: int = 8) -> SparkSession:
    """Session for tests and the local benchmark; on a cluster the caller brings their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names. Only a local session without one gets a folder of its own; elsewhere executors would not see it."""
    sc = spark.sparkContext
    if current := sc.getCheckpointDir():
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the reliable checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


_SHARED: list[DataFrame] = []


def shared(df: DataFrame) -> DataFrame:
    """Mark an intermediate table that several branches of one plan read: persisted (spilling to disk), recomputed from
    lineage if an executor is lost, and freed by `release`."""
    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    _SHARED.append(out)
    return out


def release() -> int:
    """Unpersist everything `shared` handed out since the last call."""
    n = len(_SHARED)
    while _SHARED:
        _SHARED.pop().unpersist()
    return n


def bucket_count(spark: SparkSession) -> int:
    """Power of two at or above the shuffle width: how many ordered slices a long ordering is split into."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    n = 2
    while n < width:
        n *= 2
    return n
