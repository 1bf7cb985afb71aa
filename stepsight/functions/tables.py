"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

#: Whether what is cached may have fewer partitions than its shuffles, by their size. Off by default: 200 tasks of 200 files each then
#: follow for every exchange of even a small cached table, which costs more than its rows do.
SIZED = "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, from spark.checkpoint.dir. Where it is unset, one of our own, but in local mode only: on a cluster nobody
    else would see it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that name, in whatever store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def kept(df: DataFrame) -> DataFrame:
    """df cached on the executors' disks, in as many partitions as its size asks for."""
    conf = df.sparkSession.conf
    before = conf.get(SIZED, None)
    conf.set(SIZED, "true")
    try:
        return df.persist(StorageLevel.DISK_ONLY)
    finally:
        conf.unset(SIZED) if before is None else conf.set(SIZED, before)
