"""Where jobs cut lineage: the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: For one machine only (tests): on a cluster the setting must be there.
_LOCAL_DEFAULT = "/tmp/checkpoints/outlay"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, read from the session; one of our own only where it is unset and Spark is one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = _LOCAL_DEFAULT
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def drop_dir(spark: SparkSession, path: str) -> None:
    """Deletes a folder that fresh_dir named."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor, is dropped when unreferenced."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def slots(spark: SparkSession) -> int:
    """How many partitions a shuffle of this session makes."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
