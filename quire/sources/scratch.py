"""Intermediate results in the shared folder named by spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="quire-")
    spark.sparkContext.setCheckpointDir(root)
    return root


_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder path below the application's folder in the scratch root.

    That folder goes when the driver's JVM ends; one that is killed leaves it behind.
    """
    root, application = scratch_root(spark), spark.sparkContext.applicationId
    own = f"{root}/quire-{application}"
    if _OWN.get(application) != own:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _OWN[application] = own
    return f"{own}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are on shared storage and survive executors."""
    root = scratch_root(df.sparkSession)
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return df.checkpoint(eager=True)
