"""Stage boundaries: a DataFrame that several later steps read is written once, so plans don't multiply."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder spark.checkpoint.dir, which the driver and the executors share. Only where that is unset, as in local sessions,
    a temporary folder of this machine."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = context.getConf().get("spark.checkpoint.dir")
        if not found:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
            own = tempfile.TemporaryDirectory(prefix="helixmill-stages-")
            atexit.register(own.cleanup)
            found = f"file://{own.name}"
        context.setCheckpointDir(found)
    return context.getCheckpointDir()


def held(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the shared folder; its plan is the read of those files."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
