"""Shared plumbing: the shared work folder, intermediate tables, shipping this package to executors."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Rows and bytes of one Arrow batch, so that a batch of long texts stays small whatever the row count.
BATCH_ROWS, BATCH_BYTES = 2000, 32 << 20
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or, where that is unset
    (local sessions, tests), a temporary folder of this machine that is removed at exit."""
    found = spark.sparkContext.getConf().get(CHECKPOINT_DIR) or spark.conf.get(CHECKPOINT_DIR, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that the executors share")
        own = tempfile.TemporaryDirectory(prefix="helixmill-")
        atexit.register(own.cleanup)
        found = f"file://{own.name}"
        spark.conf.set(CHECKPOINT_DIR, found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/helixmill/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and survives the loss of executors. It goes when the driver's JVM
    ends, if forget() doesn't come first."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    passing(df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._helixmill_path = path
    return out


def passing(spark: SparkSession, path: str) -> None:
    """Have the file or folder deleted when the driver's JVM ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def forget(*tables: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._helixmill_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def prepare(spark: SparkSession) -> None:
    """Send this package to the executors once, and bound the Arrow batches of the session."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        folder = tempfile.mkdtemp(prefix="helixmill-ship-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        target = os.path.join(folder, "helixmill.zip")
        with zipfile.ZipFile(target, "w") as z:
            for place, _, names in sorted(os.walk(os.path.join(root, "helixmill"))):
                for f in sorted(names):
                    if f.endswith(".py"):
                        whole = os.path.join(place, f)
                        z.write(whole, os.path.relpath(whole, root))
        spark.sparkContext.addPyFile(target)
        _shipped.add(app)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def trim() -> None:
    """Give freed memory back to the system. A worker is used again by later stages, and what its allocators keep for themselves
    would add up with theirs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def trimmed(batches: Iterable) -> Iterator:
    """The same items; memory is given back after the last one."""
    try:
        yield from batches
    finally:
        trim()


def own_names(docs: DataFrame, *keep: str) -> DataFrame:
    """docs with all columns but `keep` named by their place, so that none clashes with a name that an operator adds."""
    return docs.toDF(*(c if c in keep else f"__c{i}" for i, c in enumerate(docs.columns)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
