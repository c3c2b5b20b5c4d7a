"""Session defaults, durable intermediate tables and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Options of a session started by this package. A session handed in by the
# caller (a cluster job, the driver) keeps its own settings.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join also where that costs one more shuffle behind it.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoints go once nothing refers to them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Do not record the Python call site of every column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(name: str = "aislecast", **options: str) -> SparkSession:
    """Return the running session, or start one with the defaults above."""
    builder = SparkSession.builder.appName(name)
    for key, value in {**DEFAULTS, **options}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def importable_by_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from the folder that the driver has it in.

    On a cluster the package is installed, or shipped with ``--py-files``; there
    the folder is only one more place to look.
    """
    root = str(Path(__file__).resolve().parents[1])
    places = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in places:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, places)])


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach, taken from ``spark.checkpoint.dir``.

    A temporary folder of this machine is used only for a local master, where
    the driver and the executors are one process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="aislecast-"))
    return context.getCheckpointDir()


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, deleted when the application ends."""
    return kept_until_exit(spark, f"{shared_folder(spark).rstrip('/')}/aislecast/{label}-{uuid.uuid4().hex}")


def kept_until_exit(spark: SparkSession, path: str) -> str:
    """Have ``path`` deleted when the application ends; the path itself is returned."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def path_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it does not exist."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(jvm_path)] if files.exists(jvm_path) else []


def create_file(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False if there is one of that name already."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).createNewFile(jvm_path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a work folder whose content no frame needs any more."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def written(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as parquet below the shared folder and read it back.

    The lineage ends at the files, which every executor reaches, so a lost
    executor costs no recomputation. They go when the application ends.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    schema = df.schema
    df.write.parquet(path, partitionBy=list(partition_by) or None)
    return spark.read.schema(schema).parquet(path)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """Keep ``df`` in executor memory (spilling to disk) inside the block."""
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()
