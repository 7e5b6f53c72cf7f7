"""Reading tables and cutting lineage."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by spark.checkpoint.dir; make one of our own only in a local session that names none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
        return
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(os.path.join(tempfile.gettempdir(), "leafmill-checkpoints"))


def bounded_batches(spark: SparkSession) -> None:
    """Hand texts to Python workers in batches of about 4 MB, unless the session names a size.

    Spark's default follows the number of rows, so long texts would take hundreds of MB in each worker and, beside the
    heap, in each executor.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, "4m")


def free(spark: SparkSession) -> None:
    """Have the driver collect its garbage now; shuffle files and broadcasts that no frame refers to go with it.

    Where many plans follow each other quickly, its heap would rather grow than be collected.  What the JVM freed
    outside its heap goes back to the system as well, as the C library would keep it, in arenas of many threads.
    """
    gc.collect()
    spark._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> bool:
    """Have the driver's C library give back the memory that the JVM freed outside its heap; false where it cannot."""
    java, array = spark._jvm, spark.sparkContext._gateway.new_array
    server = java.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    args = array(java.Object, 4)  # of MBeanServer.invoke; the server's own class is not open to Py4J
    args[0], args[1] = java.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    invoke = next(m for m in java.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    try:
        invoke.invoke(server, args)
    except Py4JError:
        return False
    return True


def cut(frame: DataFrame) -> DataFrame:
    """Write a frame to the shared checkpoint folder and read it from there."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


class Scratch:
    """Tables in a folder of their own below the shared checkpoint folder.

    ``keep`` writes a frame and reads it from there, which cuts its lineage; tables that a later one supersedes are
    deleted at once, what is left when the session ends.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.root = f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []
        self.written = 0
        fs, path = self._at(self.root)
        fs.deleteOnExit(path)

    def _at(self, name: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def keep(self, frame: DataFrame, *superseded: DataFrame | None) -> DataFrame:
        """``frame`` as a written table; the tables it supersedes go."""
        self.written += 1
        name = f"{self.root}/{self.written}"
        frame.write.option("compression", "snappy").parquet(name)
        out = self.spark.read.schema(frame.schema).parquet(name)
        self.drop(*superseded)
        self.tables.append((out, name))
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that ``keep`` returned; anything else is left alone."""
        for out, name in [x for x in self.tables if any(x[0] is t for t in tables)]:
            fs, path = self._at(name)
            fs.delete(path, True)
            self.tables = [x for x in self.tables if x[0] is not out]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def spread(frame: DataFrame, *keys: str) -> DataFrame:
    """Even out rows over tasks by a hash of ``keys``, keeping the session's number of shuffle partitions."""
    return frame.repartition(*[F.col(k) for k in keys])
