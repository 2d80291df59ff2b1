"""Staged tables in the folder that a cluster shares: they cut lineage and outlive lost executors."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a new one in local mode, an error on a cluster: executors
    wouldn't see each other's folders there."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that driver and executors share (master is {master!r})")
        folder = tempfile.mkdtemp(prefix="termloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _on(spark: SparkSession, folder: str):
    """A folder as Hadoop's path, and the file system it is in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def passing(spark: SparkSession, folder: str) -> None:
    """Have an existing folder deleted when the driver's JVM ends."""
    path, store = _on(spark, folder)
    store.deleteOnExit(path)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back. The files go with unstage(), or else when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    passing(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*tables: DataFrame) -> None:
    """Delete what staged() wrote, through Hadoop's file system, once nothing reads it any more, and release()."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path, store = _on(df.sparkSession, folder)
            store.delete(path, True)
    for df in tables[:1]:
        release(df.sparkSession)


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage and give freed memory back to the system.

    Spark deletes the shuffle files and broadcasts of finished steps only when their plans are collected. Python, Arrow and the JVM keep
    what was freed, so without this each holds on to the most that any step took.
    """
    gc.collect()
    spark._jvm.System.gc()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)
    _trim_jvm(spark)


def _trim_jvm(spark: SparkSession) -> None:
    """Have the JVM give back what it freed outside its heap (the compiler's working memory, buffers), where it has a command for that:
    with glibc, from Java 17.0.9 on. By reflection, as Py4J can't call the server's own class, which isn't exported."""
    java = spark._jvm.java.lang
    server, name = java.management.ManagementFactory.getPlatformMBeanServer(), spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    calls = {(m.getName(), m.getParameterCount()): m for m in java.Class.forName("javax.management.MBeanServer").getMethods()}

    def call(method: str, *args):
        given = spark.sparkContext._gateway.new_array(java.Object, len(args))
        for k, x in enumerate(args):
            given[k] = x
        return calls[method, len(args)].invoke(server, given)

    if call("isRegistered", name) and "systemTrimNativeHeap" in {x.getName() for x in call("getMBeanInfo", name).getOperations()}:
        call("invoke", name, "systemTrimNativeHeap", None, None)
