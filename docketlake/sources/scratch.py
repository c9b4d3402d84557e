"""Tables written to the folder that the cluster shares, to cut lineage between rounds."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or that set on the context; in local mode alone a temporary one, gone at exit."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="docketlake-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return "file://" + _LOCAL[0]


def written(df: DataFrame) -> DataFrame:
    """The same rows, read from a table."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._written = path
    return found


def drop(*tables: DataFrame) -> None:
    """Deletes tables of written() that no later job reads, and lets the driver's JVM notice shuffles that nothing refers to."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._written)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
        _WRITTEN.remove(table._written)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def drop_written(spark: SparkSession) -> None:
    """Deletes the tables of written(), once no result over them is asked for any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)
