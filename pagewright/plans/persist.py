"""Cutting a plan at a result that several branches use, and folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str = "") -> str:
    """A folder, not yet there, below the one the cluster names in spark.checkpoint.dir; it goes when the application ends.

    Where none is named, a temporary one will do on a local master, as in tests; on a cluster that is an error, as executors
    would write to disks of their own.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="pagewright-")
        context.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/pagewright-{name}{uuid.uuid4().hex}"
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(context._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)  # only what is there can be marked
    return f"{folder}/data"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written as a table in a shared folder, so that losing an executor costs a reread, not a repeat.

    A checkpoint would do too, but runs the plan twice: once for the job, once for the copy.
    """
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
