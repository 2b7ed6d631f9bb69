"""Intermediate tables in the folder that all executors share.

A written table cuts lineage and survives the loss of executors, which a local
checkpoint does not.  The folder comes from ``spark.checkpoint.dir``; only a
local master without that setting gets one of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables of this application."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        base = getattr(context, "_upslope_scratch", None)
    if not base:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='upslope-')}"
        context._upslope_scratch = base
    return f"{base.rstrip('/')}/upslope-{context.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other call returns."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder below the shared one."""
    if "/upslope-" not in path:
        raise ValueError(f"not an intermediate path: {path}")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_tables(*tables: DataFrame) -> None:
    """Remove materialized tables that no later step reads."""
    for table in tables:
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            drop_path(table.sparkSession, folder)
