"""Resumable batch work and rewrites of whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upslope.scratch import drop_path, new_path
from upslope.sources.catalog import Catalog


def pending(source: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key is not among the processed ones; null keys are never processed."""
    rest = source.where(F.col(key).isNotNull())
    return rest if done is None else rest.join(done.select(key).distinct(), key, "left_anti")


def process_in_chunks(catalog: Catalog, layer: str, name: str, source: DataFrame, key: str, parse: Callable[[DataFrame], DataFrame], chunks: int = 10) -> int:
    """Parse and append what is pending, one hash range of keys at a time; returns the chunks written.

    The source is compared with what is done and cut into its chunks once.  A chunk is one commit, so
    an interrupted run repeats at most one chunk and rows already there are not parsed again.
    """
    spark = source.sparkSession
    try:
        done = catalog.read(layer, name)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        done = None
    path = new_path(spark, "chunks")
    rest = pending(source, done, key).select(*source.columns, F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int").alias("__chunk"))
    rest.write.partitionBy("__chunk").parquet(path)
    staged = spark.read.schema(rest.schema).parquet(path)
    numbers = sorted(r[0] for r in staged.select("__chunk").distinct().collect())
    for i in numbers:
        catalog.append(layer, name, parse(staged.where(F.col("__chunk") == i).drop("__chunk")))
    drop_path(spark, path)
    return len(numbers)


def rewrite(catalog: Catalog, layer: str, name: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """UPDATE and DELETE on a small table: read, change, write beside it, rename."""
    return catalog.publish(layer, name, change(catalog.read(layer, name)))
