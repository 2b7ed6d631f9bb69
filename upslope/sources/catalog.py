"""Layers of Parquet tables: read-only access, checked publication and the reader's API."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from upslope.operators.checks import gate, parity


class Catalog:
    """Tables ``layer.name`` below a root folder, each a Parquet folder that is replaced as a whole."""

    def __init__(self, spark: SparkSession, root: str, layers: tuple[str, ...] | None = None, resources: dict[str, tuple[str, str]] | None = None):
        """With ``layers`` only those exist for readers; ``resources`` names the table that stands for a former file."""
        self.spark, self.root, self.layers, self.resources = spark, root.rstrip("/"), layers, resources or {}

    def path(self, layer: str, name: str) -> str:
        return f"{self.root}/{layer}/{name}"

    def read(self, layer: str, name: str, **filters) -> DataFrame:
        """A table, filtered by equality; partition columns prune folders, others reach the scan."""
        if self.layers is not None and layer not in self.layers:
            raise ValueError(f"unsupported layer: {layer}")
        df = self.spark.read.parquet(self.path(layer, name))
        for c, v in filters.items():
            df = df.where(F.col(c).isNull() if v is None else F.col(c) == v)
        return df

    def read_resource(self, path: str, **filters) -> DataFrame:
        """The table that stands for a former file, whose path may be written with ./ or doubled slashes."""
        key = posixpath.normpath(path)
        if key not in self.resources:
            raise KeyError(f"no table stands for {key}")
        return self.read(*self.resources[key], **filters)

    def time_values(self, layer: str, name: str, columns: list[str], **filters) -> DataFrame:
        """The distinct values of a table's time columns, in order, nulls first."""
        return self.read(layer, name, **filters).select(*columns).distinct().orderBy(*(F.col(c).asc_nulls_first() for c in columns))

    def attach(self, layer: str, names: list[str]) -> None:
        """Temporary views of a layer's tables."""
        for n in names:
            self.read(layer, n).createOrReplaceTempView(n)

    def publish(self, layer: str, name: str, df: DataFrame, checks: DataFrame | Callable[[DataFrame], DataFrame] | None = None, partition_by: list[str] | None = None) -> DataFrame:
        """Write to a staging folder of its own, check what was written, then put it in the table's place.

        ``checks`` is a table of checks, or makes one of the written table.  The old table is moved aside and removed only when the new one is in place; after a failed
        check or rename the old table is as it was.
        """
        staging, aside = (self.path("_staging", f"{layer}-{name}-{kind}-{uuid.uuid4().hex}") for kind in ("new", "old"))
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        source, target, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (staging, self.path(layer, name), aside))
        fs = target.getFileSystem(conf)
        try:
            df.write.partitionBy(*(partition_by or [])).parquet(staging)
            written = self.spark.read.parquet(staging)
            if written.columns and set(written.columns) != set(df.columns):
                raise ValueError(f"{layer}.{name} lost columns")
            if checks is not None:
                gate(checks if isinstance(checks, DataFrame) else checks(written))
            fs.mkdirs(target.getParent())
            had = fs.exists(target)
            if had and not fs.rename(target, old):
                raise OSError(f"could not move {layer}.{name} aside")
            if not fs.rename(source, target):
                if had:
                    fs.rename(old, target)
                raise OSError(f"could not publish {layer}.{name}")
        finally:
            fs.delete(source, True)
        fs.delete(old, True)
        return self.read(layer, name)

    def append(self, layer: str, name: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path(layer, name))

    def registry(self, tables: list[tuple[str, str]]) -> DataFrame:
        """(layer, table, rows, columns) of the listed tables; counts come from Parquet footers."""
        out = None
        for layer, name in tables:
            df = self.read(layer, name)
            row = df.agg(F.lit(layer).alias("layer"), F.lit(name).alias("table"), F.count("*").alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"))
            out = row if out is None else out.unionByName(row)
        return out

    def alias(self, names: dict[str, tuple[str, str]]) -> None:
        """Views of this session by other names: name -> (layer, table)."""
        for name, (layer, table) in names.items():
            self.read(layer, table).createOrReplaceTempView(name)

    def describe(self, tables: list[tuple[str, str]]) -> DataFrame:
        """(layer, table, position, column, type) of the listed tables."""
        rows = [(layer, name, i, f.name, f.dataType.simpleString()) for layer, name in tables for i, f in enumerate(self.read(layer, name).schema.fields)]
        return self.spark.createDataFrame(rows, "layer string, table string, position int, column string, type string")

    def manifest(self, layer: str, name: str) -> DataFrame:
        """(file, bytes, sha256) of a table's files, hashed where they lie."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(self.path(layer, name))
        return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))

    def verify_copy(self, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
        return parity(self.read(*a), self.read(*b))


def metadata(spark: SparkSession, pairs: dict[str, object]) -> DataFrame:
    """Key/value description of a dataset."""
    return spark.createDataFrame([(k, str(v)) for k, v in pairs.items()], "key string, value string")


def first_column(df: DataFrame, candidates: list[str]) -> str:
    """The first of the candidate columns that the table has."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of {candidates} in {df.columns}")


def official_view(df: DataFrame, model_col: str, primary: str) -> DataFrame:
    """Rows of the primary model, without the model column."""
    return df.where(F.col(model_col) == primary).drop(model_col)


def latest_summary(df: DataFrame, keys: list[str], time: list[str]) -> DataFrame:
    """The latest row of each key."""
    w = W.partitionBy(*keys).orderBy(*(F.col(t).desc() for t in time))
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def program_index(df: DataFrame, key: str, labels: list[str], counted: list[str], time: str) -> DataFrame:
    """A row per key: its smallest labels, its rows, the distinct values of the counted columns and its first and last time."""
    rest = [F.min(c).alias(c) for c in labels] + [F.count("*").alias("profile_row_count")]
    rest += [F.size(F.collect_set(c)).cast("long").alias(f"{c}_count") for c in counted]
    return df.groupBy(key).agg(*rest, F.min(time).alias(f"first_{time}"), F.max(time).alias(f"latest_{time}"))


def metric_pivot(df: DataFrame, metric: str, columns: str, values: list, amount: str) -> DataFrame:
    """Metrics by the listed values of a column."""
    return df.groupBy(metric).pivot(columns, values).agg(F.max(amount))


def enrich_with_lists(df: DataFrame, meta: DataFrame, key: str, list_col: str, name: str) -> DataFrame:
    """``df`` with the distinct values of a metadata column per key, joined by a bar."""
    lists = meta.groupBy(F.col(key).alias("__k")).agg(F.expr(f"listagg(DISTINCT {list_col}, '|') WITHIN GROUP (ORDER BY {list_col})").alias(name))
    return df.join(lists, F.col(key) == F.col("__k"), "left").drop("__k")
