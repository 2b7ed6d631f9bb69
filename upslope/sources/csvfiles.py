"""CSV sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_typed_csv(spark: SparkSession, paths: str | list[str], columns: dict[str, str], strict: bool = True) -> DataFrame:
    """Files with a header under explicit types, each row with the name of its ``source_file``.

    Strict reading fails on a malformed row; otherwise such rows are dropped.
    """
    schema = T.StructType([T.StructField(c, T._parse_datatype_string(t)) for c, t in columns.items()])
    reader = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return reader.csv(paths).select("*", F.col("_metadata.file_path").alias("source_file"))


def read_text_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All columns as text, names from the header."""
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(paths)


def read_inferred_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Types inferred from the data; for small files only, as it reads them twice."""
    return spark.read.option("header", True).option("inferSchema", True).csv(paths)


def write_csv(df: DataFrame, path: str, sep: str = ",", single_file: bool = False, compression: str | None = None) -> None:
    """A folder of CSV files with headers; one file only for small reports."""
    out = df.coalesce(1) if single_file else df
    writer = out.write.mode("overwrite").option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
    (writer.option("compression", compression) if compression else writer).csv(path)


def consolidate(frames: list[DataFrame], key: str, url_prefix: str | None = None) -> DataFrame:
    """Rows of several files with one row per key (the smallest of equal keys), and a profile address for each."""
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f, allowMissingColumns=True)
    rest = [c for c in every.columns if c != key]
    first = every.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*")
    return first.withColumn("profile_url", F.concat(F.lit(url_prefix), F.col(key).cast("string"))) if url_prefix else first
