"""Hard checks, constraints, parity and profiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Constraint:
    """``violated`` counts the rows that break it."""

    name: str
    violated: Column


def not_null(c: str) -> Constraint:
    return Constraint(f"{c} is not null", F.col(c).isNull())


def in_range(c: str, low: float, high: float) -> Constraint:
    return Constraint(f"{c} in [{low}, {high}]", ~F.col(c).between(low, high))


def check_constraints(df: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """One row per constraint (check_name, status, observed, expected), all from one pass."""
    counts = df.agg(*(F.coalesce(F.sum(c.violated.cast("long")), F.lit(0)).alias(f"v{i}") for i, c in enumerate(constraints)))
    rows = F.array(*(F.struct(F.lit(c.name).alias("check_name"), F.col(f"v{i}").alias("observed")) for i, c in enumerate(constraints)))
    out = counts.select(F.explode(rows).alias("r")).select("r.*")
    return out.select("check_name", F.when(F.col("observed") == 0, "PASS").otherwise("FAIL").alias("status"), "observed", F.lit(0).cast("long").alias("expected"))


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Rows whose key the parent lacks."""
    return child.join(parent.select(F.col(pk).alias("__pk")), F.col(fk) == F.col("__pk"), "left_anti")


def gate(checks: DataFrame) -> None:
    """Raise if any check fails; the failed ones are few and named in the error."""
    failed = [r.check_name for r in checks.where("status <> 'PASS'").limit(50).collect()]
    if failed:
        raise ValueError(f"failed checks: {', '.join(failed)}")


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset comparison as one row: counts and rows missing on either side."""
    columns = a.columns
    x = a.select(columns).groupBy(*columns).agg(F.count("*").alias("__a"), F.lit(0).cast("long").alias("__b"))
    y = b.select(columns).groupBy(*columns).agg(F.lit(0).cast("long").alias("__a"), F.count("*").alias("__b"))
    both = x.unionByName(y).groupBy(*columns).agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b"))
    zero = F.lit(0)
    out = both.agg(
        F.coalesce(F.sum("__a"), zero).cast("long").alias("rows_a"), F.coalesce(F.sum("__b"), zero).cast("long").alias("rows_b"),
        F.coalesce(F.sum(F.greatest(F.col("__a") - F.col("__b"), zero)), zero).cast("long").alias("only_a"), F.coalesce(F.sum(F.greatest(F.col("__b") - F.col("__a"), zero)), zero).cast("long").alias("only_b"),
    )
    return out.withColumn("status", F.when((F.col("only_a") == 0) & (F.col("only_b") == 0), "PASS").otherwise("FAIL"))


def field_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: rows, nulls, blanks, distinct values, lengths and share of each format class; one pass over the data."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("v")) for c in columns))).alias("x")).select("x.*")
    v = F.col("v")
    form = format_class(v)
    return long.groupBy("field").agg(
        F.count("*").alias("rows"), F.sum(v.isNull().cast("long")).alias("nulls"), F.sum(F.coalesce((F.trim(v) == "").cast("long"), F.lit(0))).alias("blanks"), F.count_distinct(v).alias("distinct_values"),
        F.min(F.length(v)).cast("long").alias("min_length"), F.max(F.length(v)).cast("long").alias("max_length"), *(F.sum((form == k).cast("long")).alias(f"n_{k}") for k in ("integer", "decimal", "date", "text")),
    )


def format_class(v: Column) -> Column:
    return F.when(v.isNull() | (F.trim(v) == ""), "blank").when(v.rlike(r"^[+-]?[0-9]+$"), "integer").when(v.rlike(r"^[+-]?[0-9]*\.[0-9]+$"), "decimal").when(v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), "date").otherwise("text")


def top_examples(df: DataFrame, column: str, k: int = 3) -> DataFrame:
    """The ``k`` commonest values of each format class."""
    counts = df.select(F.col(column).cast("string").alias("value")).groupBy("value").agg(F.count("*").alias("n")).withColumn("format", format_class(F.col("value")))
    r = F.row_number().over(W.partitionBy("format").orderBy(F.desc("n"), F.col("value").asc_nulls_last()))
    return counts.withColumn("position", r.cast("long")).where(F.col("position") <= k)
