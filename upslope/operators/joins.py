"""Joins in which nulls are keys like any other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``right``, joined on equal keys; null keys are equal to each other."""
    renamed = right.select(*(F.col(c).alias(f"__key_{c}") if c in keys else F.col(c) for c in right.columns))
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(renamed[f"__key_{k}"])
    return left.join(renamed, same, how).drop(*(f"__key_{k}" for k in keys))
