"""Running totals over ordered groups of rows, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from upslope.scratch import materialize


def global_rank(df: DataFrame, order: list[Column | str], out: str = "rank") -> DataFrame:
    """``df`` with the place of each row, from 1, in the order of ``order`` over the whole table.

    Rows are cut into ranges and written with the number of their range; a row's place is its place in
    the range plus the sizes of the ranges before, so no task sees more than a range.  Rows that are equal
    in ``order`` get their places in any order, so end it with a unique column.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranked")
    before = prefix_sums(ranged.groupBy("__range").agg(F.count("*").alias("__rows")), [], "__range", "__rows", "__before")
    own = ranged.withColumn("__own", F.row_number().over(W.partitionBy("__range").orderBy(*order)))
    before = before.select(F.col("__range").alias("__at"), "__before")
    return own.join(before, F.col("__range") == F.col("__at")).select(*df.columns, (F.col("__before") + F.col("__own")).cast("long").alias(out))


def ntile_of(rank: Column, total: int, groups: int) -> Column:
    """The group, from 1, of a place among ``total`` rows cut into equal groups, larger ones first."""
    size, extra = divmod(total, groups)
    at, cut = rank - 1, extra * (size + 1)
    late = F.lit(extra) + F.floor((at - cut) / max(size, 1))
    return (F.when(at < cut, F.floor(at / (size + 1))).otherwise(late) + 1).cast("int")


def exact_quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Interpolated quantiles of a column over the whole table, by the places of the rows around each."""
    ranked = global_rank(df.where(F.col(value).isNotNull()).select(value), [F.col(value)])
    n = ranked.count()
    if not n:
        return [None] * len(shares)
    at = [s * (n - 1) for s in shares]
    wanted = sorted({int(a) + 1 for a in at} | {min(int(a) + 2, n) for a in at})
    found = {r["rank"]: r[value] for r in ranked.where(F.col("rank").isin(wanted)).collect()}
    return [found[int(a) + 1] + (found[min(int(a) + 2, n)] - found[int(a) + 1]) * (a - int(a)) for a in at]


def prefix_sums(parts: DataFrame, keys: list[str], order: str, value: str, out: str = "base", chunk: int = 4096) -> DataFrame:
    """``parts`` with the sum of ``value`` over the rows of the same ``keys`` that have a smaller ``order``.

    ``order`` is a whole number, unique within the keys.  Rows are summed by
    chunks of ``chunk`` numbers first; one window runs over the chunks of a key and
    one over the rows of a chunk, so neither sees more than a few thousandths of
    the rows.  Keys may be null; null values count as 0; an empty table stays empty.
    """
    cut = parts.withColumn("__chunk", F.floor(F.col(order) / F.lit(chunk)).cast("long"))
    totals = cut.groupBy(*keys, "__chunk").agg(F.sum(value).alias("__sum"))
    earlier = W.partitionBy(*(keys or [F.lit(0)])).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*(F.col(k).alias(f"__key_{k}") for k in keys), F.col("__chunk").alias("__at"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    within = W.partitionBy(*keys, "__chunk").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    inner = cut.withColumn("__inner", F.coalesce(F.sum(value).over(within), F.lit(0)))
    same = F.col("__chunk") == F.col("__at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    return inner.join(totals, same).select(*parts.columns, (F.col("__before") + F.col("__inner")).alias(out))
