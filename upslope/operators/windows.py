"""Window-based building blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top1(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return top_k(df, keys, order, 1)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key in a total order."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


def distinct_over(x: Column | str, keys: list[str]) -> Column:
    """Number of distinct non-null values of a partition on every row; for sets that fit in a row."""
    return F.size(F.collect_set(x).over(W.partitionBy(*keys))).cast("long")


def transitions(df: DataFrame, keys: list[str], order: list[str], value: str, time: str) -> DataFrame:
    """Each row with its successor in its key: change of value, elapsed time and change per unit of time."""
    w = W.partitionBy(*keys).orderBy(*order)
    nxt = df.withColumn("next_value", F.lead(value).over(w)).withColumn("next_time", F.lead(time).over(w))
    nxt = nxt.where(F.col("next_time").isNotNull())
    elapsed = F.col("next_time") - F.col(time)
    change = F.col("next_value") - F.col(value)
    return nxt.withColumn("change", change).withColumn("elapsed", elapsed).withColumn("change_per_unit", change / F.nullif(elapsed.cast("double"), F.lit(0.0)))


def islands(df: DataFrame, person: str, order: list[str], state: str) -> DataFrame:
    """Gaps and islands: number of the run of equal states of each person, as ``run`` from 1; nulls equal each other."""
    w = W.partitionBy(person).orderBy(*order)
    first = F.row_number().over(w) == 1
    changed = (first | ~F.col(state).eqNullSafe(F.lag(state).over(w))).cast("long")
    marked = df.withColumn("__changed", changed)
    return marked.withColumn("run", F.sum("__changed").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__changed")


def stints(df: DataFrame, person: str, order: list[str], state: str, at: str) -> DataFrame:
    """One row per run: its length, ends, neighbours, whether it returns to a former state and whether it is a one-row island between equal runs."""
    runs = (
        islands(df, person, order, state)
        .groupBy(person, "run")
        .agg(F.first(state).alias(state), F.count("*").alias("n_rows"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    )
    w = W.partitionBy(person).orderBy("run")
    earlier = F.count("*").over(W.partitionBy(person, state).orderBy("run").rowsBetween(W.unboundedPreceding, -1))
    runs = runs.withColumn("previous", F.lag(state).over(w)).withColumn("following", F.lead(state).over(w))
    runs = runs.withColumn("returns", earlier > 0)
    island = (F.col("n_rows") == 1) & F.col("previous").isNotNull() & (F.col("previous") == F.col("following"))
    return runs.withColumn("one_row_island", F.coalesce(island, F.lit(False)))


def previous_period(df: DataFrame, keys: list[str], period: str, columns: list[str]) -> DataFrame:
    """Values of exactly the period before; null if that period is missing (never the nearest one)."""
    before = df.select(*(F.col(k).alias(f"__{k}") for k in keys), (F.col(period) + 1).alias("__period"), *(F.col(c).alias(f"previous_{c}") for c in columns))
    on = F.col(period) == F.col("__period")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(before, on, "left").drop("__period", *(f"__{k}" for k in keys))


def calendar_window(df: DataFrame, keys: list[str], period: str, width: int, aggregates: list[Column]) -> DataFrame:
    """Aggregates over the ``width`` periods up to each row's own; missing periods stay missing.

    An equi-join on the keys after each history row is dealt to the periods it counts for,
    so no inequality is left to the join.
    """
    history = df.withColumn("__for", F.explode(F.sequence(F.col(period), F.col(period) + width - 1)))
    stats = history.groupBy(*keys, "__for").agg(*aggregates)
    own = df.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(period).alias("__period"))
    on = F.col("__for") == F.col("__period")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return stats.join(own, on, "left_semi").withColumnRenamed("__for", period)


def most_frequent(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent non-null value per key, ties to the smallest, with its count and the number of variants."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.max(F.struct(F.col("n"))).alias("m"), F.count("*").alias("variants"))
    joined = counts.join(best, keys).where(F.col("n") == F.col("m.n"))
    return joined.groupBy(*keys).agg(F.min(value).alias(value), F.max("n").alias("n"), F.max("variants").alias("variants"))
