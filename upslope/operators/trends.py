"""Season movement, comparison of season types, windows, classes and peers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from upslope.operators.joins import null_safe_join

from upslope.functions.exprs import rank_strength
from upslope.operators.windows import calendar_window, previous_period


def season_ranks(df: DataFrame, scope: list[str], entity: str, value: str) -> DataFrame:
    """Rank, number ranked and rank strength of each entity within its scope; entities without a value are unranked."""
    w = W.partitionBy(*scope)
    has = F.col(value).isNotNull()
    n = F.count(value).over(w)
    rank = F.when(has, F.rank().over(w.orderBy(F.round(value, 9).desc_nulls_last()))).cast("long")
    return df.withColumn("rank", rank).withColumn("ranked", n).withColumn("strength", F.when(has, rank_strength("rank", "ranked")))


def movement(df: DataFrame, keys: list[str], year: str, value: str, rank: str, eps: float = 1e-9) -> DataFrame:
    """Change against exactly the year before, with a status and the way rank and value moved together."""
    x = previous_period(df, keys, year, [value, rank])
    both = F.col(value).isNotNull() & F.col(f"previous_{value}").isNotNull()
    status = F.when(both, "comparable").when(F.col(value).isNull(), "no_current").when(F.col(f"previous_{rank}").isNull(), "no_previous_season").otherwise("no_previous_value")
    x = x.withColumn("status", status)
    x = x.withColumn("value_change", F.when(both, F.col(value) - F.col(f"previous_{value}"))).withColumn("rank_change", F.when(both, F.col(f"previous_{rank}") - F.col(rank)))

    def sign(c: str, flat: float) -> Column:
        return F.when(F.col(c) > flat, "up").when(F.col(c) < -flat, "down").when(F.col(c).isNotNull(), "flat")

    return x.withColumn("alignment", F.concat(F.lit("rank_"), sign("rank_change", 0), F.lit("_value_"), sign("value_change", eps)))


def season_comparison(df: DataFrame, keys: list[str], season: str, a: str, b: str, value: str) -> DataFrame:
    """Both season types side by side, whichever exists, with a status and the difference."""
    left = df.where(F.col(season) == a).select(*keys, F.col(value).alias("a_value"), F.lit(True).alias("__a"))
    right = df.where(F.col(season) == b).select(*keys, F.col(value).alias("b_value"), F.lit(True).alias("__b"))
    out = left.join(right, keys, "full")
    status = F.when(F.col("__a").isNull(), f"{b}_only").when(F.col("__b").isNull(), f"{a}_only").when(F.col("a_value").isNull() | F.col("b_value").isNull(), "value_missing").otherwise("both")
    return out.withColumn("status", status).withColumn("difference", F.col("b_value") - F.col("a_value")).drop("__a", "__b")


def window_trend(df: DataFrame, keys: list[str], year: str, value: str, width: int, min_years: int = 3) -> DataFrame:
    """Statistics of the last ``width`` calendar years; a slope only from ``min_years`` years with a value."""
    has = F.col(value).isNotNull()
    n = F.count(value)
    aggregates = [
        n.alias("years"),
        F.avg(value).alias("mean"),
        F.median(value).alias("median"),
        F.stddev_samp(value).alias("sd"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.when(n >= min_years, F.regr_slope(F.col(value), F.when(has, F.col(year)))).alias("slope"),
        (n / F.lit(width)).alias("coverage"),
        F.when(n >= min_years, "trend").when(n > 0, "short_history").otherwise("no_history").alias("status"),
    ]
    return calendar_window(df, keys, year, width, aggregates)


def trajectory_classes(df: DataFrame, scope: list[str], level: str, slope: str, sd: str, short_slope: str) -> DataFrame:
    """Percentiles of level, slope and steadiness, the direction and a quarter tier of each."""
    w = W.partitionBy(*scope)

    def pct(c: str, invert: bool = False) -> Column:
        order = F.col(c).desc_nulls_last() if invert else F.col(c).asc_nulls_last()
        return F.when(F.col(c).isNotNull(), F.percent_rank().over(w.orderBy(order)))

    out = df.withColumn("level_pct", pct(level)).withColumn("slope_pct", pct(slope)).withColumn("steady_pct", pct(sd, True))
    a, b = F.col(slope), F.col(short_slope)
    direction = F.when(a.isNull() | b.isNull(), "unknown").when((a > 0) & (b > 0), "rising").when((a < 0) & (b < 0), "falling").when((a < 0) & (b > 0), "recovering").when((a > 0) & (b < 0), "cooling").otherwise("flat")

    def tier(c: str) -> Column:
        return F.when(F.col(c) >= 0.75, "first").when(F.col(c) >= 0.5, "second").when(F.col(c) >= 0.25, "third").when(F.col(c).isNotNull(), "fourth")

    return out.withColumn("direction", direction).withColumn("level_tier", tier("level_pct")).withColumn("slope_tier", tier("slope_pct"))


def peer_context(df: DataFrame, scope: list[str], peer: str, entity: str, value: str) -> DataFrame:
    """Median of all and of the peers, differences to both and dense ranks in both."""
    everyone = df.groupBy(*scope).agg(F.median(value).alias("all_median"))
    peers = df.groupBy(*scope, peer).agg(F.median(value).alias("peer_median"), F.count(value).alias("peers"))
    out = null_safe_join(null_safe_join(df, everyone, scope), peers, [*scope, peer])
    out = out.withColumn("all_difference", F.col(value) - F.col("all_median")).withColumn("peer_difference", F.col(value) - F.col("peer_median"))
    order = F.round(value, 9).desc_nulls_last()
    return out.withColumn("all_rank", F.dense_rank().over(W.partitionBy(*scope).orderBy(order)).cast("long")).withColumn("peer_rank", F.dense_rank().over(W.partitionBy(*scope, peer).orderBy(order)).cast("long"))


def long_metrics(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row per metric."""
    return df.unpivot(keys, metrics, "metric", "metric_value")
