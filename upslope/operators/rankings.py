"""Specialised rankings and cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cohorts(df: DataFrame, baseline: str, endpoint: str) -> DataFrame:
    """Each row once for every cohort it belongs to."""
    b, e = F.col(baseline), F.col(endpoint)
    of = [(b.isNotNull(), "all"), (b >= 70, "baseline_70"), (b >= 80, "baseline_80"), (e >= 90, "endpoint_90"), (e >= 95, "endpoint_95")]
    return df.withColumn("cohort", F.explode(F.array_compact(F.array(*(F.when(c, n) for c, n in of)))))


def baseline_tier(x: Column) -> Column:
    """Exclusive tiers of the baseline."""
    return F.when(x < 50, "under_50").when(x < 65, "50_65").when(x < 80, "65_80").when(x.isNotNull(), "80_up")


def percentile_of(c: str, scope: list[str], invert: bool = False) -> Column:
    w = W.partitionBy(*scope) if scope else W.partitionBy(F.lit(1))
    p = F.percent_rank().over(w.orderBy(F.col(c).asc_nulls_last()))
    return F.when(F.col(c).isNotNull(), 1 - p if invert else p)


def composite(df: DataFrame, scope: list[str], parts: list[tuple[str, float, bool]], name: str = "score", entity: str = "entity") -> DataFrame:
    """Weighted sum of percentiles; a part is (column, weight, inverted).  Ranked by the rounded score."""
    out = df
    for c, _, inv in parts:
        out = out.withColumn(f"{c}_pct", percentile_of(c, scope, inv))
    total = sum((F.col(f"{c}_pct") * w for c, w, _ in parts[1:]), F.col(f"{parts[0][0]}_pct") * parts[0][1])
    w = W.partitionBy(*scope) if scope else W.partitionBy(F.lit(1))
    return out.withColumn(name, total).withColumn("rank", F.rank().over(w.orderBy(F.round(name, 9).desc_nulls_last())).cast("long"))


def balanced_score(mean: Column, sd: Column, gap: Column, coverage: Column) -> Column:
    """Mean less penalties for spread, for the gap between events and for missing coverage."""
    return mean - 0.20 * F.coalesce(sd, F.lit(0.0)) - 0.10 * F.coalesce(gap, F.lit(0.0)) - 0.05 * (1 - coverage)


def transfers_in(df: DataFrame, person: str, entity: str, time: str, value: str) -> DataFrame:
    """Mean value of persons at an entity that is not their first, by their first time at each."""
    spell = df.groupBy(person, entity).agg(F.min(time).alias("since"), F.avg(value).alias("v"))
    order = F.row_number().over(W.partitionBy(person).orderBy("since", entity))
    moved = spell.withColumn("spell", order).where("spell > 1")
    return moved.groupBy(entity).agg(F.count("*").alias("arrivals"), F.avg("v").alias("mean_value"))
