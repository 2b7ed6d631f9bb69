"""Allocation of equal event budgets and what is built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from upslope.operators.joins import null_safe_join
from upslope.operators.ordering import global_rank, ntile_of
from upslope.scratch import materialize

BUDGET = 100_000.0


def scope_expand(df: DataFrame, year: str, season: str) -> DataFrame:
    """Each row for all time, for its season type over all time and for its single season: (time_scope, scope_year, scope_season)."""
    none_y, none_s = F.lit(None).cast("int"), F.lit(None).cast("string")
    scopes = F.array(
        F.struct(F.lit("all_time").alias("t"), none_y.alias("y"), none_s.alias("s")),
        F.struct(F.lit("all_time_season_type").alias("t"), none_y.alias("y"), F.col(season).alias("s")),
        F.struct(F.lit("single_season").alias("t"), F.col(year).cast("int").alias("y"), F.col(season).alias("s")),
    )
    out = df.withColumn("__scope", F.explode(scopes))
    return out.withColumn("time_scope", F.col("__scope.t")).withColumn("scope_year", F.col("__scope.y")).withColumn("scope_season", F.col("__scope.s")).drop("__scope")


def allocate_budget(df: DataFrame, keys: list[str], signal: str, budget: float = BUDGET) -> DataFrame:
    """Points in proportion to the signal such that the positive ones of each key add up to the budget.

    The input is written once; a key's sum is aggregated and joined back, so a key with most rows is no single task.
    """
    df = materialize(df, "budget")
    pools = df.groupBy(*keys).agg(F.sum(F.greatest(F.col(signal), F.lit(0.0))).alias("__pool"))
    return null_safe_join(df, pools, keys).withColumn("points", F.col(signal) * budget / F.nullif(F.col("__pool"), F.lit(0.0))).drop("__pool")


def bounded_pools(df: DataFrame, keys: list[str], signal: str, support: str, budget: float = BUDGET, cap: float = 1.0, k: Column | None = None) -> DataFrame:
    """Positive budget and a negative pool of at most ``cap`` budgets, after weighting signals by reliability.

    Reliability is sqrt(n / (n + k)), with k the median support of the key unless given.
    """
    df = materialize(df, "pools")
    if k is None:
        df = null_safe_join(df, df.groupBy(*keys).agg(F.greatest(F.lit(1.0), F.median(support)).alias("k")), keys)
    else:
        df = df.withColumn("k", k)
    x = df.withColumn("reliability", F.sqrt(F.col(support) / (F.col(support) + F.col("k")))).withColumn("weighted", F.col(signal) * F.col("reliability"))
    sums = x.groupBy(*keys).agg(F.sum(F.greatest("weighted", F.lit(0.0))).alias("__up"), (-F.sum(F.least("weighted", F.lit(0.0)))).alias("__down"))
    x = null_safe_join(x, sums, keys)
    pool = F.when(F.col("__up") > 0, budget * F.least(F.col("__down") / F.nullif(F.col("__up"), F.lit(0.0)), F.lit(cap)))
    x = x.withColumn("negative_pool", F.coalesce(pool, F.lit(0.0)))
    points = F.when(F.col("weighted") > 0, F.col("weighted") * budget / F.col("__up")).when(F.col("weighted") < 0, F.col("weighted") * F.col("negative_pool") / F.col("__down")).otherwise(0.0)
    return x.withColumn("points", points).drop("__up", "__down")


def group_points(points: DataFrame, group: list[str], entity: str, event: str, value: str = "points") -> DataFrame:
    """Points of each entity in a group of events, divided by the number of the group's events; with ranks."""
    points = materialize(points, "group-points")
    events = points.groupBy(*group).agg(F.count_distinct(event).alias("events"))
    total = points.groupBy(*group, entity).agg(F.sum(value).alias("total"), F.count_distinct(event).alias("scored_events"))
    out = null_safe_join(total, events, group).withColumn("group_points", F.col("total") / F.col("events"))
    return out.withColumn("group_rank", F.rank().over(W.partitionBy(*group).orderBy(F.round("group_points", 6).desc())).cast("long"))


def combine_scopes(grouped: DataFrame, scope: str, group: list[str], entity: str, value: str = "group_points") -> DataFrame:
    """Points of each entity and group over all values of a scope (such as gender), divided by the number of values the group has."""
    grouped = materialize(grouped, "scopes")
    available = grouped.groupBy(*group).agg(F.count_distinct(scope).alias("available"))
    total = grouped.groupBy(*group, entity).agg(F.sum(value).alias("total"))
    return null_safe_join(total, available, group).withColumn(value, F.col("total") / F.nullif(F.col("available"), F.lit(0))).drop("total")


def overall_points(grouped: DataFrame, scope: list[str], group: str, entity: str, value: str = "group_points", budget: float = BUDGET) -> DataFrame:
    """Points of each entity over all groups of a scope, their share of what the groups offer together, and ranks."""
    grouped = materialize(grouped, "overall")
    offered = grouped.groupBy(*scope).agg(F.count_distinct(group).alias("groups"))
    total = grouped.groupBy(*scope, entity).agg(F.sum(value).alias("points"), F.count_distinct(group).alias("held_groups"))
    out = null_safe_join(total, offered, scope).withColumn("share", F.col("points") / (F.col("groups") * budget))
    order = W.partitionBy(*(scope or [F.lit(1)])).orderBy(F.round("points", 6).desc())
    return out.withColumn("overall_rank", F.rank().over(order).cast("long"))


def model_grid(df: DataFrame, keys: list[str], entity: str, signal: str, support: str, ks: tuple[float, ...] = (0, 50, 100, 191, 300, 500), caps: tuple[float, ...] = (0.5, 1.0, 1.5, 1e18)) -> DataFrame:
    """Entity totals under every pair of reliability constant and cap of the negative pool.

    Rows are aggregated once with two sums for each constant; only the aggregate is dealt to the grid.
    """

    def weighted(k: float) -> Column:
        return F.col(signal) * (F.sqrt(F.col(support) / (F.col(support) + float(k))) if k else F.lit(1.0))

    sums = [f(pick(weighted(k), F.lit(0.0))).alias(f"__{n}_{i}") for i, k in enumerate(ks) for n, f, pick in (("up", F.sum, F.greatest), ("down", F.sum, F.least))]
    cell = df.groupBy(*keys, entity).agg(*sums)
    grid = F.array(*(F.struct(F.lit(float(k)).alias("k"), F.lit(float(c)).alias("cap"), F.col(f"__up_{i}").alias("up"), F.col(f"__down_{i}").alias("down")) for i, k in enumerate(ks) for c in caps))
    cell = cell.select(*keys, entity, F.explode(grid).alias("g")).select(*keys, entity, F.col("g.k").alias("grid_k"), F.col("g.cap").alias("grid_cap"), "g.up", "g.down")
    g = [*keys, "grid_k", "grid_cap"]
    w = W.partitionBy(*g)
    cell = cell.withColumn("pu", F.sum("up").over(w)).withColumn("pd", -F.sum("down").over(w))
    pool = BUDGET * F.least(F.col("pd") / F.nullif(F.col("pu"), F.lit(0.0)), F.col("grid_cap"))
    cell = cell.withColumn("points", F.coalesce(F.col("up") * BUDGET / F.nullif(F.col("pu"), F.lit(0.0)), F.lit(0.0)) + F.coalesce(F.col("down") * pool / F.nullif(F.col("pd"), F.lit(0.0)), F.lit(0.0)))
    total = cell.groupBy("grid_k", "grid_cap", entity).agg(F.sum("points").alias("points"))
    order = W.partitionBy("grid_k", "grid_cap").orderBy(F.round("points", 6).desc(), F.col(entity))
    return total.withColumn("rank", F.row_number().over(order).cast("long"))


def decile_slopes(df: DataFrame, control: str, x: str, y: str, tie: str, groups: int = 10, min_rows: int = 30, min_range: float = 10.0) -> DataFrame:
    """Slope of y on x within equal-sized groups of a control, where there are rows and spread enough."""
    ranked = global_rank(df, [F.col(control), F.col(tie)], "__rank")
    g = ranked.withColumn("decile", ntile_of(F.col("__rank"), ranked.count(), groups))
    return g.groupBy("decile").agg(F.count("*").alias("n"), (F.max(x) - F.min(x)).alias("x_range"), F.regr_slope(F.col(y), F.col(x)).alias("slope")).where((F.col("n") >= min_rows) & (F.col("x_range") >= min_range))


def vote_mass(df: DataFrame, event: str, weight: str) -> DataFrame:
    """Share of each event in all weight against an equal share."""
    s = df.groupBy(event).agg(F.sum(weight).alias("mass"))
    w = W.partitionBy(F.lit(1))
    s = s.withColumn("share", F.col("mass") / F.sum("mass").over(w)).withColumn("equal_share", 1.0 / F.count("*").over(w))
    return s.withColumn("excess", F.col("share") - F.col("equal_share"))
