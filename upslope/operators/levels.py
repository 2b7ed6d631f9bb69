"""Performance levels, stable levels and trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from upslope.functions.exprs import arg_max, arg_min
from upslope.operators.joins import null_safe_join


def performance_level(value: Column, anchor: Column, lower_is_better: Column, tolerance: float = 0.0) -> Column:
    """100 times the squared ratio to the anchor, within 0 and 100; null above 1 + ``tolerance``, where the mark is in doubt.

    With tolerance 0 every ratio above 1 counts as 100.
    """
    ratio = F.when(lower_is_better, anchor / F.nullif(value, F.lit(0.0))).otherwise(value / F.nullif(anchor, F.lit(0.0)))
    level = 100.0 * F.pow(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio)), 2)
    return F.when(ratio > 1.0 + tolerance, F.lit(None)).otherwise(level) if tolerance else level


def meet_best(df: DataFrame, keys: list[str], meet: str, date: str, level: str, ratio: str, row_id: str) -> DataFrame:
    """The best row of each key and meet, with the number of rows it stands for.

    A row with neither meet nor date is a meet of its own.
    """
    meet_key = F.when(F.col(meet).isNull() & F.col(date).isNull(), F.concat(F.lit("row|"), F.col(row_id).cast("string"))).otherwise(
        F.concat(F.coalesce(F.col(date).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(meet).cast("string"), F.lit("")))
    )
    w = W.partitionBy(*keys, "meet_key")
    first = F.row_number().over(w.orderBy(F.col(level).desc_nulls_last(), F.col(ratio).desc_nulls_last(), F.col(row_id)))
    ranked = df.withColumn("meet_key", meet_key).withColumn("source_rows", F.count("*").over(w)).withColumn("__first", first)
    return ranked.where("__first = 1").drop("__first")


def stable_level(meets: DataFrame, keys: list[str], level: str, tie: str, best: int = 3) -> DataFrame:
    """Mean of the best ``best`` meets per key, with spread measures and a reliability tier."""
    w = W.partitionBy(*keys).orderBy(F.col(level).desc(), F.col(tie))
    ranked = meets.where(F.col(level).isNotNull()).withColumn("__r", F.row_number().over(w))
    n = F.count("*")
    return ranked.groupBy(*keys).agg(
        F.avg(F.when(F.col("__r") <= best, F.col(level))).alias("stable_level"),
        F.max(level).alias("best_level"),
        F.avg(F.when(F.col("__r") <= 2, F.col(level))).alias("best_two_level"),
        F.median(level).alias("median_level"),
        F.stddev_samp(level).alias("sd_level"),
        (F.max(level) - F.min(level)).alias("span_level"),
        n.alias("n_meets"),
        F.when(n >= 5, "high").when(n >= 3, "standard").when(n == 2, "provisional").otherwise("single").alias("tier"),
    )


def threshold_scenarios(periods: DataFrame, segment: list[str], entity: str, n_col: str, thresholds: tuple[int, ...] = (1, 2, 3), min_segments: int = 100, min_entities: int = 25) -> DataFrame:
    """Ready periods and entities for each threshold, and the highest threshold with enough of both.

    The thresholds are few, so each row is dealt to those it passes instead of joined to them.
    """
    passes = F.array_compact(F.array(*(F.when(F.col(n_col) >= t, F.lit(t)) for t in thresholds)))
    dealt = periods.withColumn("threshold", F.explode(passes))
    counts = dealt.groupBy(*segment, "threshold").agg(F.count("*").alias("ready"), F.count_distinct(entity).alias("entities"))
    out = counts.groupBy(*segment).agg(
        *(F.coalesce(F.max(F.when(F.col("threshold") == t, F.col("ready"))), F.lit(0)).alias(f"ready_{t}") for t in thresholds),
        F.max(F.when((F.col("ready") >= min_segments) & (F.col("entities") >= min_entities) & (F.col("threshold") > min(thresholds)), F.col("threshold"))).alias("recommended"),
    )
    return out


def trajectories(periods: DataFrame, keys: list[str], time: str, level: str, eps: float = 1e-12, min_periods: int = 2) -> DataFrame:
    """Baseline, endpoint, peak, slope and improvement of each key with at least ``min_periods`` periods."""
    t = periods.groupBy(*keys).agg(
        F.count("*").alias("n_periods"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
        arg_min(level, time).alias("baseline"),
        arg_max(level, time).alias("endpoint"),
        F.max(level).alias("peak"),
        arg_max(time, level, time).alias("peak_time"),
        F.regr_slope(F.col(level), F.col(time)).alias("slope"),
    )
    gain = F.col("endpoint") - F.col("baseline")
    return (
        t.where(F.col("n_periods") >= min_periods)
        .withColumn("elapsed", F.col("last_time") - F.col("first_time"))
        .withColumn("improvement", gain)
        .withColumn("annualised", gain / F.nullif(F.col("elapsed").cast("double"), F.lit(0.0)))
        .withColumn("direction", F.when(gain > eps, "improved").when(gain < -eps, "declined").otherwise("unchanged"))
    )


def tail_flags(df: DataFrame, keys: list[str], value: str, p: float = 0.001) -> DataFrame:
    """Cumulative share of each value within its key and flags for both tails."""
    share = F.cume_dist().over(W.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last()))
    return df.withColumn("cume", share).withColumn("low_tail", F.col("cume") <= p).withColumn("high_tail", F.col("cume") > 1 - p)


def supported_resolution(df: DataFrame, event: list[str], family: list[str], entity: str, event_rows: int, event_entities: int, family_rows: int, family_entities: int) -> DataFrame:
    """event, family or global for each event cell: the finest level with enough rows and entities."""
    e = df.groupBy(*family, *[c for c in event if c not in family]).agg(F.count("*").alias("event_n"), F.count_distinct(entity).alias("event_entities"))
    f = df.groupBy(*family).agg(F.count("*").alias("family_n"), F.count_distinct(entity).alias("family_entities"))
    r = F.when((F.col("event_n") >= event_rows) & (F.col("event_entities") >= event_entities), "event").when((F.col("family_n") >= family_rows) & (F.col("family_entities") >= family_entities), "family")
    return null_safe_join(e, f, family).withColumn("resolution", r.otherwise("global"))


def bounds_check(df: DataFrame, keys: list[str], value: str, low: Column, high: Column, tails: tuple[float, float] = (0.0001, 0.9999)) -> DataFrame:
    """Plausibility class: outside absolute bounds is invalid; inside, the tails of the key's distribution are only marked."""
    inside = (F.col(value) >= low) & (F.col(value) <= high)
    q = df.where(inside).groupBy(*keys).agg(F.percentile(value, F.lit(tails[0])).alias("q_low"), F.percentile(value, F.lit(tails[1])).alias("q_high"))
    c = F.when(F.col(value).isNull(), "missing").when(F.col(value) < low, "below_bound").when(F.col(value) > high, "above_bound")
    c = c.when(F.col(value) < F.col("q_low"), "low_tail").when(F.col(value) > F.col("q_high"), "high_tail").otherwise("valid")
    return null_safe_join(df, q, keys, "left").withColumn("validity", c)


def first_reason(rules: list[tuple[str, Column]], otherwise: str = "eligible") -> Column:
    """Name of the first rule whose condition holds."""
    out = F.lit(otherwise)
    for name, condition in reversed(rules):
        out = F.when(condition, name).otherwise(out)
    return out


def exceedance_class(value: Column, anchor: Column, wind: Column, tolerance: float = 0.005, anomaly: float = 0.03, legal_wind: float = 2.0) -> Column:
    """How a mark above its anchor is treated: none, wind_aided, tolerance, anomaly or quarantine."""
    over = value / anchor - 1
    return F.when(~(over > 0) | over.isNull(), "none").when(wind > legal_wind, "wind_aided").when(over <= tolerance, "tolerance").when(over <= anomaly, "anomaly").otherwise("quarantine")


#: Ratios to the anchor up to which a mark is rounding, plausible, material, major; beyond the last it is an error.
EXCEEDANCE_RATIOS = (1.0005, 1.015, 1.03, 1.05)


def exceedance_review(ratio: Column, family: Column, wind_sensitive: Column, wind_suspected: Column) -> Column:
    """Struct (severity, finding, action) of a mark whose ratio to its anchor is above 1; null below.

    Wind-sensitive events are judged by their wind unless the ratio alone shows an error; ``family``
    (time, field or other) says what kind of error is likely.  Only rounding stays eligible, all else is quarantined.
    """
    rounding, plausible, material, error = EXCEEDANCE_RATIOS

    def found(severity: str, finding: Column | str) -> Column:
        finding = F.lit(finding) if isinstance(finding, str) else finding
        return F.struct(F.lit(severity).alias("severity"), finding.alias("finding"), F.lit("capped" if severity == "low" else "quarantine").alias("action"))

    kind = F.when(family == "time", "wrong distance, unit or time").when(family == "field", "wrong unit or mark").otherwise("wrong event or mark")
    wind = F.when(F.coalesce(wind_suspected, F.lit(False)), "wind aided").otherwise("wind unverified")
    return (
        F.when(~(ratio > 1) | ratio.isNull(), F.lit(None))
        .when(ratio <= rounding, found("low", "rounding"))
        .when(ratio >= error, found("critical", kind))
        .when(F.coalesce(wind_sensitive, F.lit(False)), found("high", wind))
        .when(ratio >= material, found("high", "major exceedance"))
        .when(ratio >= plausible, found("medium_high", "material exceedance"))
        .otherwise(found("medium", "record or scope difference"))
    )


def anchor_scope(df: DataFrame, season: str, gender: str, event: str, compatible: dict[str, tuple[str, ...]], only: dict[str, tuple[str, ...]], combined: dict[tuple[str, str], tuple[str, ...]], min_rows: int = 5000) -> DataFrame:
    """(season, gender, event, n, scope): which cells of an anchor table may score.

    ``combined`` lists the combined events held for a (season, gender), ``only`` the events of one gender,
    ``compatible`` the events of a season.  A cell is excluded by the first of these it breaks,
    exploratory below ``min_rows`` rows and primary otherwise; null seasons and genders fit nothing that is listed.
    """
    cells = df.groupBy(season, gender, event).agg(F.count("*").alias("n"))
    s, g, e = F.coalesce(season, F.lit("")), F.coalesce(gender, F.lit("")), F.col(event)

    def any_of(hits: list[Column]) -> Column:
        out = F.lit(False)
        for h in hits:
            out = out | h
        return out

    held = any_of([(s == a) & (g == b) & e.isin(*events) for (a, b), events in combined.items()])
    is_combined = e.isin(*{x for events in combined.values() for x in events}) if combined else F.lit(False)
    foreign = any_of([(g != who) & e.isin(*events) for who, events in only.items()])
    fits = any_of([(s == when) & e.isin(*events) for when, events in compatible.items()])
    rules = [("excluded_combined", is_combined & ~held), ("excluded_gender", foreign), ("excluded_season", ~F.coalesce(fits, F.lit(False))), ("exploratory", F.col("n") < min_rows)]
    return cells.withColumn("scope", first_reason(rules, "primary"))


def best_anchor(candidates: DataFrame, keys: list[str], value: str, lower_is_better: str, rejected: Column, pending: str, order: list[str]) -> DataFrame:
    """The best candidate per key that no reason rejects; a pending one wins ties, then the order of the source."""
    good = candidates.where(rejected.isNull())
    better = F.when(F.col(lower_is_better), F.col(value)).otherwise(-F.col(value))
    w = W.partitionBy(*keys).orderBy(better, F.col(pending).desc(), *order)
    return good.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
