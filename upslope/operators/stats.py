"""Cross-fitted expectations, shrinkage and sensitivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from upslope.functions.exprs import safe_corr
from upslope.operators.joins import null_safe_join
from upslope.operators.ordering import exact_quantiles, global_rank
from upslope.scratch import materialize


def round_robin_folds(df: DataFrame, entity: str, folds: int = 5) -> DataFrame:
    """(entity, n, fold): entities by size, largest first, dealt to the folds in turn."""
    sizes = df.groupBy(entity).agg(F.count("*").alias("n"))
    ranked = global_rank(sizes, [F.col("n").desc(), F.col(entity)], "__rank")
    return ranked.withColumn("fold", (1 + (F.col("__rank") - 1) % folds).cast("int")).drop("__rank")


def winsor_caps(train: DataFrame, keys: list[str], value: str, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Exact quantile caps per key; without keys the rows are ranked by ranges, with keys a key's distinct values are held by one task."""
    if not keys:
        found = exact_quantiles(train, value, [low, high])
        return train.sparkSession.createDataFrame([tuple(found)], "cap_low double, cap_high double")
    q = [F.percentile(value, F.lit(p)).alias(n) for p, n in ((low, "cap_low"), (high, "cap_high"))]
    return train.groupBy(*keys).agg(*q)


def clip(value: Column | str, low: Column | str, high: Column | str) -> Column:
    value, low, high = (F.col(x) if isinstance(x, str) else x for x in (value, low, high))
    return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))


def crossfit_mean(df: DataFrame, fold: str, value: str, levels: list[list[str]], shrink: list[float], folds: int = 5) -> DataFrame:
    """Every row with its expectation from the other folds, shrunk level by level.

    ``levels`` go from coarse to fine, each with its weight in ``shrink``; the parent of
    the first is the overall mean.  Means and counts leave a fold out by
    subtraction: totals minus the fold's own, so each level is aggregated once.
    The input is written once and read by every level.  Null keys are keys like any other.
    """
    df = materialize(df, "crossfit")
    total = df.groupBy(fold).agg(F.sum(value).alias("fs"), F.count(value).alias("fn"))
    everything = W.partitionBy(F.lit(1))
    total = total.withColumn("s", F.sum("fs").over(everything) - F.col("fs")).withColumn("n", F.sum("fn").over(everything) - F.col("fn"))
    out = null_safe_join(df, F.broadcast(total.select(fold, (F.col("s") / F.nullif(F.col("n"), F.lit(0))).alias("expected")).limit(folds + 1)), [fold])
    for keys, k in zip(levels, shrink, strict=True):
        own = df.groupBy(*keys, fold).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("fs"), F.count(value).alias("fn"))
        w = W.partitionBy(*keys)
        own = own.select(*keys, fold, (F.sum("fs").over(w) - F.col("fs")).alias("__s"), (F.sum("fn").over(w) - F.col("fn")).alias("__n"))
        out = null_safe_join(out, own, [*keys, fold])
        out = out.withColumn("expected", (F.col("__s") + k * F.col("expected")) / (F.col("__n") + k)).withColumn("support", F.col("__n")).drop("__s", "__n")
    return out


def fit_metrics(observed: str, predicted: str) -> list[Column]:
    """Aggregates: mean absolute error, root mean square error, bias, R squared and calibration slope."""
    error = F.col(observed) - F.col(predicted)
    both = F.col(predicted).isNotNull() & F.col(observed).isNotNull()
    y = F.when(both, F.col(observed))
    return [
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(error).alias("bias"),
        (1 - F.sum(error * error) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("r2"),
        F.regr_slope(F.col(observed), F.col(predicted)).alias("calibration_slope"),
    ]


def equal_weights(df: DataFrame, person: list[str], family: str, value: str) -> DataFrame:
    """Mean and median of family means per person: every family counts alike, every row within its family."""
    families = df.groupBy(*person, family).agg(F.avg(value).alias("m"), F.count("*").alias("n"))
    return families.groupBy(*person).agg(F.avg("m").alias("contribution"), F.median("m").alias("family_median"), F.count("*").alias("families"), F.sum("n").alias("n_rows"))


def eb_rank(units: DataFrame, entity: str, score: str, partition: list[str] | None = None, min_sample: int = 20, prior_df: float | Column = 20.0, z: float = 1.96) -> DataFrame:
    """Empirical-Bayes ranking of entity means within each partition.

    An entity's variance is drawn to the pooled one with ``prior_df`` degrees of
    freedom; the spread between entities is what the variance of the means exceeds the mean
    squared error by; means shrink to the overall mean by tau^2 / (tau^2 + se^2).
    Only entities with ``min_sample`` units get an official rank.  ``prior_df`` may depend on the partition.
    """
    part = partition or []
    keyed = units if part else units.withColumn("__all", F.lit(1))
    p = part or ["__all"]
    base = keyed.where(F.col(score).isNotNull()).groupBy(*p, entity).agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.var_samp(score).alias("var"), F.sum(score).alias("__sum"))
    w = W.partitionBy(*p)
    free = F.sum(F.when(F.col("n") > 1, F.col("n") - 1)).over(w)
    base = base.withColumn("pooled", F.sum(F.when(F.col("n") > 1, (F.col("n") - 1) * F.col("var"))).over(w) / F.nullif(free.cast("double"), F.lit(0.0)))
    base = base.withColumn("grand_mean", F.sum("__sum").over(w) / F.sum("n").over(w))
    own = F.when(F.col("n") > 1, (F.col("n") - 1) * F.col("var")).otherwise(0.0)
    base = base.withColumn("se2", (own + prior_df * F.coalesce("pooled", F.lit(0.0))) / (F.col("n") - 1 + prior_df) / F.col("n"))
    base = base.withColumn("tau2", F.greatest(F.lit(0.0), F.coalesce(F.var_samp("mean").over(w), F.lit(0.0)) - F.avg("se2").over(w)))
    both = F.nullif(F.col("tau2") + F.col("se2"), F.lit(0.0))
    base = base.withColumn("weight", F.coalesce(F.col("tau2") / both, F.lit(0.0)))
    base = base.withColumn("posterior", F.col("grand_mean") + F.col("weight") * (F.col("mean") - F.col("grand_mean")))
    base = base.withColumn("posterior_se", F.sqrt(F.coalesce(F.col("tau2") * F.col("se2") / both, F.lit(0.0))))
    base = base.withColumn("ci_low", F.col("posterior") - z * F.col("posterior_se")).withColumn("ci_high", F.col("posterior") + z * F.col("posterior_se"))
    official = F.col("n") >= min_sample
    order = W.partitionBy(*p, "official").orderBy(F.round("posterior", 9).desc())
    base = base.withColumn("official", official).withColumn("__rank", F.rank().over(order)).withColumn("__size", F.count("*").over(W.partitionBy(*p, "official")))
    base = base.withColumn("official_rank", F.when(official, F.col("__rank")).cast("long"))
    share = F.col("__rank") / F.col("__size")
    band = F.when(share <= 0.10, "top_10").when(share <= 0.25, "top_25").when(share <= 0.50, "upper_half").when(share <= 0.75, "third_quarter").otherwise("last_quarter")
    evidence = F.when(F.col("ci_low") > 0, "positive").when(F.col("ci_high") < 0, "negative").otherwise("inconclusive")
    base = base.withColumn("band", F.when(official, band)).withColumn("evidence", evidence)
    return base.select(*part, entity, "n", "mean", "pooled", "grand_mean", "se2", "tau2", "weight", "posterior", "posterior_se", "ci_low", "ci_high", "official_rank", "band", "evidence")


def beta_binomial(df: DataFrame, entity: str, success: Column, strength: float = 20.0, partition: list[str] | None = None, z: float = 1.96) -> DataFrame:
    """Success rates drawn to the overall rate with the weight of ``strength`` trials; interval within 0 and 1."""
    part = partition or []
    base = df.groupBy(*part, entity).agg(F.sum(success.cast("long")).alias("k"), F.count("*").alias("n"))
    w = W.partitionBy(*part) if part else W.partitionBy(F.lit(1))
    p = F.sum("k").over(w) / F.sum("n").over(w)
    base = base.withColumn("prior", p).withColumn("rate", (F.col("k") + F.col("prior") * strength) / (F.col("n") + strength))
    se = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + strength + 1))
    base = base.withColumn("rate_se", se)
    low, high = F.col("rate") - z * F.col("rate_se"), F.col("rate") + z * F.col("rate_se")
    return base.withColumn("ci_low", F.greatest(F.lit(0.0), low)).withColumn("ci_high", F.least(F.lit(1.0), high))


def unit_variants(units: DataFrame, entity: str, score: str) -> DataFrame:
    """Units once for each variant: all, winsorized at 5 and 95 percent, without the best and without the worst of each entity."""
    w = W.partitionBy(entity)
    tie = F.col("unit_id")
    r = units.withColumn("__hi", F.row_number().over(w.orderBy(F.col(score).desc(), tie))).withColumn("__lo", F.row_number().over(w.orderBy(F.col(score), tie)))
    caps = winsor_caps(units, [], score, 0.05, 0.95)
    r = r.crossJoin(F.broadcast(caps))  # one row
    picks = F.array_compact(
        F.array(
            F.struct(F.lit("all").alias("variant"), F.col(score).alias("s")),
            F.struct(F.lit("winsorized").alias("variant"), clip(score, "cap_low", "cap_high").alias("s")),
            F.when(F.col("__hi") > 1, F.struct(F.lit("drop_best").alias("variant"), F.col(score).alias("s"))),
            F.when(F.col("__lo") > 1, F.struct(F.lit("drop_worst").alias("variant"), F.col(score).alias("s"))),
        )
    )
    out = r.withColumn("__v", F.explode(picks))
    return out.select(entity, "unit_id", F.col("__v.variant").alias("variant"), F.col("__v.s").alias(score))


#: Degrees of freedom of each variant's prior, and the floors of a stable ranking.
VARIANT_DF = {"primary_df20": 20.0, "primary_df10": 10.0, "primary_df50": 50.0, "winsorized_df20": 20.0, "family_median_df20": 20.0, "exclude_best_df20": 20.0, "exclude_worst_df20": 20.0}
STABLE = {"rank_corr": 0.90, "top_10_kept": 0.50, "top_25_kept": 0.60, "median_move": 25.0}


def sensitivity(units: DataFrame, entity: str, unit: str, score: str, family_median: str, min_sample: int = 30, tops: tuple[int, int] = (10, 25)) -> DataFrame:
    """How each variant of the empirical-Bayes ranking differs from the primary one, and whether it passes the floors.

    Variants change the prior's degrees of freedom, clip scores at the 5 and 95 percent quantiles, take
    the median of families, or leave out the best or worst unit of an entity that has several.  Entities
    with ``min_sample`` units in the primary variant are ranked anew among themselves.
    """
    w = W.partitionBy(entity)
    best, worst = (F.row_number().over(w.orderBy(o, F.col(unit))) for o in (F.col(score).desc(), F.col(score)))
    units = materialize(units.withColumn("__best", best).withColumn("__worst", worst).withColumn("__n", F.count("*").over(w)), "units")
    low, high = exact_quantiles(units, score, [0.05, 0.95])
    single = F.col("__n") == 1
    picks = {
        "primary_df20": F.col(score), "primary_df10": F.col(score), "primary_df50": F.col(score), "winsorized_df20": clip(score, F.lit(low), F.lit(high)), "family_median_df20": F.col(family_median),
        "exclude_best_df20": F.when(single | (F.col("__best") > 1), F.col(score)), "exclude_worst_df20": F.when(single | (F.col("__worst") > 1), F.col(score)),
    }
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("variant"), v.alias("s")) for k, v in picks.items())))
    v = units.select(entity, rows.alias("v")).select(entity, "v.variant", F.col("v.s").alias("s")).where("s is not null")
    df = F.lit(20.0)
    for name, d in VARIANT_DF.items():
        df = F.when(F.col("variant") == name, d).otherwise(df)
    ranked = materialize(eb_rank(v, entity, "s", ["variant"], 1, df).select("variant", entity, "n", "posterior"), "variants")
    official = ranked.where((F.col("variant") == "primary_df20") & (F.col("n") >= min_sample)).select(F.col(entity).alias("__e"))
    ranked = ranked.join(official, F.col(entity).eqNullSafe(F.col("__e"))).drop("__e")
    ranked = ranked.withColumn("rk", F.rank().over(W.partitionBy("variant").orderBy(F.round("posterior", 9).desc())).cast("long"))
    out = rank_stability(ranked, "variant", "primary_df20", entity, "rk", tops)
    passes = (F.coalesce(F.col("rank_corr") >= STABLE["rank_corr"], F.lit(False)) & (F.col(f"top_{tops[0]}_kept") >= STABLE["top_10_kept"])
              & (F.col(f"top_{tops[1]}_kept") >= STABLE["top_25_kept"]) & (F.col("median_move") <= STABLE["median_move"]))
    return out.withColumn("stable", passes)


def rank_stability(ranks: DataFrame, variant: str, reference: str, entity: str, rank: str, tops: tuple[int, ...] = (10, 25)) -> DataFrame:
    """Each variant against the reference: rank correlation, mean move and shares of the top kept."""
    ref = ranks.where(F.col(variant) == reference).select(entity, F.col(rank).alias("__ref"))
    both = ranks.join(ref, entity)
    kept = [
        (F.sum(((F.col(rank) <= t) & (F.col("__ref") <= t)).cast("long")) / F.nullif(F.sum((F.col("__ref") <= t).cast("long")).cast("double"), F.lit(0.0))).alias(f"top_{t}_kept")
        for t in tops
    ]
    return both.groupBy(variant).agg(F.count("*").alias("n"), safe_corr(rank, "__ref").alias("rank_corr"), F.avg(F.abs(F.col(rank) - F.col("__ref"))).alias("mean_move"), F.median(F.abs(F.col(rank) - F.col("__ref"))).alias("median_move"), *kept)


def mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median and median absolute deviation per key."""
    medians = df.groupBy(*keys).agg(F.median(value).alias("median"))
    return null_safe_join(df, medians, keys).groupBy(*keys).agg(F.max("median").alias("median"), F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))


def concentration(df: DataFrame, keys: list[str], amount: str, tie: str, top: int = 5) -> DataFrame:
    """Herfindahl index, effective number and share of the largest ``top`` of positive amounts."""
    w = W.partitionBy(*keys)
    pos = df.where(F.col(amount) > 0)
    pos = pos.withColumn("share", F.col(amount) / F.sum(amount).over(w)).withColumn("__r", F.row_number().over(w.orderBy(F.col(amount).desc(), F.col(tie))))
    hhi = F.sum(F.col("share") * F.col("share"))
    return pos.groupBy(*keys).agg(F.count("*").alias("n"), hhi.alias("hhi"), (1 / hhi).alias("effective_n"), F.sum(F.when(F.col("__r") <= top, F.col("share"))).alias(f"top_{top}_share"))
