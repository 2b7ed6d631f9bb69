"""Levels, trajectories, expectations and shrinkage on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from upslope.functions import exprs
from upslope.operators import levels, rankings, stats, windows
from upslope.plans._base import LEVELS, MEETS, PERF, PERIODS, TRAJ, levelled, meet_levels, performances, periods, rounded, trajectories, with_
from upslope.scratch import materialize

TKEYS = ["person", "school", "gender", "event"]
Q, O = {}, {}


def add(name, sql=None):
    def register(f):
        Q[name] = lambda spark, sf: rounded(f(spark, sf))
        if sql:
            O[name] = sql
        return f

    return register


@add("dev_performance_level", with_(LEVELS, "SELECT row_id, event, ratio, level FROM levels", doubles="ratio level"))
def _(spark, sf):
    return levelled(spark, sf).select("row_id", "event", "ratio", "level")


@add("dev_level_lower_is_better", with_(PERF, "SELECT row_id, 100 * power(least(1.0, min(value) OVER (PARTITION BY event) / value), 2) AS level FROM perf", doubles="level"))
def _(spark, sf):
    perf = performances(spark, sf)
    best = perf.groupBy("event").agg(F.min("value").alias("anchor"))
    return perf.join(best, "event").select("row_id", levels.performance_level(F.col("value"), F.col("anchor"), F.lit(True)).alias("level"))


@add("dev_meet_best", with_(MEETS, "SELECT person, event, season_year, meet, level, source_rows FROM meets", doubles="level"))
def _(spark, sf):
    return meet_levels(spark, sf).select("person", "event", "season_year", "meet", "level", "source_rows")


@add("dev_stable_level", with_(PERIODS, "SELECT * FROM periods", doubles="stable_level best_level best_two_level median_level sd_level span_level"))
def _(spark, sf):
    return periods(spark, sf)


@add(
    "dev_threshold_scenarios",
    with_(
        PERIODS,
        """, dealt AS (SELECT event, gender, school, t FROM periods CROSS JOIN (VALUES (1), (2), (3)) v(t) WHERE n_meets >= t),
        c AS (SELECT event, gender, t, count(*) AS ready, count(DISTINCT school) AS entities FROM dealt GROUP BY ALL)
        SELECT event, gender, coalesce(max(ready) FILTER (WHERE t = 1), 0) AS ready_1, coalesce(max(ready) FILTER (WHERE t = 2), 0) AS ready_2,
          coalesce(max(ready) FILTER (WHERE t = 3), 0) AS ready_3, max(t) FILTER (WHERE ready >= 100 AND entities >= 20 AND t > 1) AS recommended FROM c GROUP BY ALL""",
    ),
)
def _(spark, sf):
    return levels.threshold_scenarios(periods(spark, sf), ["event", "gender"], "school", "n_meets", min_entities=20)


@add(
    "dev_transitions",
    with_(
        PERIODS,
        """SELECT * FROM (SELECT person, event, season_year, lead(season_year) OVER w AS next_time, lead(stable_level) OVER w - stable_level AS change,
          (lead(stable_level) OVER w - stable_level) / (lead(season_year) OVER w - season_year) AS change_per_unit
          FROM periods WINDOW w AS (PARTITION BY person, event ORDER BY season_year)) WHERE next_time IS NOT NULL""",
        doubles="change change_per_unit",
    ),
)
def _(spark, sf):
    out = windows.transitions(periods(spark, sf), ["person", "event"], ["season_year"], "stable_level", "season_year")
    return out.select("person", "event", "season_year", "next_time", "change", "change_per_unit")


@add("dev_trajectories", with_(TRAJ, "SELECT person, school, gender, event, n_periods, first_time, last_time, peak_time, elapsed, baseline, endpoint, peak, slope, improvement, annualised, direction FROM traj", doubles="baseline endpoint peak slope improvement annualised"))
def _(spark, sf):
    return trajectories(spark, sf).select(*TKEYS, "n_periods", "first_time", "last_time", "peak_time", "elapsed", "baseline", "endpoint", "peak", "slope", "improvement", "annualised", "direction")


@add(
    "dev_tail_flags",
    with_(TRAJ, """SELECT person, event, improvement, c AS cume, c <= 0.01 AS low_tail, c > 0.99 AS high_tail FROM
      (SELECT *, cume_dist() OVER (PARTITION BY event ORDER BY round(improvement, 9)) AS c FROM traj)""", doubles="improvement cume"),
)
def _(spark, sf):
    t = trajectories(spark, sf).withColumn("improvement", F.round("improvement", 9))
    return levels.tail_flags(t, ["event"], "improvement", 0.01).select("person", "event", "improvement", "cume", "low_tail", "high_tail")


@add("dev_level_bands", with_(TRAJ, "SELECT CAST(least(20, greatest(1, floor(round(baseline, 9) / 5) + 1)) AS INTEGER) AS band, count(*) AS n, avg(improvement) AS mean FROM traj GROUP BY 1", doubles="mean"))
def _(spark, sf):
    return trajectories(spark, sf).groupBy(exprs.band(F.round("baseline", 9)).alias("band")).agg(F.count("*").alias("n"), F.avg("improvement").alias("mean"))


CELLS = (
    TRAJ
    + """,
cells AS (SELECT event, gender, count(*) AS event_n, count(DISTINCT school) AS event_entities FROM traj GROUP BY ALL),
fam AS (SELECT event, count(*) AS family_n, count(DISTINCT school) AS family_entities FROM traj GROUP BY ALL)"""
)


@add(
    "dev_supported_resolution",
    with_(CELLS, "SELECT event, gender, event_n, event_entities, family_n, family_entities, CASE WHEN event_n >= 270 AND event_entities >= 20 THEN 'event' WHEN family_n >= 250 AND family_entities >= 20 THEN 'family' ELSE 'global' END AS resolution FROM cells JOIN fam USING (event)"),
)
def _(spark, sf):
    return levels.supported_resolution(trajectories(spark, sf), ["event", "gender"], ["event"], "school", 270, 20, 250, 20)


FOLDS = """,
folds AS (SELECT school, n, CAST(1 + (row_number() OVER (ORDER BY n DESC, school) - 1) % 5 AS INTEGER) AS fold FROM (SELECT school, count(*) AS n FROM traj GROUP BY school))"""


@add("dev_round_robin_folds", with_(TRAJ + FOLDS, "SELECT * FROM folds"))
def _(spark, sf):
    return stats.round_robin_folds(trajectories(spark, sf), "school")


@add(
    "dev_winsorize",
    with_(
        TRAJ,
        """SELECT person, event, least(greatest(improvement, cap_low), cap_high) AS clipped FROM traj JOIN
        (SELECT event, quantile_cont(improvement, 0.005) AS cap_low, quantile_cont(improvement, 0.995) AS cap_high FROM traj GROUP BY event) USING (event)""",
        doubles="clipped",
    ),
)
def _(spark, sf):
    t = trajectories(spark, sf)
    return t.join(stats.winsor_caps(t, ["event"], "improvement"), "event").select("person", "event", stats.clip("improvement", "cap_low", "cap_high").alias("clipped"))


def _expected(spark, sf):
    t = materialize(trajectories(spark, sf).withColumn("band", exprs.band(F.round("baseline", 9))), "trajectories")
    t = t.join(stats.round_robin_folds(t, "school").select("school", "fold"), "school")
    return stats.crossfit_mean(t, "fold", "improvement", [["band"], ["band", "elapsed"], ["band", "elapsed", "event"]], [250.0, 100.0, 50.0])


CROSS = (
    TRAJ
    + FOLDS
    + """,
b AS (SELECT traj.*, fold, CAST(least(20, greatest(1, floor(round(baseline, 9) / 5) + 1)) AS INTEGER) AS band FROM traj JOIN folds USING (school)),
g AS (SELECT h.fold, avg(improvement) AS e0 FROM b JOIN (SELECT DISTINCT fold FROM b) h ON b.fold <> h.fold GROUP BY h.fold),
l1 AS (SELECT h.fold, band, sum(improvement) AS s, count(*) AS n FROM b JOIN (SELECT DISTINCT fold FROM b) h ON b.fold <> h.fold GROUP BY ALL),
l2 AS (SELECT h.fold, band, elapsed, sum(improvement) AS s, count(*) AS n FROM b JOIN (SELECT DISTINCT fold FROM b) h ON b.fold <> h.fold GROUP BY ALL),
l3 AS (SELECT h.fold, band, elapsed, event, sum(improvement) AS s, count(*) AS n FROM b JOIN (SELECT DISTINCT fold FROM b) h ON b.fold <> h.fold GROUP BY ALL),
x1 AS (SELECT b.*, (coalesce(s, 0) + 250 * e0) / (coalesce(n, 0) + 250) AS e1 FROM b JOIN g USING (fold) LEFT JOIN l1 USING (fold, band)),
x2 AS (SELECT x1.*, (coalesce(s, 0) + 100 * e1) / (coalesce(n, 0) + 100) AS e2 FROM x1 LEFT JOIN l2 USING (fold, band, elapsed)),
cross_fit AS (SELECT x2.*, (coalesce(s, 0) + 50 * e2) / (coalesce(n, 0) + 50) AS expected, coalesce(n, 0) AS support FROM x2 LEFT JOIN l3 USING (fold, band, elapsed, event))"""
)


@add("dev_crossfit_expectation", with_(CROSS, "SELECT person, event, fold, band, expected, support, improvement - expected AS value_added FROM cross_fit", doubles="expected value_added"))
def _(spark, sf):
    return _expected(spark, sf).select("person", "event", "fold", "band", "expected", "support", (F.col("improvement") - F.col("expected")).alias("value_added"))


@add(
    "dev_fit_metrics",
    with_(
        CROSS,
        """SELECT event, avg(abs(improvement - expected)) AS mae, sqrt(avg(power(improvement - expected, 2))) AS rmse, avg(improvement - expected) AS bias,
        1 - sum(power(improvement - expected, 2)) / (var_pop(improvement) * count(*)) AS r2, regr_slope(improvement, expected) AS calibration_slope FROM cross_fit GROUP BY event""",
        doubles="mae rmse bias r2 calibration_slope",
    ),
)
def _(spark, sf):
    return _expected(spark, sf).groupBy("event").agg(*stats.fit_metrics("improvement", "expected"))


@add(
    "dev_candidate_selection",
    with_(
        CROSS,
        """, c AS (SELECT candidate, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse FROM (SELECT 'shrunk' AS candidate, improvement - expected AS e FROM cross_fit
          UNION ALL SELECT 'band', improvement - e1 FROM cross_fit UNION ALL SELECT 'zero', improvement FROM cross_fit) GROUP BY candidate)
        SELECT candidate, mae, rmse, row_number() OVER (ORDER BY mae, rmse) AS position FROM c""",
        doubles="mae rmse",
    ),
)
def _(spark, sf):
    t = _expected(spark, sf)
    keyed = stats.crossfit_mean(t.drop("expected", "support"), "fold", "improvement", [["band"]], [250.0]).withColumnRenamed("expected", "e1")
    both = t.select("person", "event", "improvement", "expected").join(keyed.select("person", "event", "e1"), ["person", "event"])
    errors = both.select(F.expr("stack(3, 'shrunk', improvement - expected, 'band', improvement - e1, 'zero', improvement) AS (candidate, e)"))
    m = errors.groupBy("candidate").agg(F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"))
    return m.withColumn("position", F.row_number().over(stats.W.orderBy("mae", "rmse")).cast("long"))


UNITS = (
    CROSS
    + """,
fam_mean AS (SELECT person, school, gender, event, avg(improvement - expected) AS m, count(*) AS n FROM cross_fit GROUP BY ALL),
units AS (SELECT person, school, gender, avg(m) AS contribution, median(m) AS family_median, count(*) AS families, CAST(sum(n) AS BIGINT) AS n_rows FROM fam_mean GROUP BY ALL)"""
)


def _units(spark, sf):
    x = _expected(spark, sf).withColumn("va", F.col("improvement") - F.col("expected"))
    return stats.equal_weights(x, ["person", "school", "gender"], "event", "va")


@add("dev_equal_weights", with_(UNITS, "SELECT * FROM units", doubles="contribution family_median"))
def _(spark, sf):
    return _units(spark, sf)


def eb_sql(units: str, entity: str, score: str, part: str, min_sample: int) -> str:
    p = f"PARTITION BY {part}" if part else ""
    sel = f"{part}, " if part else ""
    offp = f"PARTITION BY {part}, n >= {min_sample}" if part else f"PARTITION BY n >= {min_sample}"
    return f""", base AS (SELECT {sel}{entity}, count(*) AS n, avg({score}) AS mean, var_samp({score}) AS v, sum({score}) AS s FROM {units} GROUP BY ALL),
    pool AS (SELECT *, sum((n - 1) * v) FILTER (WHERE n > 1) OVER ({p}) / sum(n - 1) FILTER (WHERE n > 1) OVER ({p}) AS pooled, sum(s) OVER ({p}) / sum(n) OVER ({p}) AS grand_mean FROM base),
    se AS (SELECT *, ((CASE WHEN n > 1 THEN (n - 1) * v ELSE 0 END) + 20 * pooled) / (n - 1 + 20) / n AS se2 FROM pool),
    tau AS (SELECT *, greatest(0, var_samp(mean) OVER ({p}) - avg(se2) OVER ({p})) AS tau2 FROM se),
    post AS (SELECT *, tau2 / (tau2 + se2) AS weight, grand_mean + tau2 / (tau2 + se2) * (mean - grand_mean) AS posterior, sqrt(tau2 * se2 / (tau2 + se2)) AS posterior_se FROM tau),
    ranked_eb AS (SELECT *, posterior - 1.96 * posterior_se AS ci_low, posterior + 1.96 * posterior_se AS ci_high, rank() OVER ({offp} ORDER BY round(posterior, 9) DESC) AS rk, count(*) OVER ({offp}) AS sz FROM post)
    SELECT {sel}{entity}, n, mean, pooled, grand_mean, se2, tau2, weight, posterior, posterior_se, ci_low, ci_high, CASE WHEN n >= {min_sample} THEN rk END AS official_rank,
      CASE WHEN n >= {min_sample} THEN CASE WHEN rk / sz <= 0.10 THEN 'top_10' WHEN rk / sz <= 0.25 THEN 'top_25' WHEN rk / sz <= 0.5 THEN 'upper_half' WHEN rk / sz <= 0.75 THEN 'third_quarter' ELSE 'last_quarter' END END AS band,
      CASE WHEN ci_low > 0 THEN 'positive' WHEN ci_high < 0 THEN 'negative' ELSE 'inconclusive' END AS evidence FROM ranked_eb"""


EB_DOUBLES = "mean pooled grand_mean se2 tau2 weight posterior posterior_se ci_low ci_high"


@add("dev_eb_ranking", with_(UNITS, eb_sql("units", "school", "contribution", "", 50), doubles=EB_DOUBLES))
def _(spark, sf):
    return stats.eb_rank(_units(spark, sf), "school", "contribution", min_sample=50)


@add("dev_eb_ranking_by_gender", with_(UNITS, eb_sql("units", "school", "contribution", "gender", 10), doubles=EB_DOUBLES))
def _(spark, sf):
    return stats.eb_rank(_units(spark, sf), "school", "contribution", ["gender"], min_sample=10)


@add("dev_group_improvement", with_(TRAJ, "SELECT school, n, mean, rank() OVER (ORDER BY round(mean, 9) DESC) AS position FROM (SELECT school, avg(improvement) AS mean, count(*) AS n FROM traj GROUP BY school)", doubles="mean"))
def _(spark, sf):
    g = trajectories(spark, sf).groupBy("school").agg(F.count("*").alias("n"), F.avg("improvement").alias("mean"))
    return g.withColumn("position", F.rank().over(stats.W.orderBy(F.round("mean", 9).desc())).cast("long"))


@add(
    "dev_beta_binomial",
    with_(
        TRAJ,
        """, c AS (SELECT school, CAST(sum(CASE WHEN improvement > 0 THEN 1 ELSE 0 END) AS BIGINT) AS k, count(*) AS n FROM traj GROUP BY school),
        p AS (SELECT *, sum(k) OVER () / sum(n) OVER () AS prior FROM c), r AS (SELECT *, (k + prior * 20) / (n + 20) AS rate FROM p),
        s AS (SELECT *, sqrt(rate * (1 - rate) / (n + 20 + 1)) AS rate_se FROM r)
        SELECT school, k, n, prior, rate, rate_se, greatest(0, rate - 1.96 * rate_se) AS ci_low, least(1, rate + 1.96 * rate_se) AS ci_high FROM s""",
        doubles="prior rate rate_se ci_low ci_high",
    ),
)
def _(spark, sf):
    return stats.beta_binomial(trajectories(spark, sf), "school", F.col("improvement") > 0)


@add(
    "dev_sensitivity_variants",
    with_(
        UNITS,
        """, r AS (SELECT school, person AS unit_id, contribution AS s, row_number() OVER (PARTITION BY school ORDER BY contribution DESC, person) AS hi, row_number() OVER (PARTITION BY school ORDER BY contribution, person) AS lo FROM units),
        caps AS (SELECT quantile_cont(s, 0.05) AS a, quantile_cont(s, 0.95) AS b FROM r),
        v AS (SELECT 'all' AS variant, school, s FROM r UNION ALL SELECT 'winsorized', school, least(greatest(s, a), b) FROM r CROSS JOIN caps
          UNION ALL SELECT 'drop_best', school, s FROM r WHERE hi > 1 UNION ALL SELECT 'drop_worst', school, s FROM r WHERE lo > 1),
        m AS (SELECT variant, school, rank() OVER (PARTITION BY variant ORDER BY round(avg(s), 9) DESC) AS rk FROM v GROUP BY variant, school)
        SELECT m.variant, count(*) AS n, corr(m.rk, f.rk) AS rank_corr, avg(abs(m.rk - f.rk)) AS mean_move, median(abs(m.rk - f.rk)) AS median_move,
          sum(CASE WHEN m.rk <= 5 AND f.rk <= 5 THEN 1 ELSE 0 END) / sum(CASE WHEN f.rk <= 5 THEN 1 ELSE 0 END) AS top_5_kept
        FROM m JOIN m f ON m.school = f.school AND f.variant = 'all' GROUP BY m.variant""",
        doubles="rank_corr mean_move median_move top_5_kept",
    ),
)
def _(spark, sf):
    u = _units(spark, sf).select("school", F.col("person").alias("unit_id"), "contribution")
    v = stats.unit_variants(u, "school", "contribution").groupBy("variant", "school").agg(F.avg("contribution").alias("m"))
    v = v.withColumn("rk", F.rank().over(stats.W.partitionBy("variant").orderBy(F.round("m", 9).desc())).cast("long"))
    return stats.rank_stability(v, "variant", "all", "school", "rk", (5,))


_VARIANTS = """, r AS (SELECT *, row_number() OVER (PARTITION BY school ORDER BY contribution DESC, unit_id) AS hi, row_number() OVER (PARTITION BY school ORDER BY contribution, unit_id) AS lo, count(*) OVER (PARTITION BY school) AS c FROM (SELECT *, person || '|' || gender AS unit_id FROM units)),
    caps AS (SELECT quantile_cont(contribution, 0.05) AS a, quantile_cont(contribution, 0.95) AS b FROM r),
    v AS (SELECT x AS variant, school, contribution AS s FROM r CROSS JOIN (VALUES ('primary_df20'), ('primary_df10'), ('primary_df50')) t(x) UNION ALL SELECT 'winsorized_df20', school, least(greatest(contribution, a), b) FROM r CROSS JOIN caps
      UNION ALL SELECT 'family_median_df20', school, family_median FROM r UNION ALL SELECT 'exclude_best_df20', school, contribution FROM r WHERE hi > 1 OR c = 1 UNION ALL SELECT 'exclude_worst_df20', school, contribution FROM r WHERE lo > 1 OR c = 1)"""
_EB_VARIANTS = eb_sql("v", "school", "s", "variant", 1).split("\n    SELECT variant")[0]
for _old in ("+ 20 * pooled", "n - 1 + 20"):
    _EB_VARIANTS = _EB_VARIANTS.replace(_old, _old.replace("20", "(CASE variant WHEN 'primary_df10' THEN 10 WHEN 'primary_df50' THEN 50 ELSE 20 END)"))


@add(
    "dev_ranking_sensitivity",
    with_(
        UNITS,
        _VARIANTS + _EB_VARIANTS + """, pop AS (SELECT school AS e FROM ranked_eb WHERE variant = 'primary_df20' AND n >= 30),
        q AS (SELECT variant, school, rank() OVER (PARTITION BY variant ORDER BY round(posterior, 9) DESC) AS rk FROM ranked_eb JOIN pop ON school = e),
        z AS (SELECT q.variant, count(*) AS n, corr(q.rk, f.rk) AS rank_corr, avg(abs(q.rk - f.rk)) AS mean_move, median(abs(q.rk - f.rk)) AS median_move,
          sum(CASE WHEN q.rk <= 10 AND f.rk <= 10 THEN 1 ELSE 0 END) / sum(CASE WHEN f.rk <= 10 THEN 1 ELSE 0 END) AS top_10_kept, sum(CASE WHEN q.rk <= 25 AND f.rk <= 25 THEN 1 ELSE 0 END) / sum(CASE WHEN f.rk <= 25 THEN 1 ELSE 0 END) AS top_25_kept
          FROM q JOIN q f ON q.school = f.school AND f.variant = 'primary_df20' GROUP BY q.variant)
        SELECT *, coalesce(rank_corr >= 0.9, false) AND top_10_kept >= 0.5 AND top_25_kept >= 0.6 AND median_move <= 25 AS stable FROM z""",
        doubles="rank_corr mean_move median_move top_10_kept top_25_kept",
    ),
)
def _(spark, sf):
    u = _units(spark, sf).withColumn("unit_id", F.concat_ws("|", "person", "gender"))
    return stats.sensitivity(u, "school", "unit_id", "contribution", "family_median")


@add("dev_mad", with_(TRAJ, "SELECT event, median(improvement) AS median, mad(improvement) AS mad FROM traj GROUP BY event", doubles="median mad"))
def _(spark, sf):
    return stats.mad(trajectories(spark, sf), ["event"], "improvement")


@add(
    "dev_plausibility",
    with_(
        PERF,
        """, b AS (SELECT *, 905.0 AS lo, 1900.0 AS hi FROM perf), q AS (SELECT event, quantile_cont(value, 0.01) AS ql, quantile_cont(value, 0.99) AS qh FROM b WHERE value BETWEEN lo AND hi GROUP BY event)
        SELECT event, CASE WHEN value < lo THEN 'below_bound' WHEN value > hi THEN 'above_bound' WHEN value < ql THEN 'low_tail' WHEN value > qh THEN 'high_tail' ELSE 'valid' END AS validity, count(*) AS n FROM b JOIN q USING (event) GROUP BY ALL""",
    ),
)
def _(spark, sf):
    out = levels.bounds_check(performances(spark, sf), ["event"], "value", F.lit(905.0), F.lit(1900.0), (0.01, 0.99))
    return out.groupBy("event", "validity").agg(F.count("*").alias("n"))


@add(
    "dev_reason_ladder",
    with_(PERF, """SELECT reason, reason = 'eligible' AS eligible, count(*) AS n FROM (SELECT CASE WHEN value < 905 THEN 'too_low' WHEN gender = 'AUTOMOBILE' THEN 'out_of_scope' WHEN season_year < 1996 THEN 'too_early' ELSE 'eligible' END AS reason FROM perf) GROUP BY reason"""),
)
def _(spark, sf):
    reason = levels.first_reason([("too_low", F.col("value") < 905), ("out_of_scope", F.col("gender") == "AUTOMOBILE"), ("too_early", F.col("season_year") < 1996)])
    return performances(spark, sf).groupBy(reason.alias("reason")).agg(F.count("*").alias("n")).select("reason", (F.col("reason") == "eligible").alias("eligible"), "n")


@add(
    "dev_anchor_exceedance",
    with_(
        PERF,
        """, a AS (SELECT event, quantile_cont(value, 0.95) AS anchor FROM perf GROUP BY event), x AS (SELECT value / anchor - 1 AS over_, CAST(meet % 5 AS DOUBLE) AS wind FROM perf JOIN a USING (event))
        SELECT CASE WHEN NOT (over_ > 0) THEN 'none' WHEN wind > 2.0 THEN 'wind_aided' WHEN over_ <= 0.005 THEN 'tolerance' WHEN over_ <= 0.03 THEN 'anomaly' ELSE 'quarantine' END AS treatment, count(*) AS n FROM x GROUP BY 1""",
    ),
)
def _(spark, sf):
    perf = performances(spark, sf)
    a = perf.groupBy("event").agg(F.percentile("value", F.lit(0.95)).alias("anchor"))
    t = levels.exceedance_class(F.col("value"), F.col("anchor"), (F.col("meet") % 5).cast("double"))
    return perf.join(a, "event").groupBy(t.alias("treatment")).agg(F.count("*").alias("n"))


@add(
    "dev_exceedance_review",
    with_(
        PERF,
        """, a AS (SELECT event, quantile_cont(value, 0.9) AS anchor FROM perf GROUP BY event),
        x AS (SELECT row_id, value / anchor AS ratio, CASE WHEN meet % 3 = 0 THEN 'time' WHEN meet % 3 = 1 THEN 'field' ELSE 'other' END AS family, season_type = 'outdoor' AND event < 'L' AS sensitive, meet % 7 = 0 AS suspected FROM perf JOIN a USING (event))
        SELECT row_id, CASE WHEN ratio <= 1.0005 THEN 'low' WHEN ratio >= 1.05 THEN 'critical' WHEN sensitive OR ratio >= 1.03 THEN 'high' WHEN ratio >= 1.015 THEN 'medium_high' ELSE 'medium' END AS severity,
          CASE WHEN ratio <= 1.0005 THEN 'rounding' WHEN ratio >= 1.05 THEN CASE family WHEN 'time' THEN 'wrong distance, unit or time' WHEN 'field' THEN 'wrong unit or mark' ELSE 'wrong event or mark' END
            WHEN sensitive THEN CASE WHEN suspected THEN 'wind aided' ELSE 'wind unverified' END WHEN ratio >= 1.03 THEN 'major exceedance' WHEN ratio >= 1.015 THEN 'material exceedance' ELSE 'record or scope difference' END AS finding,
          CASE WHEN ratio <= 1.0005 THEN 'capped' ELSE 'quarantine' END AS action FROM x WHERE ratio > 1""",
    ),
)
def _(spark, sf):
    perf = performances(spark, sf)
    a = perf.groupBy("event").agg(F.percentile("value", F.lit(0.9)).alias("anchor"))
    m = F.col("meet")
    x = perf.join(a, "event").withColumn("ratio", F.col("value") / F.col("anchor")).withColumn("family", F.when(m % 3 == 0, "time").when(m % 3 == 1, "field").otherwise("other"))
    r = levels.exceedance_review(F.col("ratio"), F.col("family"), (F.col("season_type") == "outdoor") & (F.col("event") < "L"), m % 7 == 0)
    return x.withColumn("r", r).where("r is not null").select("row_id", "r.severity", "r.finding", "r.action")


@add(
    "dev_anchor_scope",
    with_(
        PERF,
        """, c AS (SELECT season_type, gender, event, count(*) AS n FROM perf GROUP BY ALL)
        SELECT *, CASE WHEN event IN ('PROMO', 'SMALL') AND NOT (season_type = 'indoor' AND gender = 'BUILDING' AND event = 'PROMO' OR season_type = 'outdoor' AND gender = 'MACHINERY' AND event = 'SMALL') THEN 'excluded_combined'
          WHEN gender <> 'MACHINERY' AND event = 'MEDIUM' THEN 'excluded_gender' WHEN NOT (season_type = 'indoor' AND event IN ('ECONOMY', 'PROMO', 'MEDIUM') OR season_type = 'outdoor' AND event IN ('ECONOMY', 'STANDARD', 'SMALL', 'MEDIUM')) THEN 'excluded_season'
          WHEN n < 60 THEN 'exploratory' ELSE 'primary' END AS scope FROM c""",
    ),
)
def _(spark, sf):
    compatible = {"indoor": ("ECONOMY", "PROMO", "MEDIUM"), "outdoor": ("ECONOMY", "STANDARD", "SMALL", "MEDIUM")}
    combined = {("indoor", "BUILDING"): ("PROMO",), ("outdoor", "MACHINERY"): ("SMALL",)}
    return levels.anchor_scope(performances(spark, sf), "season_type", "gender", "event", compatible, {"MACHINERY": ("MEDIUM",)}, combined, 60)


@add(
    "dev_best_anchor",
    with_(PERF, """SELECT event, value, row_id FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY -value, (meet % 2 = 0) DESC, row_id) AS r FROM perf WHERE value <= 1990 AND gender <> 'MACHINERY') WHERE r = 1""", doubles="value"),
)
def _(spark, sf):
    c = performances(spark, sf).withColumn("lower", F.lit(False)).withColumn("pending", F.col("meet") % 2 == 0)
    rejected = F.when(F.col("value") > 1990, "implausible").when(F.col("gender") == "MACHINERY", "section")
    return levels.best_anchor(c, ["event"], "value", "lower", rejected, "pending", ["row_id"]).select("event", "value", "row_id")


@add(
    "dev_cohorts",
    with_(
        TRAJ,
        """, t AS (SELECT *, round(baseline, 6) AS b, round(endpoint, 6) AS e FROM traj) SELECT cohort, count(*) AS n, avg(improvement) AS mean FROM (SELECT 'all' AS cohort, improvement FROM t UNION ALL SELECT 'baseline_70', improvement FROM t WHERE b >= 70 UNION ALL SELECT 'baseline_80', improvement FROM t WHERE b >= 80
        UNION ALL SELECT 'endpoint_90', improvement FROM t WHERE e >= 90 UNION ALL SELECT 'endpoint_95', improvement FROM t WHERE e >= 95) GROUP BY cohort""",
        doubles="mean",
    ),
)
def _(spark, sf):
    t = trajectories(spark, sf).withColumn("b", F.round("baseline", 6)).withColumn("e", F.round("endpoint", 6))
    return rankings.cohorts(t, "b", "e").groupBy("cohort").agg(F.count("*").alias("n"), F.avg("improvement").alias("mean"))


QUERIES, ORACLES = Q, O
