"""Point allocation, trends, rankings and audits on the shared tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from upslope.functions import exprs
from upslope.operators import points, rankings, stats, trends
from upslope.plans._base import PERIODS, TRAJ, periods, rounded, trajectories, with_

Q, O = {}, {}


def add(name, sql=None):
    def register(f):
        Q[name] = lambda spark, sf: rounded(f(spark, sf), 6 if name.startswith("rank_") else 4)
        if sql:
            O[name] = sql
        return f

    return register


SCOPES = (
    PERIODS
    + """,
sig AS (SELECT person, school, gender, event, season_year, stable_level - avg(stable_level) OVER (PARTITION BY event) AS signal, n_meets AS support,
    CASE WHEN person % 2 = 0 THEN 'indoor' ELSE 'outdoor' END AS season_type FROM periods),
scoped AS (SELECT *, 'all_time' AS time_scope, NULL::INTEGER AS scope_year, NULL::VARCHAR AS scope_season FROM sig
  UNION ALL SELECT *, 'all_time_season_type', NULL, season_type FROM sig UNION ALL SELECT *, 'single_season', season_year, season_type FROM sig)"""
)
PART = ["time_scope", "scope_year", "scope_season", "gender", "event"]


def signals(spark, sf):
    p = periods(spark, sf)
    s = p.select("person", "school", "gender", "event", "season_year", (F.col("stable_level") - F.avg("stable_level").over(W.partitionBy("event"))).alias("signal"), F.col("n_meets").alias("support"))
    return s.withColumn("season_type", F.when(F.col("person") % 2 == 0, "indoor").otherwise("outdoor"))


def scoped(spark, sf):
    return points.scope_expand(signals(spark, sf), "season_year", "season_type")


@add("pts_scope_expansion", with_(SCOPES, "SELECT time_scope, scope_year, scope_season, count(*) AS n FROM scoped GROUP BY ALL"))
def _(spark, sf):
    return scoped(spark, sf).groupBy("time_scope", "scope_year", "scope_season").agg(F.count("*").alias("n"))


BUDGETED = SCOPES + """,
budgeted AS (SELECT *, signal * 100000 / nullif(sum(greatest(signal, 0)) OVER (PARTITION BY time_scope, scope_year, scope_season, gender, event), 0) AS points FROM scoped)"""


@add("pts_event_budget", with_(BUDGETED, "SELECT time_scope, scope_year, scope_season, event, person, season_year, points FROM budgeted", doubles="points"))
def _(spark, sf):
    p = points.allocate_budget(scoped(spark, sf), PART, "signal")
    return p.select("time_scope", "scope_year", "scope_season", "event", "person", "season_year", "points")


@add("pts_budget_audit", with_(BUDGETED, "SELECT time_scope, count(DISTINCT (scope_year, scope_season, gender, event)) AS partitions, round(max(s), 2) AS most, round(min(s), 2) AS least FROM (SELECT time_scope, scope_year, scope_season, gender, event, sum(greatest(points, 0)) AS s FROM budgeted GROUP BY ALL) GROUP BY 1"))
def _(spark, sf):
    p = points.allocate_budget(scoped(spark, sf), PART, "signal").groupBy(*PART).agg(F.sum(F.greatest("points", F.lit(0.0))).alias("s"))
    return p.groupBy("time_scope").agg(F.count("*").alias("partitions"), F.round(F.max("s"), 2).alias("most"), F.round(F.min("s"), 2).alias("least"))


POOLS = SCOPES + """,
ks AS (SELECT gender, event, greatest(1, median(support)) AS k FROM sig GROUP BY ALL),
w AS (SELECT sig.*, k, signal * sqrt(support / (support + k)) AS weighted FROM sig JOIN ks USING (gender, event)),
u AS (SELECT *, sum(greatest(weighted, 0)) OVER p AS up, -sum(least(weighted, 0)) OVER p AS down FROM w WINDOW p AS (PARTITION BY gender, event)),
pooled AS (SELECT *, 100000 * least(down / up, 0.9) AS negative_pool, CASE WHEN weighted > 0 THEN weighted * 100000 / up WHEN weighted < 0 THEN weighted * 100000 * least(down / up, 0.9) / down ELSE 0 END AS points FROM u)"""


def pooled(spark, sf):
    return points.bounded_pools(signals(spark, sf), ["gender", "event"], "signal", "support", cap=0.9)


@add("pts_bounded_negative_pool", with_(POOLS, "SELECT gender, event, person, season_year, k, weighted, negative_pool, points FROM pooled", doubles="k weighted negative_pool points"))
def _(spark, sf):
    return pooled(spark, sf).select("gender", "event", "person", "season_year", "k", "weighted", "negative_pool", "points")


@add("pts_group_points", with_(POOLS, """, ev AS (SELECT gender, count(DISTINCT event) AS events FROM pooled GROUP BY 1), t AS (SELECT gender, school, sum(points) AS total, count(DISTINCT event) AS scored_events FROM pooled GROUP BY ALL)
    SELECT gender, school, total, scored_events, events, total / events AS group_points, rank() OVER (PARTITION BY gender ORDER BY round(total / events, 6) DESC) AS group_rank FROM t JOIN ev USING (gender)""", doubles="total group_points"))
def _(spark, sf):
    return points.group_points(pooled(spark, sf), ["gender"], "school", "event")


GROUPED = POOLS + """,
grp AS (SELECT *, CASE WHEN event < 'M' THEN 'first' ELSE 'second' END AS grp FROM pooled),
gp AS (SELECT gender, grp, school, sum(points) / any_value(events) AS group_points FROM grp JOIN (SELECT gender, grp, count(DISTINCT event) AS events FROM grp GROUP BY ALL) e USING (gender, grp) GROUP BY ALL)"""


def grouped(spark, sf):
    p = pooled(spark, sf).withColumn("grp", F.when(F.col("event") < "M", "first").otherwise("second"))
    return points.group_points(p, ["gender", "grp"], "school", "event")


@add("pts_overall_points", with_(GROUPED, """, o AS (SELECT gender, count(DISTINCT grp) AS groups FROM gp GROUP BY 1), t AS (SELECT gender, school, sum(group_points) AS points, count(DISTINCT grp) AS held_groups FROM gp GROUP BY ALL)
    SELECT gender, school, points, held_groups, groups, points / (groups * 100000) AS share, rank() OVER (PARTITION BY gender ORDER BY round(points, 6) DESC) AS overall_rank FROM t JOIN o USING (gender)""", doubles="points share"))
def _(spark, sf):
    return points.overall_points(grouped(spark, sf), ["gender"], "grp", "school")


@add("pts_combined_overall_points", with_(GROUPED, """, c AS (SELECT grp, school, sum(group_points) / any_value(genders) AS group_points FROM gp JOIN (SELECT grp, count(DISTINCT gender) AS genders FROM gp GROUP BY 1) g USING (grp) GROUP BY ALL), t AS (SELECT school, sum(group_points) AS points, count(DISTINCT grp) AS held_groups FROM c GROUP BY 1)
    SELECT school, points, held_groups, 2::BIGINT AS groups, points / 200000 AS share, rank() OVER (ORDER BY round(points, 6) DESC) AS overall_rank FROM t""", doubles="points share"))
def _(spark, sf):
    return points.overall_points(points.combine_scopes(grouped(spark, sf), "gender", ["grp"], "school"), [], "grp", "school")


@add("pts_concentration", with_(POOLS, """, c AS (SELECT school, person, sum(points) AS amount FROM pooled GROUP BY ALL), s AS (SELECT *, amount / sum(amount) OVER (PARTITION BY school) AS share, row_number() OVER (PARTITION BY school ORDER BY amount DESC, person) AS r FROM c WHERE amount > 0)
    SELECT school, count(*) AS n, sum(share * share) AS hhi, 1 / sum(share * share) AS effective_n, sum(share) FILTER (WHERE r <= 5) AS top_5_share FROM s GROUP BY school""", doubles="hhi effective_n top_5_share"))
def _(spark, sf):
    c = pooled(spark, sf).groupBy("school", "person").agg(F.sum("points").alias("amount"))
    return stats.concentration(c, ["school"], "amount", "person")


@add("pts_model_grid", with_(SCOPES, """, g AS (SELECT sig.*, k, cap, signal * CASE WHEN k = 0 THEN 1 ELSE sqrt(support / (support + k)) END AS weighted FROM sig CROSS JOIN (VALUES (0.0), (50.0), (100.0), (191.0), (300.0), (500.0)) a(k) CROSS JOIN (VALUES (0.5::DOUBLE), (1.0), (1.5), (1e18)) b(cap)),
    c AS (SELECT event, k, cap, school, sum(greatest(weighted, 0)) AS up, sum(least(weighted, 0)) AS down FROM g GROUP BY ALL), t AS (SELECT *, sum(up) OVER p AS pu, -sum(down) OVER p AS pd FROM c WINDOW p AS (PARTITION BY event, k, cap)),
    x AS (SELECT k AS grid_k, cap AS grid_cap, school, sum(up * 100000 / pu + down * 100000 * least(pd / pu, cap) / pd) AS points FROM t GROUP BY ALL)
    SELECT CAST(grid_k AS DOUBLE) AS grid_k, CAST(grid_cap AS DOUBLE) AS grid_cap, school, points, row_number() OVER (PARTITION BY grid_k, grid_cap ORDER BY round(points, 6) DESC, school) AS rank FROM x""", doubles="points"))
def _(spark, sf):
    return points.model_grid(signals(spark, sf), ["event"], "school", "signal", "support")


@add("pts_matched_deciles", with_(TRAJ, """SELECT decile, count(*) AS n, max(baseline) - min(baseline) AS x_range, regr_slope(improvement, baseline) AS slope FROM (SELECT *, ntile(10) OVER (ORDER BY elapsed, person, event) AS decile FROM traj) GROUP BY decile HAVING count(*) >= 30 AND max(baseline) - min(baseline) >= 10""", doubles="x_range slope"))
def _(spark, sf):
    t = trajectories(spark, sf).withColumn("tie", F.struct("person", "event"))
    return points.decile_slopes(t, "elapsed", "baseline", "improvement", "tie")


@add("pts_vote_mass", with_(PERIODS, "SELECT event, mass, mass / sum(mass) OVER () AS share, 1.0 / count(*) OVER () AS equal_share, mass / sum(mass) OVER () - 1.0 / count(*) OVER () AS excess FROM (SELECT event, sum(stable_level) AS mass FROM periods GROUP BY event)", doubles="mass share equal_share excess"))
def _(spark, sf):
    return points.vote_mass(periods(spark, sf), "event", "stable_level")


@add("pts_time_neutral_drift", with_(PERIODS, """, m AS (SELECT event, season_year, sum(stable_level * n_meets) / sum(n_meets) AS mean FROM periods GROUP BY ALL)
    SELECT event, avg(mean) AS mean, regr_slope(mean, season_year) AS slope, corr(mean, season_year) AS drift FROM m GROUP BY event""", doubles="mean slope drift"))
def _(spark, sf):
    m = periods(spark, sf).groupBy("event", "season_year").agg(exprs.weighted_mean("stable_level", "n_meets").alias("m"))
    return m.groupBy("event").agg(F.avg("m").alias("mean"), F.regr_slope(F.col("m"), F.col("season_year")).alias("slope"), exprs.safe_corr("m", "season_year").alias("drift"))


SEASON = (
    PERIODS
    + """,
season0 AS (SELECT school, gender, season_year, CASE WHEN count(*) >= 20 THEN avg(stable_level) END AS value FROM periods GROUP BY ALL),
season AS (SELECT *, CASE WHEN value IS NOT NULL THEN rank() OVER (PARTITION BY gender, season_year ORDER BY round(value, 9) DESC NULLS LAST) END AS rank, count(value) OVER (PARTITION BY gender, season_year) AS ranked FROM season0)"""
)


def season(spark, sf):
    s = periods(spark, sf).groupBy("school", "gender", "season_year").agg(F.when(F.count("*") >= 20, F.avg("stable_level")).alias("value"))
    return trends.season_ranks(s, ["gender", "season_year"], "school", "value")


@add("trend_rank_strength", with_(SEASON, "SELECT school, gender, season_year, value, rank, ranked, CASE WHEN value IS NULL THEN NULL WHEN ranked > 1 THEN 1 - (rank - 1) / (ranked - 1) ELSE 1 END AS strength FROM season", doubles="value strength"))
def _(spark, sf):
    return season(spark, sf)


@add("trend_movement", with_(SEASON, """, m AS (SELECT c.*, p.value AS pv, p.rank AS pr FROM season c LEFT JOIN season p ON c.school = p.school AND c.gender = p.gender AND p.season_year = c.season_year - 1)
    SELECT school, gender, season_year, CASE WHEN value IS NOT NULL AND pv IS NOT NULL THEN 'comparable' WHEN value IS NULL THEN 'no_current' ELSE 'no_previous_season' END AS status,
      value - pv AS value_change, CASE WHEN value IS NOT NULL THEN pr - rank END AS rank_change,
      'rank_' || CASE WHEN pr > rank THEN 'up' WHEN pr < rank THEN 'down' WHEN pr = rank THEN 'flat' END || '_value_' || CASE WHEN value - pv > 1e-9 THEN 'up' WHEN value - pv < -1e-9 THEN 'down' WHEN value IS NOT NULL AND pv IS NOT NULL THEN 'flat' END AS alignment FROM m""", doubles="value_change"))
def _(spark, sf):
    return trends.movement(season(spark, sf), ["school", "gender"], "season_year", "value", "rank").select("school", "gender", "season_year", "status", "value_change", "rank_change", "alignment")


@add("trend_season_comparison", with_(SCOPES, """, s AS (SELECT school, gender, season_year, season_type, avg(signal) AS v FROM sig GROUP BY ALL HAVING count(*) >= 8)
    SELECT coalesce(a.school, b.school) AS school, coalesce(a.gender, b.gender) AS gender, coalesce(a.season_year, b.season_year) AS season_year, a.v AS a_value, b.v AS b_value,
      CASE WHEN a.school IS NULL THEN 'outdoor_only' WHEN b.school IS NULL THEN 'indoor_only' ELSE 'both' END AS status, b.v - a.v AS difference
    FROM (SELECT * FROM s WHERE season_type = 'indoor') a FULL JOIN (SELECT * FROM s WHERE season_type = 'outdoor') b ON a.school = b.school AND a.gender = b.gender AND a.season_year = b.season_year""", doubles="a_value b_value difference"))
def _(spark, sf):
    s = signals(spark, sf).groupBy("school", "gender", "season_year", "season_type").agg(F.avg("signal").alias("v"), F.count("*").alias("n")).where("n >= 8").drop("n")
    return trends.season_comparison(s, ["school", "gender", "season_year"], "season_type", "indoor", "outdoor", "v")


WINDOW_SQL = """SELECT c.school, c.gender, c.season_year, count(h.value) AS years, avg(h.value) AS mean, median(h.value) AS median, stddev_samp(h.value) AS sd, min(h.value) AS low, max(h.value) AS high,
      CASE WHEN count(h.value) >= 3 THEN regr_slope(h.value, h.season_year) END AS slope, count(h.value) / {w} AS coverage, CASE WHEN count(h.value) >= 3 THEN 'trend' WHEN count(h.value) > 0 THEN 'short_history' ELSE 'no_history' END AS status
    FROM season c JOIN season h ON c.school = h.school AND c.gender = h.gender AND h.season_year BETWEEN c.season_year - {w} + 1 AND c.season_year GROUP BY ALL"""


@add("trend_window_3", with_(SEASON, WINDOW_SQL.format(w=3), doubles="mean median sd low high slope coverage"))
def _(spark, sf):
    return trends.window_trend(season(spark, sf), ["school", "gender"], "season_year", "value", 3)


@add("trend_window_5", with_(SEASON, WINDOW_SQL.format(w=5), doubles="mean median sd low high slope coverage"))
def _(spark, sf):
    return trends.window_trend(season(spark, sf), ["school", "gender"], "season_year", "value", 5)


@add("trend_trajectory_classes", with_(SEASON, f""", w5 AS ({WINDOW_SQL.format(w=5)}), w3 AS ({WINDOW_SQL.format(w=3)}),
    t AS (SELECT w5.school, w5.gender, season_year, round(w5.mean, 6) AS mean, round(w5.slope, 6) AS slope, round(w5.sd, 6) AS sd, round(w3.slope, 6) AS short FROM w5 JOIN w3 USING (school, gender, season_year)),
    p AS (SELECT *, CASE WHEN mean IS NOT NULL THEN percent_rank() OVER (PARTITION BY gender, season_year ORDER BY mean NULLS LAST) END AS level_pct, CASE WHEN slope IS NOT NULL THEN percent_rank() OVER (PARTITION BY gender, season_year ORDER BY slope NULLS LAST) END AS slope_pct,
      CASE WHEN sd IS NOT NULL THEN percent_rank() OVER (PARTITION BY gender, season_year ORDER BY sd DESC NULLS LAST) END AS steady_pct FROM t)
    SELECT school, gender, season_year, level_pct, slope_pct, steady_pct, CASE WHEN slope IS NULL OR short IS NULL THEN 'unknown' WHEN slope > 0 AND short > 0 THEN 'rising' WHEN slope < 0 AND short < 0 THEN 'falling' WHEN slope < 0 AND short > 0 THEN 'recovering' WHEN slope > 0 AND short < 0 THEN 'cooling' ELSE 'flat' END AS direction,
      CASE WHEN level_pct >= 0.75 THEN 'first' WHEN level_pct >= 0.5 THEN 'second' WHEN level_pct >= 0.25 THEN 'third' WHEN level_pct IS NOT NULL THEN 'fourth' END AS level_tier FROM p""", doubles="level_pct slope_pct steady_pct"))
def _(spark, sf):
    s = season(spark, sf)
    long = trends.window_trend(s, ["school", "gender"], "season_year", "value", 5)
    short = trends.window_trend(s, ["school", "gender"], "season_year", "value", 3).select("school", "gender", "season_year", F.round("slope", 6).alias("short"))
    t = long.select("school", "gender", "season_year", F.round("mean", 6).alias("mean"), F.round("slope", 6).alias("slope"), F.round("sd", 6).alias("sd")).join(short, ["school", "gender", "season_year"])
    return trends.trajectory_classes(t, ["gender", "season_year"], "mean", "slope", "sd", "short").select("school", "gender", "season_year", "level_pct", "slope_pct", "steady_pct", "direction", "level_tier")


@add("trend_peer_context", with_(SEASON, """, p AS (SELECT *, school % 4 AS peer FROM season WHERE value IS NOT NULL)
    SELECT school, gender, season_year, value - median(value) OVER (PARTITION BY gender, season_year) AS all_difference, value - median(value) OVER (PARTITION BY gender, season_year, peer) AS peer_difference,
      count(value) OVER (PARTITION BY gender, season_year, peer) AS peers, dense_rank() OVER (PARTITION BY gender, season_year ORDER BY round(value, 9) DESC) AS all_rank, dense_rank() OVER (PARTITION BY gender, season_year, peer ORDER BY round(value, 9) DESC) AS peer_rank FROM p""", doubles="all_difference peer_difference"))
def _(spark, sf):
    s = season(spark, sf).where("value is not null").withColumn("peer", F.col("school") % 4)
    return trends.peer_context(s, ["gender", "season_year"], "peer", "school", "value").select("school", "gender", "season_year", "all_difference", "peer_difference", "peers", "all_rank", "peer_rank")


@add("trend_long_metrics", with_(SEASON, "SELECT school, gender, season_year, metric, v AS metric_value FROM (SELECT school, gender, season_year, unnest(['value', 'ranked_d']) AS metric, unnest([value, CAST(ranked AS DOUBLE)]) AS v FROM season)", doubles="metric_value"))
def _(spark, sf):
    return trends.long_metrics(season(spark, sf).withColumn("ranked_d", F.col("ranked").cast("double")), ["school", "gender", "season_year"], ["value", "ranked_d"])


SUMMARY = TRAJ + """,
s AS (SELECT school, count(*) AS n, avg(endpoint) AS level, avg(improvement) AS gain, stddev_samp(improvement) AS sd, max(event_gain) - min(event_gain) AS gap, count(DISTINCT event) / 6.0 AS coverage
  FROM (SELECT *, avg(improvement) OVER (PARTITION BY school, event) AS event_gain FROM traj) GROUP BY school)"""


def summary(spark, sf):
    t = trajectories(spark, sf).withColumn("event_gain", F.avg("improvement").over(W.partitionBy("school", "event")))
    return t.groupBy("school").agg(F.count("*").alias("n"), F.avg("endpoint").alias("level"), F.avg("improvement").alias("gain"), F.stddev_samp("improvement").alias("sd"), (F.max("event_gain") - F.min("event_gain")).alias("gap"), (F.count_distinct("event") / 6.0).alias("coverage"))


def composite_sql(parts: str) -> str:
    return f"SELECT school, {parts} AS score, rank() OVER (ORDER BY round({parts}, 9) DESC NULLS LAST) AS rank FROM (SELECT *, percent_rank() OVER (ORDER BY level NULLS LAST) AS lp, percent_rank() OVER (ORDER BY gain NULLS LAST) AS gp, 1 - percent_rank() OVER (ORDER BY sd NULLS LAST) AS sp FROM s)"


@add("rank_consistency", with_(SUMMARY, composite_sql("0.65 * gp + 0.35 * sp").replace("0.65 * gp + 0.35 * sp AS", "gp * 0.65 + sp * 0.35 AS"), digits=6, doubles="score"))
def _(spark, sf):
    return rankings.composite(summary(spark, sf), [], [("gain", 0.65, False), ("sd", 0.35, True)]).select("school", "score", "rank")


@add("rank_frontier", with_(SUMMARY, composite_sql("gp * 0.5 + lp * 0.5"), digits=6, doubles="score"))
def _(spark, sf):
    return rankings.composite(summary(spark, sf), [], [("gain", 0.5, False), ("level", 0.5, False)]).select("school", "score", "rank")


@add("rank_robustness", with_(SUMMARY, composite_sql("gp * 0.7 + sp * 0.3"), digits=6, doubles="score"))
def _(spark, sf):
    return rankings.composite(summary(spark, sf), [], [("gain", 0.7, False), ("sd", 0.3, True)]).select("school", "score", "rank")


@add("rank_balanced", with_(SUMMARY, "SELECT school, gain - 0.20 * coalesce(sd, 0) - 0.10 * coalesce(gap, 0) - 0.05 * (1 - coverage) AS score FROM s", digits=6, doubles="score"))
def _(spark, sf):
    return summary(spark, sf).select("school", rankings.balanced_score(F.col("gain"), F.col("sd"), F.col("gap"), F.col("coverage")).alias("score"))


@add("rank_baseline_tiers", with_(TRAJ, "SELECT CASE WHEN b < 50 THEN 'under_50' WHEN b < 65 THEN '50_65' WHEN b < 80 THEN '65_80' ELSE '80_up' END AS tier, school, count(*) AS n, avg(improvement) AS mean FROM (SELECT *, round(baseline, 6) AS b FROM traj) GROUP BY ALL", digits=6, doubles="mean"))
def _(spark, sf):
    t = trajectories(spark, sf)
    return t.groupBy(rankings.baseline_tier(F.round("baseline", 6)).alias("tier"), "school").agg(F.count("*").alias("n"), F.avg("improvement").alias("mean"))


@add("rank_breakout", with_(TRAJ, "SELECT school, count(*) AS n, CAST(sum(CASE WHEN round(improvement, 6) >= 5 THEN 1 ELSE 0 END) AS BIGINT) AS breakouts, avg(CASE WHEN round(improvement, 6) >= 5 THEN 1.0 ELSE 0.0 END) AS rate FROM traj GROUP BY school", digits=6, doubles="rate"))
def _(spark, sf):
    hit = F.round("improvement", 6) >= 5
    return trajectories(spark, sf).groupBy("school").agg(F.count("*").alias("n"), F.sum(hit.cast("long")).alias("breakouts"), exprs.share(hit).alias("rate"))


@add("rank_efficiency", with_(TRAJ, "SELECT school, sum(improvement) / nullif(sum(elapsed), 0) AS per_year FROM traj GROUP BY school", digits=6, doubles="per_year"))
def _(spark, sf):
    return trajectories(spark, sf).groupBy("school").agg(exprs.safe_div(F.sum("improvement"), F.sum("elapsed")).alias("per_year"))


@add("rank_transfers_in", with_(PERIODS, """, e AS (SELECT person, event, min(season_year) AS since, avg(stable_level) AS v FROM periods GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY since, event) AS spell FROM e)
    SELECT event, count(*) AS arrivals, avg(v) AS mean_value FROM o WHERE spell > 1 GROUP BY event""", digits=6, doubles="mean_value"))
def _(spark, sf):
    return rankings.transfers_in(periods(spark, sf), "person", "event", "season_year", "stable_level")


QUERIES, ORACLES = Q, O
