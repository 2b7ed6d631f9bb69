"""Role mapping of the shared test tables and the common part of the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upslope.operators import levels


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, so that the order of floating-point sums does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def performances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer is a person, its nation the school, part types are events, market segments genders, orders meets."""
    line, order = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    part, customer = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    joined = line.join(order, line.l_orderkey == order.o_orderkey).join(part, line.l_partkey == part.p_partkey).join(customer, order.o_custkey == customer.c_custkey)
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
        F.col("o_custkey").alias("person"),
        F.col("c_nationkey").alias("school"),
        F.col("p_type").alias("event"),
        F.col("p_brand").alias("brand"),
        F.col("c_mktsegment").alias("gender"),
        F.year("o_orderdate").alias("season_year"),
        F.when(F.month("o_orderdate") <= 6, "indoor").otherwise("outdoor").alias("season_type"),
        F.col("o_orderkey").alias("meet"),
        F.to_date("o_orderdate").alias("perf_date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("value"),
    )


def levelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Performances with ratio and level against the best of their event."""
    perf = performances(spark, sf_dir)
    anchors = perf.groupBy("event").agg(F.max("value").alias("anchor"))
    out = perf.join(anchors, "event").withColumn("ratio", F.col("value") / F.col("anchor"))
    return out.withColumn("level", levels.performance_level(F.col("value"), F.col("anchor"), F.lit(False)))


def meet_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.meet_best(levelled(spark, sf_dir), ["person", "school", "gender", "event", "season_year"], "meet", "perf_date", "level", "ratio", "row_id")


def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.stable_level(meet_levels(spark, sf_dir), ["person", "school", "gender", "event", "season_year"], "level", "meet_key")


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.trajectories(periods(spark, sf_dir), ["person", "school", "gender", "event"], "season_year", "stable_level")


PERF = """perf AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id, o_custkey AS person, c_nationkey AS school,
         p_type AS event, p_brand AS brand, c_mktsegment AS gender, CAST(year(o_orderdate) AS INTEGER) AS season_year,
         CASE WHEN month(o_orderdate) <= 6 THEN 'indoor' ELSE 'outdoor' END AS season_type, o_orderkey AS meet,
         CAST(o_orderdate AS DATE) AS perf_date, l_extendedprice / l_quantity AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey)"""
LEVELS = (
    PERF
    + """,
anchors AS (SELECT event, max(value) AS anchor FROM perf GROUP BY event),
levels AS (SELECT perf.*, anchor, value / anchor AS ratio, 100 * power(least(1.0, greatest(0.0, value / anchor)), 2) AS level
  FROM perf JOIN anchors USING (event))"""
)
MEETS = (
    LEVELS
    + """,
meets AS (SELECT * FROM (
  SELECT *, concat(CAST(perf_date AS VARCHAR), '|', CAST(meet AS VARCHAR)) AS meet_key,
    count(*) OVER (PARTITION BY person, school, gender, event, season_year, perf_date, meet) AS source_rows,
    row_number() OVER (PARTITION BY person, school, gender, event, season_year, perf_date, meet ORDER BY level DESC, ratio DESC, row_id) AS rn
  FROM levels) WHERE rn = 1)"""
)
PERIODS = (
    MEETS
    + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY person, school, gender, event, season_year ORDER BY level DESC, meet_key) AS r FROM meets),
periods AS (SELECT person, school, gender, event, season_year, avg(level) FILTER (WHERE r <= 3) AS stable_level, max(level) AS best_level,
    avg(level) FILTER (WHERE r <= 2) AS best_two_level, median(level) AS median_level, stddev_samp(level) AS sd_level,
    max(level) - min(level) AS span_level, count(*) AS n_meets,
    CASE WHEN count(*) >= 5 THEN 'high' WHEN count(*) >= 3 THEN 'standard' WHEN count(*) = 2 THEN 'provisional' ELSE 'single' END AS tier
  FROM ranked GROUP BY ALL)"""
)
TRAJ = (
    PERIODS
    + """,
traj0 AS (SELECT person, school, gender, event, count(*) AS n_periods, min(season_year) AS first_time, max(season_year) AS last_time,
    arg_min(stable_level, season_year) AS baseline, arg_max(stable_level, season_year) AS endpoint, max(stable_level) AS peak,
    regr_slope(stable_level, season_year) AS slope FROM periods GROUP BY ALL HAVING count(*) >= 2),
peaks AS (SELECT p.person, p.event, min(season_year) AS peak_time FROM periods p JOIN traj0 t ON p.person = t.person AND p.event = t.event AND p.stable_level = t.peak GROUP BY ALL),
traj AS (SELECT traj0.*, peak_time, last_time - first_time AS elapsed, endpoint - baseline AS improvement,
    (endpoint - baseline) / (last_time - first_time) AS annualised,
    CASE WHEN endpoint - baseline > 1e-12 THEN 'improved' WHEN endpoint - baseline < -1e-12 THEN 'declined' ELSE 'unchanged' END AS direction
  FROM traj0 JOIN peaks USING (person, event))"""
)


def with_(ctes: str, select: str, digits: int = 4, doubles: str = "") -> str:
    """A SELECT over common tables; ``select`` may start with more tables, and the columns in ``doubles`` are rounded."""
    depth = start = 0
    for i, c in enumerate(select):
        depth += (c == "(") - (c == ")")
        if depth == 0 and select.startswith("SELECT", i):
            start = i
            break
    names = doubles.split()
    outer = "*" if not names else "* REPLACE (" + ", ".join(f"round({c}, {digits}) AS {c}" for c in names) + ")"
    return f"WITH {ctes}{select[:start]}, outcome AS ({select[start:]}) SELECT {outer} FROM outcome"
