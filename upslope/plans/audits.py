"""Audits, remaining rankings, similarity, record pages and rewrites on the shared tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from upslope.functions import exprs
from upslope.functions.similarity import add_similarity
from upslope.operators import stats
from upslope.plans._base import TRAJ, rounded, table, trajectories, with_
from upslope.scratch import new_path
from upslope.sources import catalog, pages, resume

Q, O = {}, {}


def add(name, sql=None, digits=6):
    def register(f):
        Q[name] = lambda spark, sf: rounded(f(spark, sf), digits)
        if sql:
            O[name] = sql
        return f

    return register


@add(
    "rank_endpoint_90",
    with_(
        TRAJ,
        """, c AS (SELECT school, CAST(sum(CASE WHEN round(endpoint, 6) >= 90 THEN 1 ELSE 0 END) AS BIGINT) AS k, count(*) AS n FROM traj GROUP BY school),
        p AS (SELECT *, sum(k) OVER () / sum(n) OVER () AS prior FROM c)
        SELECT school, k, n, (k + prior * 30) / (n + 30) AS rate, rank() OVER (ORDER BY round((k + prior * 30) / (n + 30), 9) DESC) AS rank FROM p""",
        digits=6,
        doubles="rate",
    ),
)
def _(spark, sf):
    r = stats.beta_binomial(trajectories(spark, sf), "school", F.round("endpoint", 6) >= 90, 30.0)
    return r.select("school", "k", "n", "rate", F.rank().over(W.orderBy(F.round("rate", 9).desc())).cast("long").alias("rank"))


@add(
    "audit_sample_thresholds",
    with_(
        TRAJ,
        """, s AS (SELECT school, count(*) AS n, avg(improvement) AS mean FROM traj GROUP BY school), x AS (SELECT threshold, s.* FROM s CROSS JOIN (VALUES (200), (330), (350)) v(threshold) WHERE n >= threshold),
        r AS (SELECT *, rank() OVER (PARTITION BY threshold ORDER BY round(mean, 9) DESC) AS rk, rank() OVER (PARTITION BY threshold ORDER BY n DESC) AS size_rank FROM x)
        SELECT threshold, count(*) AS schools, CASE WHEN isfinite(corr(rk, size_rank)) THEN corr(rk, size_rank) END AS size_corr FROM r GROUP BY threshold""",
        digits=6,
        doubles="size_corr",
    ),
)
def _(spark, sf):
    s = trajectories(spark, sf).groupBy("school").agg(F.count("*").alias("n"), F.avg("improvement").alias("mean"))
    x = s.withColumn("threshold", F.explode(F.array(*map(F.lit, (200, 330, 350))))).where("n >= threshold")
    w = W.partitionBy("threshold")
    x = x.withColumn("rk", F.rank().over(w.orderBy(F.round("mean", 9).desc())).cast("double")).withColumn("size_rank", F.rank().over(w.orderBy(F.desc("n"))).cast("double"))
    return x.groupBy("threshold").agg(F.count("*").alias("schools"), exprs.safe_corr("rk", "size_rank").alias("size_corr"))


@add(
    "audit_influence",
    with_(
        TRAJ,
        """, p AS (SELECT school, person, sum(improvement) AS s, count(*) AS n FROM traj GROUP BY ALL), t AS (SELECT *, sum(s) OVER w AS ts, sum(n) OVER w AS tn FROM p WINDOW w AS (PARTITION BY school)),
        i AS (SELECT school, ts / tn - (ts - s) / nullif(tn - n, 0) AS shift FROM t)
        SELECT school, max(abs(shift)) AS largest, quantile_cont(abs(shift), 0.9) AS p90 FROM i GROUP BY school""",
        digits=6,
        doubles="largest p90",
    ),
)
def _(spark, sf):
    p = trajectories(spark, sf).groupBy("school", "person").agg(F.sum("improvement").alias("s"), F.count("*").alias("n"))
    w = W.partitionBy("school")
    t = p.withColumn("ts", F.sum("s").over(w)).withColumn("tn", F.sum("n").over(w))
    shift = F.abs(F.col("ts") / F.col("tn") - exprs.safe_div(F.col("ts") - F.col("s"), F.col("tn") - F.col("n")))
    return t.select("school", shift.alias("shift")).groupBy("school").agg(F.max("shift").alias("largest"), F.percentile("shift", F.lit(0.9)).alias("p90"))


@add(
    "audit_band_monotonicity",
    with_(
        TRAJ,
        """, b AS (SELECT CAST(least(20, greatest(1, floor(round(baseline, 9) / 5) + 1)) AS INTEGER) AS band, count(*) AS n, avg(CASE WHEN improvement > 0 THEN 1.0 ELSE 0.0 END) AS rate FROM traj GROUP BY 1)
        SELECT band, n, rate, rate - lag(rate) OVER (ORDER BY band) AS step, rate <= lag(rate) OVER (ORDER BY band) AS falls FROM b""",
        digits=6,
        doubles="rate step",
    ),
)
def _(spark, sf):
    b = trajectories(spark, sf).groupBy(exprs.band(F.round("baseline", 9)).alias("band")).agg(F.count("*").alias("n"), exprs.share(F.col("improvement") > 0).alias("rate"))
    w = W.orderBy("band")
    return b.withColumn("step", F.col("rate") - F.lag("rate").over(w)).withColumn("falls", F.col("rate") <= F.lag("rate").over(w))


@add(
    "audit_matched_bands",
    with_(
        TRAJ,
        """, t AS (SELECT event, elapsed, CASE WHEN round(baseline, 6) >= 30 THEN 'high' WHEN round(baseline, 6) BETWEEN 15 AND 25 THEN 'low' END AS side, improvement FROM traj),
        c AS (SELECT event, elapsed, avg(improvement) FILTER (WHERE side = 'high') AS high, avg(improvement) FILTER (WHERE side = 'low') AS low, count(*) FILTER (WHERE side = 'high') AS nh, count(*) FILTER (WHERE side = 'low') AS nl FROM t GROUP BY ALL)
        SELECT event, elapsed, high, low, high > low AS favours_high FROM c WHERE nh >= 5 AND nl >= 5""",
        digits=6,
        doubles="high low",
    ),
)
def _(spark, sf):
    b = F.round("baseline", 6)
    high, low = b >= 30, b.between(15, 25)
    c = trajectories(spark, sf).groupBy("event", "elapsed").agg(F.avg(F.when(high, F.col("improvement"))).alias("high"), F.avg(F.when(low, F.col("improvement"))).alias("low"), F.sum(high.cast("long")).alias("nh"), F.sum(low.cast("long")).alias("nl"))
    return c.where("nh >= 5 and nl >= 5").select("event", "elapsed", "high", "low", (F.col("high") > F.col("low")).alias("favours_high"))


@add("parse_name_similarity")
def _(spark, sf):
    a = table(spark, sf, "nation").select(F.col("n_name").alias("a"), "n_regionkey")
    return add_similarity(a.join(a.withColumnRenamed("a", "b"), "n_regionkey"), "a", "b")


@add("source_record_pages", "SELECT page_id, 0::INTEGER AS row_index, 'Long Jump' AS event, '7.45m' AS mark, 'Holder ' || page_id AS holder, 'School' AS school, 'May 1, 2001' AS record_date FROM pages")
def _(spark, sf):
    plain = F.concat(F.lit("<pre>Long Jump:\n7.45m  Holder "), "page_id", F.lit(", School  May 1, 2001</pre>"))
    rows = F.concat(F.lit("<table><tr><th>Event<th>Mark<th>Holder<tr><td>Long Jump<td>7.45m<td>Holder "), "page_id", F.lit("<td>School<td>May 1, 2001</table>"))
    p = table(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, rows).otherwise(plain).alias("html"))
    return pages.parse_record_pages(p)


@add("source_resumable_parse", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def _(spark, sf):
    c, p = catalog.Catalog(spark, new_path(spark, "resume")), table(spark, sf, "pages")
    parse = lambda df: pages.page_fields(df).select("page_id", "title")
    resume.process_in_chunks(c, "raw", "titles", p.where("page_id % 3 = 0"), "page_id", parse, 2)
    resume.process_in_chunks(c, "raw", "titles", p, "page_id", parse, 3)
    return c.read("raw", "titles")


@add("pub_rewrite", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_nationkey <> 3")
def _(spark, sf):
    c = catalog.Catalog(spark, new_path(spark, "rewrite"))
    c.publish("core", "supplier", table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"))
    change = lambda df: df.where("s_nationkey <> 3").withColumn("s_acctbal", F.greatest("s_acctbal", F.lit(0.0))).drop("s_nationkey")
    return resume.rewrite(c, "core", "supplier", change)


QUERIES, ORACLES = Q, O
