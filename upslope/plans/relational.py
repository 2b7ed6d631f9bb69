"""The relational surface: scans, projections, joins, aggregates, windows, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from upslope.functions import exprs
from upslope.operators import checks, windows
from upslope.operators.joins import null_safe_join
from upslope.plans._base import rounded, table

Q, O = {}, {}


def add(name, sql=None):
    def register(f):
        Q[name] = lambda spark, sf: rounded(f(spark, sf))
        if sql:
            O[name] = sql
        return f

    return register


def views(spark, sf, *names):
    for n in names:
        table(spark, sf, n).createOrReplaceTempView(n)
    return spark


@add("rel_filter_project", "SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') AND l_linestatus NOT IN ('F')".replace("l_extendedprice * (1 - l_discount)", "round(l_extendedprice * (1 - l_discount), 4)"))
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    x = li.where((F.col("l_shipdate") >= "1998-01-01") & F.col("l_quantity").between(10, 20) & F.col("l_returnflag").isin("A", "R") & ~F.col("l_linestatus").isin("F"))
    return x.select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


@add("rel_case_ladder", "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class, CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'PROMO' THEN 2 ELSE 0 END AS code, count(*) AS n FROM part GROUP BY ALL")
def _(spark, sf):
    s = F.col("p_size")
    return table(spark, sf, "part").groupBy(F.when(s < 10, "small").when(s < 30, "medium").otherwise("large").alias("size_class"), F.expr("CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'PROMO' THEN 2 ELSE 0 END").alias("code")).agg(F.count("*").alias("n"))


@add("rel_lateral_alias", "SELECT o_orderkey, round(o_totalprice / 2, 4) AS half, round(o_totalprice / 4, 4) AS quarter FROM orders")
def _(spark, sf):
    return views(spark, sf, "orders").sql("SELECT o_orderkey, o_totalprice / 2 AS half, half / 2 AS quarter FROM orders")


@add("rel_except_columns", "SELECT * EXCLUDE (c_name, c_acctbal) FROM customer")
def _(spark, sf):
    return views(spark, sf, "customer").sql("SELECT * EXCEPT (c_name, c_acctbal) FROM customer")


@add("rel_like_parameters", "SELECT p_partkey, p_brand FROM part WHERE p_name LIKE '%w_dg%' AND p_size >= 25")
def _(spark, sf):
    return views(spark, sf, "part").sql("SELECT p_partkey, p_brand FROM part WHERE p_name LIKE ? AND p_size >= ?", args=["%w_dg%", 25])


@add("rel_null_safe_join", "SELECT count(*) AS n, count(a.k) AS with_key FROM (SELECT nullif(c_nationkey, 3) AS k, c_custkey FROM customer) a JOIN (SELECT nullif(n_nationkey, 3) AS k FROM nation) b ON a.k IS NOT DISTINCT FROM b.k")
def _(spark, sf):
    a = table(spark, sf, "customer").select(F.nullif("c_nationkey", F.lit(3)).alias("k"))
    b = table(spark, sf, "nation").select(F.nullif("n_nationkey", F.lit(3)).alias("k2"))
    return a.join(b, F.col("k").eqNullSafe(F.col("k2"))).agg(F.count("*").alias("n"), F.count("k").alias("with_key"))


@add("rel_star_join", "SELECT r_name, n_name, round(sum(l_extendedprice), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def _(spark, sf):
    t = lambda n: table(spark, sf, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.count_distinct("o_orderkey").alias("orders"))


@add("rel_left_join", "SELECT s_suppkey, count(l_orderkey) AS lines FROM supplier LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 49) ON s_suppkey = l_suppkey GROUP BY ALL")
def _(spark, sf):
    li = table(spark, sf, "lineitem").where("l_quantity > 49")
    return table(spark, sf, "supplier").join(li, F.col("s_suppkey") == F.col("l_suppkey"), "left").groupBy("s_suppkey").agg(F.count("l_orderkey").alias("lines"))


@add("rel_full_join", "SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey < 18 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 6 GROUP BY 1) b ON a.k = b.k")
def _(spark, sf):
    a = table(spark, sf, "customer").where("c_nationkey < 18").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = table(spark, sf, "supplier").where("s_nationkey > 6").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "k", "full")


@add("rel_anti_join", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(spark, sf):
    return checks.orphans(table(spark, sf, "orders"), table(spark, sf, "lineitem"), "o_orderkey", "l_orderkey").select("o_orderkey")


@add("rel_correlated_exists", "SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 100 DAY) AS late FROM orders")
def _(spark, sf):
    return views(spark, sf, "orders", "lineitem").sql("SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 100 DAY) AS late FROM orders")


@add("rel_scalar_subquery", "SELECT c_custkey, round(c_acctbal - (SELECT avg(c_acctbal) FROM customer), 4) AS above FROM customer")
def _(spark, sf):
    return views(spark, sf, "customer").sql("SELECT c_custkey, c_acctbal - (SELECT avg(c_acctbal) FROM customer) AS above FROM customer")


@add("rel_scenario_expand", "SELECT threshold, count(*) AS n FROM part CROSS JOIN (VALUES (10), (20), (30)) v(threshold) WHERE p_size >= threshold GROUP BY threshold")
def _(spark, sf):
    x = table(spark, sf, "part").withColumn("threshold", F.explode(F.array(*map(F.lit, (10, 20, 30)))))
    return x.where("p_size >= threshold").groupBy("threshold").agg(F.count("*").alias("n"))


@add("rel_triangular_self_join", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def _(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    a, b = s.alias("a"), s.alias("b")
    return a.join(b, (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.s_suppkey") < F.col("b.s_suppkey"))).select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"))


YEARLY = "yearly AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS y, sum(o_totalprice) AS total FROM orders GROUP BY ALL)"


def _yearly(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("total"))


@add("rel_range_self_join", f"WITH {YEARLY} SELECT c.o_custkey, c.y, count(*) AS years, round(avg(h.total), 4) AS mean FROM yearly c JOIN yearly h ON c.o_custkey = h.o_custkey AND h.y BETWEEN c.y - 2 AND c.y GROUP BY ALL")
def _(spark, sf):
    return windows.calendar_window(_yearly(spark, sf), ["o_custkey"], "y", 3, [F.count("*").alias("years"), F.avg("total").alias("mean")])


@add("rel_previous_year_join", f"WITH {YEARLY} SELECT c.o_custkey, c.y, round(p.total, 4) AS previous FROM yearly c LEFT JOIN yearly p ON c.o_custkey = p.o_custkey AND p.y = c.y - 1")
def _(spark, sf):
    return windows.previous_period(_yearly(spark, sf), ["o_custkey"], "y", ["total"]).select("o_custkey", "y", F.col("previous_total").alias("previous"))


@add("rel_lateral_values", "SELECT p_partkey, metric, round(v, 4) AS v FROM (SELECT p_partkey, unnest(['size', 'price']) AS metric, unnest([CAST(p_size AS DOUBLE), p_retailprice]) AS v FROM part)")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.expr("stack(2, 'size', cast(p_size as double), 'price', p_retailprice) AS (metric, v)"))


@add("rel_aggregates", """SELECT l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, sum(l_linenumber)::BIGINT AS line_sum, round(avg(l_quantity), 4) AS mean_qty, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship,
  count(*) FILTER (WHERE l_discount > 0.05) AS discounted, count(DISTINCT l_suppkey) FILTER (WHERE l_quantity > 49) AS big_suppliers, round(stddev_samp(l_tax), 6) AS sd, round(stddev_pop(l_tax), 6) AS sdp, round(var_samp(l_quantity), 4) AS var,
  round(median(l_extendedprice), 4) AS median, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, bool_or(l_quantity = 50) AS any_50, bool_and(l_quantity > 0) AS all_positive FROM lineitem GROUP BY l_returnflag HAVING count(*) > 10""")
def _(spark, sf):
    # distinct suppliers by a pre-aggregation of their own: beside other aggregates they would expand every row
    q, li = F.col("l_quantity"), table(spark, sf, "lineitem")
    held = li.where("l_suppkey is not null").groupBy("l_returnflag", "l_suppkey").agg(F.max(F.coalesce(q > 49, F.lit(False))).alias("big"))
    held = held.groupBy("l_returnflag").agg(F.count("*").alias("suppliers"), F.count_if("big").alias("big_suppliers"))
    rest = li.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.sum("l_linenumber").alias("line_sum"), F.avg(q).alias("mean_qty"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"),
        F.expr("count(*) FILTER (WHERE l_discount > 0.05)").alias("discounted"),
        F.round(F.stddev_samp("l_tax"), 6).alias("sd"), F.round(F.stddev_pop("l_tax"), 6).alias("sdp"), F.var_samp(q).alias("var"), F.median("l_extendedprice").alias("median"), F.percentile("l_extendedprice", F.lit(0.9)).alias("p90"),
        F.bool_or(q == 50).alias("any_50"), F.bool_and(q > 0).alias("all_positive"),
    ).where("n > 10")
    return null_safe_join(rest, held, ["l_returnflag"], "left").fillna(0, ["suppliers", "big_suppliers"])


O["rel_aggregates"] = O["rel_aggregates"].replace("round(stddev_samp(l_tax), 6)", "round(stddev_samp(l_tax), 4)").replace("round(stddev_pop(l_tax), 6)", "round(stddev_pop(l_tax), 4)")


@add("rel_distinct_rows", "SELECT count(DISTINCT (nullif(l_linenumber, 3), l_returnflag)) AS row_values, count(DISTINCT l_returnflag || '|' || l_linestatus) AS joined FROM lineitem")
def _(spark, sf):
    return views(spark, sf, "lineitem").sql("SELECT count(DISTINCT struct(nullif(l_linenumber, 3), l_returnflag)) AS row_values, count(DISTINCT l_returnflag || '|' || l_linestatus) AS joined FROM lineitem")


@add("rel_any_value", "SELECT l_orderkey, min(l_returnflag) FILTER (WHERE l_returnflag <> 'N') AS flag FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT nullif(l_returnflag, 'N')) <= 1")
def _(spark, sf):
    x = table(spark, sf, "lineitem").withColumn("f", F.nullif("l_returnflag", F.lit("N")))
    return x.groupBy("l_orderkey").agg(exprs.any_nonnull("f").alias("flag"), F.count_distinct("f").alias("k")).where("k <= 1").select("l_orderkey", "flag")


@add("rel_arg_extremes", "SELECT o_custkey, arg_max(o_orderpriority, (o_totalprice, -o_orderkey)) AS at_max, arg_min(o_orderpriority, (o_totalprice, o_orderkey)) AS at_min FROM orders GROUP BY ALL")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(exprs.arg_max("o_orderpriority", "o_totalprice", "o_orderkey").alias("at_max"), exprs.arg_min("o_orderpriority", "o_totalprice", "o_orderkey").alias("at_min"))


@add("rel_regression", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(corr(l_extendedprice, l_quantity), 4) AS r FROM lineitem GROUP BY 1 UNION ALL SELECT 'one', NULL, NULL, NULL")
def _(spark, sf):
    a = [F.regr_slope("l_extendedprice", "l_quantity").alias("slope"), F.regr_intercept("l_extendedprice", "l_quantity").alias("intercept"), exprs.safe_corr("l_extendedprice", "l_quantity").alias("r")]
    li = table(spark, sf, "lineitem")
    single = li.orderBy("l_orderkey", "l_linenumber", "l_partkey").limit(1)
    return li.groupBy("l_returnflag").agg(*a).union(single.groupBy(F.lit("one")).agg(*a))


@add("rel_string_agg", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names, string_agg(DISTINCT substr(n_name, 1, 8), ',' ORDER BY substr(n_name, 1, 8)) AS heads FROM nation GROUP BY 1")
def _(spark, sf):
    return views(spark, sf, "nation").sql("SELECT n_regionkey, listagg(n_name, '|') WITHIN GROUP (ORDER BY n_name) AS names, listagg(DISTINCT substr(n_name, 1, 8), ',') WITHIN GROUP (ORDER BY substr(n_name, 1, 8)) AS heads FROM nation GROUP BY 1")


@add("rel_pivot", "SELECT l_returnflag, max(l_extendedprice) FILTER (WHERE l_linestatus = 'O') AS \"O\", max(l_extendedprice) FILTER (WHERE l_linestatus = 'F') AS \"F\" FROM lineitem GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.max("l_extendedprice"))


@add("rel_rates_weighted_mean", "SELECT l_shipmode_, round(avg(CAST(l_discount > 0.05 AS INT)), 4) AS rate, round(sum(l_discount * l_quantity) / sum(l_quantity), 4) AS weighted FROM (SELECT *, l_linestatus AS l_shipmode_ FROM lineitem) GROUP BY 1".replace("l_shipmode_", "st"))
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("st")).agg(exprs.share(F.col("l_discount") > 0.05).alias("rate"), exprs.weighted_mean("l_discount", "l_quantity").alias("weighted"))


@add("rel_approximate", None)
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_extendedprice", 0.5).alias("median"))


@add("rel_top1_dedup", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def _(spark, sf):
    return windows.top1(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@add("rel_top_k", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def _(spark, sf):
    return windows.top_k(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@add("rel_ranks", """SELECT p_partkey, rank() OVER w AS rk, dense_rank() OVER w AS dr, round(percent_rank() OVER w, 4) AS pr, round(1 - percent_rank() OVER w, 4) AS inv, round(cume_dist() OVER w, 4) AS cd, ntile(10) OVER (PARTITION BY p_type ORDER BY p_size, p_partkey) AS nt
  FROM part WINDOW w AS (PARTITION BY p_type ORDER BY nullif(p_size, 7) ASC NULLS LAST)""")
def _(spark, sf):
    w = W.partitionBy("p_type").orderBy(F.nullif("p_size", F.lit(7)).asc_nulls_last())
    return table(spark, sf, "part").select("p_partkey", F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr"), F.percent_rank().over(w).alias("pr"), (1 - F.percent_rank().over(w)).alias("inv"), F.cume_dist().over(w).alias("cd"), F.ntile(10).over(W.partitionBy("p_type").orderBy("p_size", "p_partkey")).alias("nt"))


@add("rel_lag_lead", """SELECT o_orderkey, lag(o_orderkey) OVER w AS prev, lead(o_orderkey) OVER w AS nxt, first_value(o_orderkey) OVER w AS fst, round(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS run, count(*) OVER (PARTITION BY o_custkey) AS n,
  count(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey) AS kinds FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def _(spark, sf):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("prev"), F.lead("o_orderkey").over(w).alias("nxt"), F.first("o_orderkey").over(w).alias("fst"), F.round(F.sum("o_totalprice").over(w.rowsBetween(W.unboundedPreceding, 0)), 2).alias("run"), F.count("*").over(W.partitionBy("o_custkey")).alias("n"), windows.distinct_over("o_orderpriority", ["o_custkey"]).alias("kinds"))


@add("rel_order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100")
def _(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@add("rel_order_by_all", "SELECT o_orderpriority, n FROM (SELECT o_orderpriority, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL) ORDER BY ALL LIMIT 20")
def _(spark, sf):
    return views(spark, sf, "orders").sql("SELECT o_orderpriority, n FROM (SELECT o_orderpriority, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL) ORDER BY ALL LIMIT 20")


@add("rel_group_by_all", "SELECT l_returnflag, l_linestatus, year(l_shipdate)::INTEGER AS y, count(*) AS n, sum(l_linenumber)::BIGINT AS line_sum FROM lineitem GROUP BY ALL")
def _(spark, sf):
    return views(spark, sf, "lineitem").sql("SELECT l_returnflag, l_linestatus, year(l_shipdate) AS y, count(*) AS n, sum(l_linenumber) AS line_sum FROM lineitem GROUP BY ALL")


@add("rel_set_operations", """SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'union_all', count(*) FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier)
  UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000) UNION ALL SELECT 'except_all', count(*) FROM (SELECT l_returnflag, l_linenumber FROM lineitem EXCEPT ALL SELECT l_returnflag, l_linenumber FROM lineitem WHERE l_quantity > 10) UNION ALL SELECT 'distinct', count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)""")
def _(spark, sf):
    c, s, li, o = (table(spark, sf, n) for n in ("customer", "supplier", "lineitem", "orders"))
    k = li.select("l_returnflag", "l_linenumber")
    frames = {
        "union": c.select("c_nationkey").union(s.select("s_nationkey")).distinct(),
        "union_all": c.select("c_nationkey").union(s.select("s_nationkey")),
        "except": c.select("c_custkey").subtract(o.where("o_totalprice > 400000").select("o_custkey")),
        "except_all": k.exceptAll(li.where("l_quantity > 10").select(*k.columns)),
        "distinct": li.select("l_partkey", "l_suppkey").dropDuplicates(),
    }
    out = None
    for name, f in frames.items():
        row = f.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


@add("rel_union_missing_columns", "SELECT c_nationkey AS k, c_mktsegment AS seg, NULL::DOUBLE AS bal FROM customer UNION ALL SELECT s_nationkey, NULL, s_acctbal FROM supplier")
def _(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("seg"))
    return a.unionByName(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("bal")), allowMissingColumns=True)


@add("rel_scalar_math", "SELECT p_partkey, abs(p_size - 25) AS a, round(sqrt(p_size), 4) AS s, round(power(p_size, 1.5), 4) AS p, floor(p_retailprice / 7)::BIGINT AS f, p_partkey % 7 AS m, greatest(p_size, 20) AS g, least(nullif(p_size, 5), 20) AS l, round(p_retailprice / nullif(p_size - 10, 0), 4) AS d, TRY_CAST(CASE WHEN p_size > 25 THEN 'x' ELSE '12' END AS INTEGER) AS t FROM part")
def _(spark, sf):
    s = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", F.abs(s - 25).alias("a"), F.sqrt(s).alias("s"), F.pow(s, 1.5).alias("p"), F.floor(F.col("p_retailprice") / 7).alias("f"), (F.col("p_partkey") % 7).alias("m"), F.greatest(s, F.lit(20)).alias("g"), F.least(F.nullif(s, F.lit(5)), F.lit(20)).alias("l"), exprs.safe_div("p_retailprice", s - 10).alias("d"), F.expr("try_cast(CASE WHEN p_size > 25 THEN 'x' ELSE '12' END AS INT)").alias("t"))


@add("rel_scalar_strings", r"SELECT n_nationkey, lower(n_name) AS l, upper(n_name) AS u, length(trim(' ' || n_name || ' ')) AS n, replace(n_name, 'NATION', 'N') AS r, split_part(n_name, '_', 2) AS sp, position('_' IN n_name) AS pos, starts_with(n_name, 'NATION_1') AS sw, concat_ws(chr(31), n_name, NULL, 'x') AS cw, regexp_matches(n_name, '_1') AS m, regexp_full_match(n_name, 'NATION_[0-9]') AS fm, regexp_extract(n_name, '([A-Z]+)_', 1) AS ex, regexp_replace(n_name, '[AO]', '-', 'g') AS rr, md5(n_name) AS h, sha256(n_name) AS h2 FROM nation")
def _(spark, sf):
    n = F.col("n_name")
    return table(spark, sf, "nation").select(
        "n_nationkey", F.lower(n).alias("l"), F.upper(n).alias("u"), F.length(F.trim(F.concat(F.lit(" "), n, F.lit(" ")))).alias("n"), F.replace(n, F.lit("NATION"), F.lit("N")).alias("r"), F.split_part(n, F.lit("_"), F.lit(2)).alias("sp"),
        F.position(F.lit("_"), n).alias("pos"), n.startswith("NATION_1").alias("sw"), F.concat_ws("\x1f", n, F.lit(None).cast("string"), F.lit("x")).alias("cw"), n.rlike("_1").alias("m"), n.rlike("^NATION_[0-9]$").alias("fm"),
        F.regexp_extract(n, "([A-Z]+)_", 1).alias("ex"), F.regexp_replace(n, "[AO]", "-").alias("rr"), F.md5(n).alias("h"), F.sha2(n, 256).alias("h2"),
    )


@add("rel_scalar_dates", "SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS days, CAST(o_orderdate AS DATE) AS d, CAST(2 * year(o_orderdate) + CASE WHEN month(o_orderdate) > 6 THEN 1 ELSE 0 END AS INTEGER) AS season_order FROM orders")
def _(spark, sf):
    d = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", F.datediff(F.lit("2002-01-01").cast("date"), d).alias("days"), d.alias("d"), (2 * F.year(d) + F.when(F.month(d) > 6, 1).otherwise(0)).alias("season_order"))


@add("rel_hash_ids", "SELECT l_orderkey, 'traj_' || md5(concat_ws('|', l_orderkey, l_partkey)) AS traj_id, substr(sha256(concat_ws(chr(31), CAST(l_orderkey AS VARCHAR), l_returnflag)), 1, 32) AS rec_id FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", exprs.stable_id("traj_", "l_orderkey", "l_partkey").alias("traj_id"), exprs.record_id("l_orderkey", "l_returnflag").alias("rec_id"))


@add("rel_finite", "SELECT count(*) FILTER (WHERE isfinite(x)) AS finite FROM (SELECT CASE WHEN p_size = 1 THEN 'nan'::DOUBLE WHEN p_size = 2 THEN 'inf'::DOUBLE WHEN p_size > 3 THEN p_retailprice END AS x FROM part)")
def _(spark, sf):
    s = F.col("p_size")
    x = F.when(s == 1, F.lit(float("nan"))).when(s == 2, F.lit(float("inf"))).when(s > 3, F.col("p_retailprice"))
    return table(spark, sf, "part").select(x.alias("x")).agg(F.sum(exprs.finite("x").cast("long")).alias("finite"))


@add("rel_macro", "SELECT c_custkey, c_acctbal > 0 AND c_nationkey < 10 AS ok FROM customer")
def _(spark, sf):
    views(spark, sf, "customer").sql("CREATE OR REPLACE TEMPORARY FUNCTION upslope_ok(b DOUBLE, k INT) RETURNS BOOLEAN RETURN b > 0 AND k < 10")
    return spark.sql("SELECT c_custkey, upslope_ok(c_acctbal, c_nationkey) AS ok FROM customer")


@add("rel_seeded_sample", None)
def _(spark, sf):
    return table(spark, sf, "orders").orderBy(F.xxhash64("o_orderkey", F.lit(42)), "o_orderkey").limit(100).select("o_orderkey")


@add("rel_describe", "SELECT column_name AS field, count(*) AS n FROM (SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS column_name) GROUP BY 1")
def _(spark, sf):
    n = table(spark, sf, "nation")
    return spark.createDataFrame([(c,) for c in n.columns], "field string").groupBy("field").agg(F.count("*").alias("n"))


@add("rel_json", "SELECT event_type, count(*) AS n, count(DISTINCT CAST(props AS VARCHAR)) AS kinds FROM events GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("props").alias("kinds"))


QUERIES, ORACLES = Q, O
