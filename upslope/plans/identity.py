"""Identity, stints, parsing, checks and publication on the shared tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from upslope.functions import exprs, marks, similarity, text
from upslope.operators import checks, identity, windows
from upslope.plans._base import PERF, performances, rounded, table, with_
from upslope.scratch import materialize, new_path
from upslope.sources import catalog, csvfiles, pages, profiles
from upslope.streaming import ingest

Q, O = {}, {}


def add(name, sql=None, exact=False):
    """Register a query; ``exact`` ones have no floating-point sums, and their SQL doesn't round."""

    def register(f):
        Q[name] = lambda spark, sf: f(spark, sf) if exact else rounded(f(spark, sf))
        if sql:
            O[name] = sql
        return f

    return register


RUNS = """WITH m AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM m),
s AS (SELECT user_id, run, min(event_type) AS event_type, count(*) AS n_rows, min(ts) AS first_at, max(ts) AS last_at FROM r GROUP BY ALL),
z AS (SELECT *, lag(event_type) OVER w AS previous, lead(event_type) OVER w AS following, count(*) OVER (PARTITION BY user_id, event_type ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS returns FROM s WINDOW w AS (PARTITION BY user_id ORDER BY run))
SELECT user_id, run, event_type, n_rows, first_at, last_at, previous, following, returns, coalesce(n_rows = 1 AND previous = following, false) AS one_row_island FROM z"""


@add("id_stints", RUNS)
def _(spark, sf):
    return windows.stints(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type", "ts")


SIGS = """sig AS (SELECT DISTINCT o_custkey AS p, o_orderpriority || c_mktsegment AS nm, c_nationkey AS g, md5(concat_ws('|', CAST(CAST(o_orderdate AS DATE) AS VARCHAR), o_orderstatus)) AS s FROM orders JOIN customer ON o_custkey = c_custkey),
sizes AS (SELECT p, count(DISTINCT s) AS size, min(g) AS g FROM sig GROUP BY p),
rare AS (SELECT nm, s FROM sig GROUP BY ALL HAVING count(DISTINCT p) > 1), held AS (SELECT DISTINCT nm, s, p FROM sig JOIN rare USING (nm, s)),
pairs AS (SELECT a.p AS l, b.p AS r, count(DISTINCT a.s) AS shared FROM held a JOIN held b ON a.nm = b.nm AND a.s = b.s AND a.p < b.p GROUP BY ALL)"""


def duplicate_pairs(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select("o_custkey", F.concat("o_orderpriority", "c_mktsegment").alias("nm"), "c_nationkey", F.md5(F.concat_ws("|", F.to_date("o_orderdate").cast("string"), "o_orderstatus")).alias("s"))
    return identity.duplicate_pairs(rows, "o_custkey", "nm", "c_nationkey", F.col("s"), 1, 0.1, max_profiles=None)


@add("id_duplicate_pairs", f'WITH {SIGS} SELECT l AS "left", r AS "right", shared, round(shared / least(x.size, y.size), 4) AS share, CASE WHEN x.g = y.g AND shared >= 1 AND shared / least(x.size, y.size) >= 0.1 THEN \'high\' ELSE \'low\' END AS confidence FROM pairs JOIN sizes x ON l = x.p JOIN sizes y ON r = y.p')
def _(spark, sf):
    return duplicate_pairs(spark, sf)


@add("id_canonical_profiles", f"""WITH RECURSIVE {SIGS}, e AS (SELECT l AS a, r AS b FROM pairs JOIN sizes x ON l = x.p JOIN sizes y ON r = y.p WHERE x.g = y.g AND shared / least(x.size, y.size) >= 0.1),
  sides AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a AS node, a AS hop FROM sides UNION SELECT reach.node, sides.b FROM reach JOIN sides ON reach.hop = sides.a)
  SELECT node AS profile, min(hop) AS canonical FROM reach GROUP BY node""")
def _(spark, sf):
    return identity.canonical_ids(duplicate_pairs(spark, sf).where("confidence = 'high'"))


EVENTS = "['100 Meters', ' 4x400', 'DMR', 'Sprint Medley', 'Swedish Relay', 'Mile', NULL][l_linenumber % 7 + 1]"


@add("id_individual_signatures", f"""SELECT l_suppkey, count(*) FILTER (WHERE relay) AS relay_rows, count(*) FILTER (WHERE NOT relay) AS individual_rows, min(s) FILTER (WHERE NOT relay) AS first_signature, max(s) FILTER (WHERE NOT relay) AS last_signature
  FROM (SELECT l_suppkey, coalesce(regexp_matches(lower(e), '^\\s*4x|relay|medley|^\\s*[ds]mr\\s*$'), false) AS relay, md5(concat_ws(chr(31), l_orderkey, l_partkey, coalesce(e, ''), l_returnflag, l_linestatus, l_linenumber)) AS s FROM (SELECT *, {EVENTS} AS e FROM lineitem)) GROUP BY 1""")
def _(spark, sf):
    names = F.array(*map(F.lit, ("100 Meters", " 4x400", "DMR", "Sprint Medley", "Swedish Relay", "Mile", None)))
    rows = table(spark, sf, "lineitem").withColumn("e", F.element_at(names, (F.col("l_linenumber") % 7 + 1).cast("int")))
    signature = identity.row_signature(*(F.col(c) for c in ("l_orderkey", "l_partkey", "e", "l_returnflag", "l_linestatus", "l_linenumber")))
    rows = rows.select("l_suppkey", identity.is_relay(F.col("e")).alias("relay"), signature.alias("s"))
    own = F.when(~F.col("relay"), F.col("s"))
    return rows.groupBy("l_suppkey").agg(F.count_if("relay").alias("relay_rows"), F.count_if(~F.col("relay")).alias("individual_rows"), F.min(own).alias("first_signature"), F.max(own).alias("last_signature"))


@add("id_resolve_rows", "SELECT s_nationkey AS page_id, s_suppkey AS person_id, s_suppkey AS row_index, ['id', 'name', 'similar'][s_suppkey % 3 + 1] AS method, CASE WHEN s_suppkey % 3 = 2 THEN 0.6 + 0.4 * 6 / 7 ELSE 1.0 END::DOUBLE AS score FROM supplier", exact=True)
def _(spark, sf):
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier").withColumn("kind", k % 3)
    targets = s.select(F.col("s_nationkey").alias("page_id"), k.alias("person_id"), F.concat(F.lit("Ann  Key"), k).alias("name"), F.concat(F.lit("m"), k, F.lit(".5")).alias("mark"))
    first = F.when(F.col("kind") == 0, "Zoe Other").when(F.col("kind") == 1, F.concat(F.lit("\u00c1NN key"), k)).otherwise(F.concat(F.lit("Anne Key"), k))
    rows = s.select(F.col("s_nationkey").alias("page_id"), k.alias("row_index"), F.when(F.col("kind") == 0, k).alias("link_id"), first.alias("link_name"), F.concat(F.lit("1 (M"), k, F.lit(".5) w")).alias("row_text"))
    return similarity.resolve_rows(targets, rows).drop("name", "mark")


@add("id_exact_copies", "SELECT md5(text) AS signature, count(*) AS copies, min(doc_id) AS canonical FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf):
    return table(spark, sf, "documents").groupBy(F.md5("text").alias("signature")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("canonical")).where("copies > 1")


@add("id_precedence", "SELECT k, precedence, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY precedence, v) AS r FROM (SELECT s_nationkey AS k, s_name AS v, 1 AS precedence FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT c_nationkey, c_name, 2 FROM customer)) WHERE r = 1")
def _(spark, sf):
    s = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("v"))
    return identity.by_precedence([s, table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("v"))], "k", "v")


REPEATS = "rep AS (SELECT o_orderkey % 5000 AS k, o_orderpriority AS x, o_totalprice > 200000 AS flag, o_orderstatus AS st FROM orders)"


def repeats(spark, sf):
    o = table(spark, sf, "orders")
    return o.select((F.col("o_orderkey") % 5000).alias("k"), F.col("o_orderpriority").alias("x"), (F.col("o_totalprice") > 200000).alias("flag"), F.col("o_orderstatus").alias("st"))


@add("id_collapse_repeats", f"WITH {REPEATS} SELECT k, min(x) AS x, min(st) AS st, bool_or(flag) AS flag, count(*) AS copies FROM rep GROUP BY k HAVING count(DISTINCT (x, st)) = 1")
def _(spark, sf):
    return identity.collapse_repeats(repeats(spark, sf), "k", "flag", ["x"])[0]


@add("id_collapse_conflicts", f"WITH {REPEATS} SELECT k, count(DISTINCT (x, st)) AS variants FROM rep GROUP BY k HAVING count(DISTINCT (x, st)) > 1")
def _(spark, sf):
    return identity.collapse_repeats(repeats(spark, sf), "k", "flag", ["x"])[1]


@add("id_most_frequent", "SELECT c_nationkey, c_mktsegment, n, variants FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS r, count(*) OVER (PARTITION BY c_nationkey) AS variants FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)) WHERE r = 1")
def _(spark, sf):
    return windows.most_frequent(table(spark, sf, "customer"), ["c_nationkey"], "c_mktsegment")


@add("id_evidence_class", """SELECT k, count(DISTINCT t) AS teams, count(DISTINCT s) AS schools, min(t) AS team, string_agg(DISTINCT s, '|' ORDER BY s) AS school_list, CASE WHEN count(DISTINCT t) = 0 AND count(DISTINCT s) = 0 THEN 'none' WHEN count(DISTINCT t) = 1 THEN 'consistent_team' WHEN count(DISTINCT s) = 1 THEN 'consistent_school_multiple_teams' ELSE 'mixed' END AS evidence
  FROM (SELECT o_custkey % 400 AS k, nullif(trim(CASE WHEN o_orderpriority LIKE '1%' THEN ' ' ELSE substr(o_orderpriority, 1, 1) END), '') AS t, nullif(o_orderstatus, 'P') AS s FROM orders) GROUP BY k""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    x = o.select((F.col("o_custkey") % 400).alias("k"), F.when(F.col("o_orderpriority").startswith("1"), " ").otherwise(F.substring("o_orderpriority", 1, 1)).alias("t"), F.nullif("o_orderstatus", F.lit("P")).alias("s"))
    return identity.evidence_class(x, ["k"], "t", "s")


@add("id_overlay", "SELECT c.c_custkey, CASE WHEN c.c_custkey % 10 = 0 THEN 'REVIEWED' ELSE c_mktsegment END AS c_mktsegment, c.c_custkey % 10 = 0 AS reviewed FROM customer c")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return identity.overlay(c, c.where("c_custkey % 10 = 0").withColumn("c_mktsegment", F.lit("REVIEWED")), "c_custkey", ["c_mktsegment"])


@add("id_name_match", """WITH n AS (SELECT n_name, n_nationkey AS i, regexp_replace(strip_accents(lower(replace(translate(n_name, 'AEIOUC', 'ÁÈÎÕÜÇ') || ' & Co²', '&', ' and '))), '[^a-z0-9]', '', 'g') || '2' AS key FROM nation),
  r AS (SELECT regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') || 'andco2' AS key, p, ['team', 'school', 'alias', 'entity'][p + 1] || '-' || n_nationkey AS entity FROM nation CROSS JOIN range(4) t(p) WHERE n_nationkey % 4 <= p)
  SELECT n_name, entity FROM (SELECT n_name, entity, row_number() OVER (PARTITION BY n_name ORDER BY p) AS k FROM n JOIN r USING (key)) WHERE k = 1""")
def _(spark, sf):
    none = F.lit(None).cast("string").alias("g")
    marked = F.concat(F.translate("n_name", "AEIOUC", "ÁÈÎÕÜÇ"), F.lit(" & Co²"))
    n = table(spark, sf, "nation").select("n_name", text.name_key(marked).alias("key"), none)
    spelled = F.concat(F.lit(" "), F.lower("n_name"), F.lit(". + CO-2"))
    registries = [table(spark, sf, "nation").where(F.col("n_nationkey") % 4 <= p).select(text.name_key(spelled).alias("key"), none, F.concat(F.lit(f"{kind}-"), "n_nationkey").alias("entity")) for p, kind in enumerate(("team", "school", "alias", "entity"))]
    return identity.match_names(n, registries, "key", "g", "entity").select("n_name", "entity")


_CODES = ", ".join(f"'{c}'" for c in marks.STATUS_CODES)


@add("parse_marks", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, state, kind, CAST(round(value, 4) AS DOUBLE) AS value, annotated FROM (SELECT *,
    CASE WHEN f IN (11, 12, 13) THEN 'unrecognized' WHEN f IN (10, 14) THEN 'blank' WHEN f IN (9, 15) THEN 'status' ELSE 'parsed' END AS state,
    CASE f WHEN 0 THEN 'ms' WHEN 1 THEN 'metric' WHEN 2 THEN 'points' WHEN 3 THEN 'metric' WHEN 4 THEN 'imperial' WHEN 5 THEN 'imperial' WHEN 6 THEN 'hms' WHEN 7 THEN 's' WHEN 8 THEN 'ms' WHEN 9 THEN [{_CODES}][l_partkey % {len(marks.STATUS_CODES)} + 1] WHEN 15 THEN 'DSQ' END AS kind,
    CASE f WHEN 0 THEN p * 60 + s + 0.25 WHEN 1 THEN p + 0.5 WHEN 2 THEN l_partkey WHEN 3 THEN p + 0.45 WHEN 4 THEN (p * 12 + 6) * 0.0254 WHEN 5 THEN (p * 12 + 6.5) * 0.0254 WHEN 6 THEN 3900 + s + 0.5 WHEN 7 THEN s + 0.1 WHEN 8 THEN p * 60 + s END AS value,
    f IN (7, 8) AS annotated FROM (SELECT *, (l_orderkey + l_linenumber) % 16 AS f, l_partkey % 90 AS p, l_suppkey % 60 AS s FROM lineitem))""")
def _(spark, sf):
    f, p, s = (F.col("l_orderkey") + F.col("l_linenumber")) % 16, (F.col("l_partkey") % 90).cast("string"), F.col("l_suppkey") % 60
    two, one = F.lpad(s.cast("string"), 2, "0"), s.cast("string")
    code = F.get(F.array(*map(F.lit, marks.STATUS_CODES)), (F.col("l_partkey") % len(marks.STATUS_CODES)).cast("int"))
    forms = [
        ("time", F.concat(F.lit(" "), p, F.lit(":"), two, F.lit(".25 "))), ("distance", F.concat(p, F.lit(".50m"))), ("points", F.concat(F.col("l_partkey").cast("string"), F.lit(" pts"))), ("distance", F.concat(p, F.lit(".45"))),
        ("distance", F.concat(p, F.lit("\u2019 6\u2033"))), ("distance", F.concat(p, F.lit("\u201306.50"))), ("time", F.concat(F.lit("1:05:"), two, F.lit(".5"))), ("time", F.concat(one, F.lit(".1h"))),
        ("time", F.concat(p, F.lit(":"), two, F.lit(".00 (A)#"))), ("time", F.concat(F.lit(" "), F.lower(code))), ("time", F.lit(" \u00a0 ")), ("time", F.lit("abc")),
        ("distance", F.concat(p, F.lit("' 13"))), ("time", F.concat(p, F.lit(":75.0"))), ("time", F.lit(None).cast("string")), ("distance", F.lit("d s q.")),
    ]
    kind, raw = F.lit("points"), F.lit("0")
    for i, (k, text_) in enumerate(forms):
        kind, raw = F.when(f == i, k).otherwise(kind), F.when(f == i, text_).otherwise(raw)
    x = materialize(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", kind.alias("mark_type"), raw.alias("mark")), "marks")
    x = x.withColumn("m", marks.parse_mark(F.col("mark_type"), F.col("mark")))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "m.state", "m.kind", F.round("m.value", 4).alias("value"), "m.annotated")


@add("parse_marks_once", with_(PERF, "SELECT event, count(*) AS n, avg(floor(value) + 0.5) AS mean FROM perf GROUP BY event", doubles="mean"))
def _(spark, sf):
    perf = performances(spark, sf).withColumn("raw", F.concat(F.floor("value").cast("string"), F.lit(".5")))
    parsed = perf.select("raw").distinct().withColumn("m", marks.parse_mark(F.lit("time"), F.col("raw"))["value"])
    return perf.join(parsed, "raw").groupBy("event").agg(F.count("*").alias("n"), F.avg("m").alias("mean"))


@add("parse_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) AS e FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", text.parse_date_range(F.date_format("o_orderdate", "MMM d, yyyy")).alias("r"))
    return o.select("o_orderkey", F.col("r.first").alias("d"), F.col("r.last").alias("e"))


@add("parse_urls", "SELECT page_id, 'https://' || lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') AS url FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.normal_url(F.col("url"), "example.org").alias("url"))


@add("parse_event_family", "SELECT p_partkey, CASE WHEN p_size * 60 BETWEEN 50 AND 400 THEN 'sprints' WHEN p_size * 60 > 400 AND p_size * 60 < 2000 THEN 'middle' ELSE 'distance' END AS family FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.event_family(F.concat((F.col("p_size") * 60).cast("string"), F.lit(" Meters"))).alias("family"))


@add("parse_course_distance", "SELECT p_partkey, CAST(round(d, 4) AS DOUBLE) AS metres, CAST(CASE WHEN d <= 5500 THEN 5000.0 WHEN d <= 7000 THEN 6000.0 WHEN d <= 9000 THEN 8000.0 ELSE 10000.0 END AS DOUBLE) AS standard FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN (p_size % 6 + 4) * 1000.0 ELSE (p_size % 3 + 3) * 1609.344 END AS d FROM part)")
def _(spark, sf):
    s = F.col("p_size")
    raw = F.when(s % 2 == 0, F.concat((s % 6 + 4).cast("string"), F.lit("K"))).otherwise(F.concat((s % 3 + 3).cast("string"), F.lit(" mi")))
    x = table(spark, sf, "part").select("p_partkey", text.course_metres(raw).alias("metres"))
    return x.select("p_partkey", "metres", text.nearest(F.col("metres"), [5000, 6000, 8000, 10000])["standard"].alias("standard"))


@add("source_list_links", "SELECT page_id, unnest(regexp_extract_all(html, '<li><a href=\"([^\"]*)\">', 1)) AS href FROM pages")
def _(spark, sf):
    return pages.list_items(table(spark, sf, "pages")).select("page_id", "href")


@add("source_page_fields", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html[^>]*lang=\"([^\"]*)\"', 1) AS lang, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs, len(regexp_extract_all(html, '<a ')) AS links FROM pages")
def _(spark, sf):
    return pages.page_fields(table(spark, sf, "pages"))


@add("source_result_pages", """SELECT page_id, i AS row_index, 'Meet ' || page_id AS section, ['Event', '200 Meters', '100 Meters'][i + 1] AS event, ['Mark', 'DNF', CAST(page_id % 90 + 10 AS VARCHAR) || '.52'][i + 1] AS mark,
  CASE WHEN i = 2 THEN '+1.2' END AS wind, CASE WHEN i = 2 THEN CAST(page_id % 8 + 1 AS INTEGER) END AS place, CASE WHEN i = 2 THEN 'F' END AS round FROM pages CROSS JOIN (SELECT unnest([0, 1, 2])::INTEGER AS i)""")
def _(spark, sf):
    # the pages hold no results, so each gets a table of them behind its own html
    head, p = "<table><tr><th>Event</th><th>Mark</th><th>Place</th></tr><tr><td>200 Meters<td>DNF<td></tr>", F.col("page_id")
    mark = F.concat(F.lit("<tr><td>100 Meters</td><td><a href='/r/1'>"), (p % 90 + 10).cast("string"), F.lit(".52</a> (+1.2)</td><td>"))
    results = F.concat(F.lit("<h3>Meet "), p, F.lit(f"</h3>{head}"), mark, (p % 8 + 1).cast("string"), F.lit("th (F)</td></tr></table>"))
    out = pages.parse_result_pages(table(spark, sf, "pages").select("page_id", F.concat(F.coalesce("html", F.lit("")), results).alias("html")))
    return out.select("page_id", "row_index", "section", "event", "mark", "wind", "place", "round")


def profile_pages(spark, sf):
    # the pages are no profiles, so each gets one behind its own html
    p = F.col("page_id").cast("string")
    head = [F.lit("<h3 class='large-title'>PERSON "), p, F.lit(" (SR-4)</h3><a href='/teams/tf/T"), F.col("page_id") % 7, F.lit(".html?x=1'>STATE "), F.col("page_id") % 7, F.lit("</a>")]
    seasons = [F.lit("<div id='session-history'><h3 class='outdoors'>"), F.col("page_id") % 9 + 2010, F.lit(" Season</h3><div><a href='/results/"), p, F.lit("/5/Meet'>all</a></div></div>")]
    first = [F.lit("<div id='meet-results'><table><thead><tr><th><a href='/results/"), p, F.lit("/Meet'>Meet "), p, F.lit("</a><span>May 1, 2015</span></th></tr></thead><tr class='highlight'><td>100<td><a href='/results/"), p]
    first += [F.lit("/5/Meet/'>10."), F.col("page_id") % 90 + 10, F.lit("</a><span>(-0.3)</span><span>w</span><td>"), F.col("page_id") % 8 + 1, F.lit(" (P)</tr></table>")]
    moved = [F.lit("<div class='transfer'>Competing for College "), F.col("page_id") % 5, F.lit(" &darr;</div><table><thead><tr><th><a href='/results/xc/"), p]
    moved += [F.lit("/M'>XC</a><span>Nov 2 2013</span></thead><tr><td>8K</td><td><a href='/results/xc/"), p, F.lit("/M'>25:00</a></td><td>12</td></tr></table></div>")]
    html = F.concat(F.coalesce("html", F.lit("")), *(c.cast("string") for c in head + seasons + first + moved))
    return profiles.parse_profiles(table(spark, sf, "pages").select("page_id", html.alias("html")))


@add("source_profile_results", """SELECT page_id, status, 'Person ' || page_id AS name, 'SR-4' AS class_year, 'State ' || page_id % 7 AS school, 'T' || page_id % 7 AS team_id, r.* FROM (SELECT page_id, 'OK' AS status, unnest([
  {'section_index': 0, 'season_year': CAST(page_id % 9 + 2010 AS VARCHAR), 'season_type': 'Outdoor', 'season_label': (page_id % 9 + 2010) || ' Season', 'meet_id': CAST(page_id AS VARCHAR), 'result_id': '5', 'meet_name': 'Meet ' || page_id, 'meet_date': 'May 1, 2015', 'event': '100', 'mark': '10.' || (page_id % 90 + 10), 'secondary_mark': 'w', 'wind': '-0.3', 'place': CAST(page_id % 8 + 1 AS VARCHAR), 'round': 'P', 'highlighted': true},
  {'section_index': 1, 'season_year': '2013', 'season_type': 'Cross Country', 'season_label': '2013 XC', 'meet_id': CAST(page_id AS VARCHAR), 'result_id': NULL, 'meet_name': 'XC', 'meet_date': 'Nov 2 2013', 'event': '8K', 'mark': '25:00', 'secondary_mark': NULL, 'wind': NULL, 'place': '12', 'round': NULL, 'highlighted': false}]) AS r FROM pages)""")
def _(spark, sf):
    out = profile_pages(spark, sf).select("page_id", "status", "name", "class_year", "school", "team_id", F.explode("results").alias("r"))
    return out.select("page_id", "status", "name", "class_year", "school", "team_id", "r.*").drop("row_index", "raw_place", "meet_url", "result_url")


@add("source_profile_sections", """SELECT page_id, i AS section_index, CASE WHEN i = 0 THEN 'State ' || page_id % 7 ELSE 'College ' || page_id % 5 END AS school, CASE WHEN i = 0 THEN 'PROFILE_CURRENT_SCHOOL' ELSE 'PROFILE_TRANSFER_MARKER' END AS method, i = 0 AS is_current,
  CASE WHEN i = 0 THEN 2 ELSE 1 END::BIGINT AS links, CASE WHEN i = 0 THEN sha256('https://example.org/results/' || page_id || '/5/Meet') ELSE sha256('https://example.org/results/xc/' || page_id || '/M') END AS last_key, CASE WHEN i = 0 THEN 'MEET_OR_RESULTS_PAGE,RESULT_DETAIL' ELSE 'XC_RESULT_OR_MEET' END AS kinds
  FROM pages CROSS JOIN (SELECT unnest([0, 1])::INTEGER AS i)""")
def _(spark, sf):
    parsed = materialize(profile_pages(spark, sf), "profiles")
    links = profiles.unfold(parsed, "links").groupBy("page_id", "section_index").agg(F.count("*").alias("links"), F.max_by("url_sha256", "kind").alias("last_key"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))
    return profiles.unfold(parsed, "sections").drop("marker").join(links, ["page_id", "section_index"])


@add("source_csv_round_trip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(spark, sf):
    path = new_path(spark, "csv")
    csvfiles.write_csv(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return csvfiles.read_typed_csv(spark, path, {"c_custkey": "bigint", "c_name": "string", "c_acctbal": "double"}).drop("source_file")


@add("source_consolidate", "SELECT k, min(v) AS v, 'https://example.org/' || k AS profile_url FROM (SELECT c_nationkey AS k, c_name AS v FROM customer UNION ALL SELECT s_nationkey, s_name FROM supplier) GROUP BY k")
def _(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("v"))
    return csvfiles.consolidate([a, table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("v"))], "k", "https://example.org/")


@add("check_constraints", "SELECT * FROM (VALUES ('l_orderkey is not null', 'PASS', 0::BIGINT, 0::BIGINT), ('l_quantity in [1, 50]', 'PASS', 0, 0)) t(check_name, status, observed, expected) UNION ALL SELECT 'l_discount in [0, 0.05]', 'FAIL', count(*), 0 FROM lineitem WHERE l_discount > 0.05")
def _(spark, sf):
    return checks.check_constraints(table(spark, sf, "lineitem"), [checks.not_null("l_orderkey"), checks.in_range("l_quantity", 1, 50), checks.in_range("l_discount", 0, 0.05)])


@add("check_unique", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf):
    return checks.unique_violations(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@add("check_parity", "SELECT (SELECT count(*) FROM lineitem) AS rows_a, (SELECT count(*) FROM lineitem WHERE l_quantity > 1) AS rows_b, (SELECT count(*) FROM lineitem WHERE l_quantity <= 1) AS only_a, 0::BIGINT AS only_b, 'FAIL' AS status")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    return checks.parity(li, li.where("l_quantity > 1"))


@add("check_field_profile", """SELECT field, count(*) AS rows, count(*) - count(v) AS nulls, count(*) FILTER (WHERE trim(v) = '') AS blanks, count(DISTINCT v) AS distinct_values, min(length(v)) AS min_length, max(length(v)) AS max_length,
  count(*) FILTER (WHERE regexp_full_match(v, '[+-]?[0-9]+')) AS n_integer, count(*) FILTER (WHERE regexp_full_match(v, '[+-]?[0-9]*\\.[0-9]+')) AS n_decimal, count(*) FILTER (WHERE regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}')) AS n_date,
  count(*) FILTER (WHERE trim(v) <> '' AND NOT regexp_full_match(v, '[+-]?[0-9]+') AND NOT regexp_full_match(v, '[+-]?[0-9]*\\.[0-9]+') AND NOT regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}')) AS n_text
  FROM (SELECT unnest(['c_custkey', 'c_name', 'c_mktsegment']) AS field, unnest([CAST(c_custkey AS VARCHAR), c_name, c_mktsegment]) AS v FROM customer) GROUP BY field""")
def _(spark, sf):
    return checks.field_profile(table(spark, sf, "customer"), ["c_custkey", "c_name", "c_mktsegment"])


@add("check_top_examples", "SELECT value, n, 'text' AS format, row_number() OVER (ORDER BY n DESC, value) AS position FROM (SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1) QUALIFY position <= 3")
def _(spark, sf):
    return checks.top_examples(table(spark, sf, "customer"), "c_mktsegment")


def _catalog(spark):
    return catalog.Catalog(spark, new_path(spark, f"catalog-{uuid.uuid4().hex[:6]}"))


@add("pub_publish_and_read", "SELECT o_custkey, o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders WHERE year(o_orderdate) = 1997")
def _(spark, sf):
    c, o = _catalog(spark), table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("y"))
    c.publish("core", "orders", o, lambda written: checks.check_constraints(written, [checks.not_null("o_orderkey")]), ["y"])
    return c.read("core", "orders", y=1997)


@add("pub_reader", "SELECT o_orderstatus AS model, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW' GROUP BY ALL")
def _(spark, sf):
    c = catalog.Catalog(spark, new_path(spark, "reader"), ("official",), {"data/points.csv": ("official", "points")})
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("model"), F.col("o_orderpriority").alias("cohort"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))
    c.publish("official", "points", o, partition_by=["model"])
    assert c.read_resource("./data//points.csv", model="F").columns == c.read("official", "points").columns
    return c.time_values("official", "points", ["model", "y", "m"], model="F", cohort="5-LOW")


@add("pub_registry", "SELECT 'core' AS layer, 'nation' AS \"table\", 25::BIGINT AS rows, 3::BIGINT AS columns UNION ALL SELECT 'core', 'region', 5, 2")
def _(spark, sf):
    c = _catalog(spark)
    for n in ("nation", "region"):
        c.publish("core", n, table(spark, sf, n))
    return c.registry([("core", "nation"), ("core", "region")])


@add("pub_copy_parity", "SELECT count(*) AS rows_a, count(*) AS rows_b, 0::BIGINT AS only_a, 0::BIGINT AS only_b, 'PASS' AS status FROM supplier")
def _(spark, sf):
    c = _catalog(spark)
    for layer in ("core", "public"):
        c.publish(layer, "supplier", table(spark, sf, "supplier"))
    return c.verify_copy(("core", "supplier"), ("public", "supplier"))


@add("pub_official_view", "SELECT school, n FROM (SELECT c_nationkey AS school, count(*) AS n FROM customer GROUP BY 1)")
def _(spark, sf):
    n = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("school")).agg(F.count("*").alias("n"))
    both = n.withColumn("model", F.lit("primary")).unionByName(n.withColumn("n", F.col("n") + 1).withColumn("model", F.lit("legacy")))
    return catalog.official_view(both, "model", "primary")


@add("pub_latest_summary", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders JOIN (SELECT o_custkey AS c, max(o_orderdate) AS d FROM orders GROUP BY 1) ON o_custkey = c AND o_orderdate = d GROUP BY 1")
def _(spark, sf):
    return catalog.latest_summary(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@add("pub_program_index", "SELECT o_custkey, min(o_orderpriority) AS o_orderpriority, count(*) AS profile_row_count, count(DISTINCT o_orderstatus) AS o_orderstatus_count, count(DISTINCT o_orderpriority) AS o_orderpriority_count, min(o_orderdate) AS first_o_orderdate, max(o_orderdate) AS latest_o_orderdate FROM orders GROUP BY 1")
def _(spark, sf):
    c = _catalog(spark)
    c.publish("core", "summary", table(spark, sf, "orders"))
    c.alias({"explorer_summary": ("core", "summary")})
    return catalog.program_index(spark.table("explorer_summary"), "o_custkey", ["o_orderpriority"], ["o_orderstatus", "o_orderpriority"], "o_orderdate")


@add("pub_describe", "SELECT 'core' AS layer, 'nation' AS \"table\", i::INTEGER AS position, c AS \"column\", t AS type FROM (VALUES (0, 'n_nationkey', 'bigint'), (1, 'n_name', 'string'), (2, 'n_regionkey', 'bigint')) v(i, c, t)")
def _(spark, sf):
    c = _catalog(spark)
    n = table(spark, sf, "nation")
    c.publish("core", "nation", n.select(F.col("n_nationkey").cast("long"), "n_name", F.col("n_regionkey").cast("long")))
    return c.describe([("core", "nation")])


@add("pub_metric_pivot", "SELECT l_returnflag AS metric, max(l_quantity) FILTER (WHERE l_linestatus = 'O') AS \"O\", max(l_quantity) FILTER (WHERE l_linestatus = 'F') AS \"F\" FROM lineitem GROUP BY 1")
def _(spark, sf):
    return catalog.metric_pivot(table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "metric"), "metric", "l_linestatus", ["O", "F"], "l_quantity")


@add("pub_enrich_lists", "SELECT r_regionkey, string_agg(DISTINCT n_name, '|' ORDER BY n_name) AS nations FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def _(spark, sf):
    n = table(spark, sf, "nation")
    key = catalog.first_column(n, ["regionkey", "n_regionkey"])
    meta = n.select(F.col(key).alias("r_regionkey"), "n_name")
    return catalog.enrich_with_lists(table(spark, sf, "region").select("r_regionkey"), meta, "r_regionkey", "n_name", "nations")


@add("stream_windowed_counts", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, sf):
    return ingest.windowed_counts(table(spark, sf, "events"), "ts", "event_type", "value")


@add("stream_ingest_once", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, sf):
    n = table(spark, sf, "nation")
    source, target, mark = (new_path(spark, x) for x in ("stream-in", "stream-out", "stream-mark"))
    n.write.parquet(source)
    for _ in range(2):
        ingest.ingest_available(spark, source, n.schema, target, mark)
    return spark.read.schema(n.schema).parquet(target)


QUERIES, ORACLES = Q, O
