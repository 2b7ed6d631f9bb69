"""Invariants and edge cases of the analytics operators."""

import random
import re
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from upslope.functions.similarity import folded, resolve_rows
from upslope.operators import checks, graph, identity, levels, points, stats, windows
from upslope.plans import identity as identity_plans
from upslope.scratch import drop_path, materialize, new_path, shared_dir
from upslope.sources import catalog, csvfiles, pages, profiles
from upslope.streaming import ingest


def test_connected_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(40)]
    hub = [(100, k) for k in range(101, 200)]
    edges = spark.createDataFrame(chain + hub + [(300, 300), (None, 5), (7, None)], "src long, dst long")
    got = {r.node: r.component for r in graph.connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[k] == 100 for k in range(100, 200)) and got[300] == 300
    assert graph.connected_components(edges.limit(0)).count() == 0


def test_budget_adds_up(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", -2.0), ("b", -1.0), ("b", 0.0)], "e string, s double")
    got = points.allocate_budget(df, ["e"], "s").groupBy("e").agg(F.sum(F.greatest("points", F.lit(0.0))).alias("p")).collect()
    assert {r.e: r.p for r in got} == {"a": 100_000.0, "b": 0.0}


def test_negative_pool_is_bounded(spark):
    df = spark.createDataFrame([("a", 1.0, 4), ("a", -9.0, 4)], "e string, s double, n long")
    got = points.bounded_pools(df, ["e"], "s", "n", cap=0.5).collect()
    assert sorted(round(r.points) for r in got) == [-50_000, 100_000]


def test_shrinkage_lies_between(spark):
    df = spark.createDataFrame([(k, float(k * 3 + (i % 4) - i % 3)) for k in range(6) for i in range(4 + 3 * k)], "k int, x double")
    for r in stats.eb_rank(df, "k", "x", min_sample=7).collect():
        low, high = sorted((r.mean, r.grand_mean))
        assert low - 1e-9 <= r.posterior <= high + 1e-9
        assert (r.official_rank is None) == (r.n < 7)


def test_crossfit_leaves_the_own_fold_out(spark):
    df = spark.createDataFrame([(1, "a", 10.0), (2, "a", 20.0), (2, "b", 40.0)], "fold int, c string, y double")
    got = {(r.fold, r.c): r.expected for r in stats.crossfit_mean(df, "fold", "y", [["c"]], [1.0]).collect()}
    assert got[1, "a"] == pytest.approx((20 + 30) / 2) and got[2, "b"] == pytest.approx(10.0)


def test_islands_and_transitions(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(["a", "a", "b", "a", None, None])], "p int, t int, s string")
    got = windows.stints(df, "p", ["t"], "s", "t").orderBy("run").collect()
    assert [(r.s, r.n_rows, r.one_row_island, r.returns) for r in got] == [("a", 2, False, False), ("b", 1, True, False), ("a", 1, False, True), (None, 2, False, False)]


def test_missing_seasons_stay_missing(spark):
    df = spark.createDataFrame([("x", 2000, 1.0), ("x", 2002, 3.0)], "k string, y int, v double")
    got = windows.previous_period(df, ["k"], "y", ["v"]).collect()
    assert all(r.previous_v is None for r in got)
    w = windows.calendar_window(df, ["k"], "y", 3, [F.count("*").alias("n")])
    assert {r.y: r.n for r in w.collect()} == {2000: 1, 2002: 2}


def test_meet_of_its_own_without_date_and_meet(spark):
    df = spark.createDataFrame([("p", None, None, 1.0, 1.0, 1), ("p", None, None, 2.0, 1.0, 2), ("p", "m", None, 3.0, 1.0, 3), ("p", "m", None, 4.0, 1.0, 4)], "p string, meet string, d date, l double, r double, id int")
    got = levels.meet_best(df, ["p"], "meet", "d", "l", "r", "id").collect()
    assert sorted((r.l, r.source_rows) for r in got) == [(1.0, 1), (2.0, 1), (4.0, 2)]


def test_gate_and_constraints(spark):
    df = spark.createDataFrame([(1, 5), (None, 7)], "a int, b int")
    report = checks.check_constraints(df, [checks.not_null("a"), checks.in_range("b", 0, 9)])
    assert {r.check_name: r.observed for r in report.collect()} == {"a is not null": 1, "b in [0, 9]": 0}
    with pytest.raises(ValueError, match="a is not null"):
        checks.gate(report)


def test_identity_ignores_uninformative_signatures(spark):
    rows = [(p, "n", "g", f"s{p}") for p in range(30)] + [(p, "n", "g", "everyone") for p in range(30)] + [(1, "n", "g", "x"), (2, "n", "g", "x"), (1, "n", "g", "y"), (2, "n", "g", "y")]
    df = spark.createDataFrame(rows, "p int, nm string, g string, s string")
    got = identity.duplicate_pairs(df, "p", "nm", "g", F.col("s")).collect()
    assert [(r.left, r.right, r.shared, r.confidence) for r in got] == [(1, 2, 2, "high")]


def test_identity_pairs_of_a_common_signature_are_all_found(spark):
    rows = [(p, "n", "g", "everyone") for p in range(30)] + [(p, "m", "g", "few") for p in (1, 2, 40)]
    df = spark.createDataFrame(rows, "p int, nm string, g string, s string")
    want = {(a, b): 1 for b in range(30) for a in range(b)} | {(1, 2): 2, (1, 40): 1, (2, 40): 1}
    for block in (4, 256):
        got = identity.duplicate_pairs(df, "p", "nm", "g", F.col("s"), max_profiles=None, block=block).collect()
        assert len(got) == len(want) and {(r.left, r.right): r.shared for r in got} == want


def test_registered_pairs_have_no_bound_on_holders(spark, tmp_path):
    spark.createDataFrame([(c, c % 3, "B") for c in range(30)], "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    orders = spark.createDataFrame([(c, "1-URGENT", "O") for c in range(30)], "o_custkey long, o_orderpriority string, o_orderstatus string")
    orders.withColumn("o_orderdate", F.lit("1997-01-01").cast("timestamp")).write.parquet(str(tmp_path / "orders.parquet"))
    assert identity_plans.Q["id_duplicate_pairs"](spark, str(tmp_path)).count() == 30 * 29 // 2
    got = {r.profile: r.canonical for r in identity_plans.Q["id_canonical_profiles"](spark, str(tmp_path)).collect()}
    assert got == {c: c % 3 for c in range(30)}


def test_publication_keeps_the_old_table_when_a_check_fails(spark):
    c = catalog.Catalog(spark, new_path(spark, "pub"))
    good, bad = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(None,)], "a int")
    c.publish("core", "t", good)
    with pytest.raises(ValueError):
        c.publish("core", "t", bad, checks.check_constraints(bad, [checks.not_null("a")]))
    assert c.read("core", "t").collect() == good.collect()
    assert c.manifest("core", "t").count() >= 1 and len(c.manifest("core", "t").first().sha256) == 64


def test_csv_round_trip_with_quotes(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "x"'), ("c", None)], "k string, v string")
    csvfiles.write_csv(df, str(tmp_path / "c"), single_file=True)
    back = csvfiles.read_typed_csv(spark, str(tmp_path / "c"), {"k": "string", "v": "string"})
    assert sorted(map(tuple, back.drop("source_file").collect()), key=str) == sorted([("a,b", 'say "x"'), ("c", None)], key=str)
    csvfiles.write_csv(df, str(tmp_path / "t"), sep="\t", compression="gzip")
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).count() == 2


def test_page_parser_survives_broken_tables(spark):
    html = "<h3>A</h3><table><tr><th>E<th>M<th>P<tr><td>LJ<td>7.45m 24-5.5 (+2.1)<td>1st (F)<tr><td>x</table><p>no table"
    got = pages.parse_result_pages(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")).collect()
    assert [(r.event, r.mark, r.secondary_mark, r.wind, r.place, r["round"]) for r in got[1:2]] == [("LJ", "7.45m", "24-5.5", "+2.1", 1, "F")]
    assert len(got) == 3 and got[0].section == "A"


def test_streaming_takes_each_file_once(spark):
    source, target, mark = (new_path(spark, x) for x in ("in", "out", "mark"))
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    df.write.parquet(source)
    ingest.ingest_available(spark, source, df.schema, target, mark)
    df.write.mode("append").parquet(source)
    ingest.ingest_available(spark, source, df.schema, target, mark)
    ingest.ingest_available(spark, source, df.schema, target, mark)
    assert spark.read.parquet(target).count() == 20


def test_scratch_tables(spark):
    df = materialize(spark.range(3).toDF("x"), "t")
    assert df.count() == 3 and "upslope-" in shared_dir(spark)
    with pytest.raises(ValueError):
        drop_path(spark, "/somewhere/else")


def test_record_text_names_events_between_marks():
    text = "Long Jump:\n7.45m  A Holder, School X  May 1, 2001\nnothing here\n10.5  B Other"
    assert pages.parse_record_text(text) == [("Long Jump", "7.45m", "A Holder", "School X", "May 1, 2001"), ("nothing here", "10.5", "B Other", None, None)]


def test_resumed_chunks_parse_each_key_once(spark):
    from upslope.sources import resume

    c = catalog.Catalog(spark, new_path(spark, "resume"))
    first, every = spark.range(10).toDF("k"), spark.range(30).toDF("k")
    parse = lambda df: df.withColumn("v", F.col("k") + 1)
    assert resume.process_in_chunks(c, "raw", "t", first, "k", parse, 2) == 2
    resume.process_in_chunks(c, "raw", "t", every, "k", parse, 3)
    assert resume.process_in_chunks(c, "raw", "t", every, "k", parse, 3) == 0
    assert sorted(r.k for r in c.read("raw", "t").collect()) == list(range(30))


def test_global_rank_and_groups_equal_a_window(spark):
    from pyspark.sql import Window as W

    from upslope.operators.ordering import exact_quantiles, global_rank, ntile_of, prefix_sums

    df = spark.range(0, 533, 1, 7).selectExpr("id", "pmod(id * 7919, 31) v", "CASE WHEN id % 3 = 0 THEN NULL ELSE id % 2 END k")
    want = df.select("id", F.row_number().over(W.orderBy(F.col("v").desc(), "id")).alias("r"), F.ntile(10).over(W.orderBy(F.col("v").desc(), "id")).alias("g"))
    got = global_rank(df, [F.col("v").desc(), F.col("id")], "r").select("id", F.col("r").cast("int").alias("r"), ntile_of(F.col("r"), 533, 10).alias("g"))
    assert sorted(got.collect()) == sorted(want.collect())
    assert [ntile_of(F.lit(i), 3, 10) is not None for i in (1, 3)] == [True, True]
    small = spark.range(3).select(ntile_of(F.col("id") + 1, 3, 10).alias("g")).collect()
    assert [r.g for r in small] == [1, 2, 3]
    q = df.agg(*(F.percentile("v", F.lit(p)).alias(str(p)) for p in (0.0, 0.05, 0.5, 0.95, 1.0))).first()
    assert exact_quantiles(df, "v", [0.0, 0.05, 0.5, 0.95, 1.0]) == pytest.approx(list(q))
    assert exact_quantiles(df.limit(0), "v", [0.5]) == [None] and global_rank(df.limit(0), ["v"]).count() == 0
    before = W.partitionBy("k").orderBy("id").rowsBetween(W.unboundedPreceding, -1)
    want = df.select("id", F.coalesce(F.sum("v").over(before), F.lit(0)).alias("base")).collect()
    assert sorted(prefix_sums(df, ["k"], "id", "v", chunk=16).select("id", "base").collect()) == sorted(want)


def test_null_keys_keep_their_rows(spark):
    from upslope.operators import stats, trends

    df = spark.createDataFrame([(i % 3 if i % 4 else None, i % 2 if i % 5 else None, float(i), 1 + i % 5) for i in range(60)], "band int, event int, v double, fold int")
    assert stats.crossfit_mean(df, "fold", "v", [["band"], ["band", "event"]], [5.0, 5.0]).count() == 60
    assert trends.peer_context(df, ["band"], "event", "fold", "v").count() == 60
    assert stats.mad(df, ["band"], "v").count() == 4


def test_failed_publication_keeps_the_old_table(spark):
    from upslope.operators import checks
    from upslope.scratch import new_path
    from upslope.sources.catalog import Catalog

    c = Catalog(spark, new_path(spark, "catalog"))
    good, bad = spark.range(5).selectExpr("id a"), spark.range(5).selectExpr("nullif(id, 2) a")
    c.publish("core", "t", good)
    for check in (lambda written: checks.check_constraints(written, [checks.not_null("a")]),):
        with pytest.raises(Exception):
            c.publish("core", "t", bad, check)
    assert c.read("core", "t").count() == 5 and c.read("core", "t").where("a is null").count() == 0
    assert c.publish("core", "t", good.union(good)).count() == 10


def test_reader_refuses_unknown_layers_and_resources(spark):
    from upslope.scratch import new_path
    from upslope.sources.catalog import Catalog

    c = Catalog(spark, new_path(spark, "catalog"), ("official",), {"a/b.csv": ("official", "t")})
    c.publish("official", "t", spark.range(3))
    assert c.read_resource("a/./b.csv").count() == 3
    with pytest.raises(ValueError):
        c.read("private", "t")
    with pytest.raises(KeyError):
        c.read_resource("a/c.csv")


def test_interrupted_work_goes_on_where_it_stopped(spark):
    from upslope.scratch import new_path
    from upslope.sources import resume
    from upslope.sources.catalog import Catalog

    c, source, calls = Catalog(spark, new_path(spark, "catalog")), spark.range(40).selectExpr("nullif(id, 7) k", "id v"), []

    def parse(df):
        if len(calls) == 2:
            calls.append(None)
            raise RuntimeError("stopped")
        calls.append(df.count())
        return df

    with pytest.raises(RuntimeError):
        resume.process_in_chunks(c, "raw", "t", source, "k", parse, 5)
    assert c.read("raw", "t").count() == sum(calls[:2])
    resume.process_in_chunks(c, "raw", "t", source, "k", parse, 5)
    assert sorted(r.v for r in c.read("raw", "t").collect()) == [i for i in range(40) if i != 7]
    assert resume.process_in_chunks(c, "raw", "t", source, "k", parse, 5) == 0


def test_profile_pages(spark):
    page = """<html><script>var a = "<td>x</td>";</script><h3 class="large-title">JANE O'DOE (SR-4)</h3><a href="/teams/tf/CA_x.html">STATE U</a><div>College Bests</div>
    <div id="session-history"><h3 class="outdoors">2021 Season</h3><div><a href="https://x.org/results/11/22/M?q">a</a></div><h3>2020 XC</h3><div><a href="/results/xc/9/Meet">b</a></div></div>
    <div id="meet-results"><table><thead><tr><th><a href="/results/11/Meet">Big <b>Meet</b></a> <span>May 1, 2021</span></th></tr></thead>
    <tr class="highlight"><td>100<td><a href="/results/11/22/M/">10.52</a> <span>(+1.2)</span><span>34' 5"</span></td><td>3rd (F)</td></tr><tr><td>x</td></tr><tr><td>no link<td>1<td>2</tr></table>
    <div class="transfer">Competing for Old College &darr;</div><table><thead><tr><th><a href="/results/xc/9/Meet">XC</a><span>Nov 2019</span></thead><tr><td>8K</td><td><a href="/results/xc/9/Meet">25:00</a></td><td>12</td></tr></table>
    <table><tr><td>no head</td><td><a href="/results/1/2">1</a></td><td>1</td></tr></table></div>"""
    nested = "<div id=meet-results><table><thead><a href=/results/1>M</a></thead><tr><td>a<td><a href=/results/1/2>9<table><tr><td>in</table></a><td>1"
    rows = [(1, page, ["Other", "state-u"]), (2, None, None), (3, "", []), (4, page.replace("meet-results", "none"), None), (5, nested, None), (6, "<p>" * 20000 + "</div>" * 20000, None), (None, "<div id=meet-results><a href='http://[x/results/'>", [None])]
    parsed = profiles.parse_profiles(spark.createDataFrame(rows, "page_id long, html string, schools array<string>"), schools_col="schools")
    got = {r.page_id: r for r in parsed.collect()}
    assert len(got) == 7
    assert {k for k, r in got.items() if r.status != "OK"} == {2, 3, 4, 6} and not got[4].results and got[4].name == "Jane O'Doe"
    r = got[1]
    assert (r.name, r.class_year, r.school, r.team_id) == ("Jane O'Doe", "SR-4", "state-u", "CA_x")
    assert [(s.school, s.marker, s.is_current) for s in r.sections] == [("state-u", None, True), ("Old College", "Competing for Old College ↓", False)]
    assert [tuple(x)[:16] for x in r.results] == [
        (0, 0, "2021", "Outdoor", "2021 Season", "11", "22", "Big Meet", "May 1, 2021", "100", "10.52", "34' 5\"", "+1.2", "3rd", "F", "3rd (F)"),
        (1, 1, "2020", "Cross Country", "2020 XC", "9", None, "XC", "Nov 2019", "8K", "25:00", None, None, "12", None, "12"),
    ]
    assert [x.kind for x in r.links] == ["MEET_OR_RESULTS_PAGE", "RESULT_DETAIL", "XC_RESULT_OR_MEET", "RESULT_DETAIL"]
    assert got[None].sections[0].school == "[UNRESOLVED CURRENT SCHOOL]" and not got[None].links
    assert parsed.limit(0).count() == 0 and profiles.unfold(parsed, "results").where("page_id = 1").count() == 2


def test_resolved_rows_take_the_first_method_that_finds_any(spark):
    targets = spark.createDataFrame([(1, 7, "Ann Lee", "10.52"), (1, 8, "Bob Roe", "10.52"), (1, 9, "José  Díaz", None), (2, 7, "Ann Lee", "9"), (1, None, None, "10.52")], "page_id long, person_id long, name string, mark string")
    rows = [(1, 0, None, "Ann Lee", "x 10.52"), (1, 1, 7, "Someone", "y"), (1, 2, None, "Rob Roe", "10.52h"), (1, 3, None, "Bobby Roe", "10.52"), (1, 4, None, "Bob Row", "11.0"), (1, 5, None, "JOSE Diaz", ""), (1, 6, None, None, "10.52")]
    got = resolve_rows(targets, spark.createDataFrame(rows, "page_id long, row_index int, link_id long, link_name string, row_text string")).collect()
    assert sorted((r.person_id, r.row_index, r.method, round(r.score, 4)) for r in got) == [(7, 1, "id", 1.0), (8, 3, "similar", 0.9), (9, 5, "name", 1.0)]


def plain_resolution(targets, rows):
    """The rows of each target by looking at every pair of a page."""
    def token(text):
        return re.sub("[^a-z0-9.:]", "", (text or "").lower())

    found = []
    for t in targets:
        pairs = []
        for r in rows:
            if t[0] is None or t[0] != r[0]:
                continue
            a, b = folded(t[2]), folded(r[3])
            if t[1] is not None and t[1] == r[2]:
                pairs.append((1, -1.0, r[1]))
            elif a and a == b:
                pairs.append((2, -1.0, r[1]))
            elif a and r[3] is not None and token(t[3]) and token(t[3]) in token(r[4]):
                last, first = (SequenceMatcher(None, a.split(" ")[k], b.split(" ")[k], autojunk=False).ratio() for k in (-1, 0))
                if last >= 0.8 and first >= 0.4:
                    pairs.append((3, -(0.6 * last + 0.4 * first), r[1]))
        found += [(*t, row, ["id", "name", "similar"][step - 1], -cost) for step, cost, row in pairs if (step, cost) == min(pairs)[:2]]
    return found


def test_resolved_rows_equal_a_look_at_every_pair(spark):
    draw = random.Random(5)
    firsts, lasts = ["Ann", "Anne", "ÁNN", "Bob", "Rob", "Bobby", "Zoe"], ["Lee", "Leigh", "Diaz", "Díaz", "Díez", "Roe", "Rowe", "Garcia-Lopez", "García Lopes"]
    odd = [None, "", " ", "\t", "\u0301", "Ann Lee", "Ann  Lee\n", "Lee", "Ann \u0301"]
    marks = [None, "", "h", "9", "10.5", "10.52", "1:02.5", "Long jump 7.12m (+1.2) and more", "long jump 7.12m (+1.2) and less"]

    def name():
        return draw.choice(odd) if draw.random() < 0.2 else f"{draw.choice(firsts)} {draw.choice(lasts)}"

    def some(n):
        return draw.choice([None, *range(n)])

    targets = [(some(3), some(60), name(), draw.choice(marks)) for _ in range(150)]
    rows = [(some(3), i, some(60) if draw.random() < 0.2 else None, name(), " ".join(str(draw.choice(marks)) for _ in range(3))) for i in range(150)]
    rows += rows[:5]
    left = spark.createDataFrame(targets, "page_id long, person_id long, name string, mark string")
    right = spark.createDataFrame(rows, "page_id long, row_index int, link_id long, link_name string, row_text string")
    want = Counter(plain_resolution(sorted(set(targets), key=str), rows))
    got = Counter(map(tuple, resolve_rows(left.distinct(), right).collect()))
    assert got == want and {m[-2] for m in want} == {"id", "name", "similar"}
    assert resolve_rows(left.limit(0), right).count() == resolve_rows(left, right.limit(0)).count() == 0


def test_resolved_rows_join_no_pairs_of_a_page(spark):
    n = 300
    targets = spark.range(n).selectExpr("1L AS page_id", "id AS person_id", "concat('Ann Key', id) AS name", "concat('m', id, '.5') AS mark")
    rows = spark.range(n).selectExpr("1L AS page_id", "id AS row_index", "CAST(NULL AS LONG) AS link_id", "concat('Anne Key', id) AS link_name", "concat('1 (M', id, '.5)') AS row_text")
    assert len(resolve_rows(targets, rows).collect()) == n
    store = spark._jsparkSession.sharedState().statusStore()
    run = store.executionsList().last().executionId()
    metrics, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
    made = []
    for i in range(nodes.size()):
        for k in range(nodes.apply(i).metrics().size()):
            m = nodes.apply(i).metrics().apply(k)
            if m.name() == "number of output rows" and metrics.contains(m.accumulatorId()):
                made.append(int(metrics.apply(m.accumulatorId()).replace(",", "")))
    assert n <= max(made) <= 10 * n
