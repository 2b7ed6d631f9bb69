"""Parsers and column helpers on hand-written cases."""

import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from upslope.functions import exprs, marks, text

MARKS = [
    ("time", "10.52", "parsed", 10.52, False),
    ("time", "1:52.31", "parsed", 112.31, False),
    ("time", "29:15.4h", "parsed", 1755.4, True),
    ("time", "1:02:03", "parsed", 3723.0, False),
    ("time", "61:00", "parsed", 3660.0, False),
    ("time", "1:75", "unrecognized", None, False),
    ("time", "10.9A", "parsed", 10.9, True),
    ("time", "10.52 #", "parsed", 10.52, True),
    ("time", "DNF", "status", None, False),
    ("time", "dns", "status", None, False),
    ("time", "", "blank", None, False),
    ("time", None, "blank", None, False),
    ("distance", "7.45m", "parsed", 7.45, False),
    ("distance", "24-05.50", "parsed", (24 * 12 + 5.5) * 0.0254, False),
    ("distance", "18' 3.5\"", "parsed", (18 * 12 + 3.5) * 0.0254, False),
    ("distance", "18’ 3.5”", "parsed", (18 * 12 + 3.5) * 0.0254, False),
    ("distance", "18' 12.5\"", "unrecognized", None, False),
    ("distance", "FOUL", "status", None, False),
    ("points", "5123", "parsed", 5123.0, False),
    ("points", "5,123", "unrecognized", None, False),
]


def test_marks(spark):
    df = spark.createDataFrame([(i, k, r) for i, (k, r, *_) in enumerate(MARKS)], "i int, k string, r string")
    got = {r.i: r.m for r in df.select("i", marks.parse_mark(F.col("k"), F.col("r")).alias("m")).collect()}
    for i, (_, raw, state, value, annotated) in enumerate(MARKS):
        assert (got[i].state, got[i].annotated) == (state, annotated), raw
        assert got[i].value is None if value is None else math.isclose(got[i].value, value), raw


DATES = [
    ("Mar 5, 2021", (2021, 3, 5), (2021, 3, 5)),
    ("March 5-6, 2021", (2021, 3, 5), (2021, 3, 6)),
    ("Mar 30 – Apr 1, 2021", (2021, 3, 30), (2021, 4, 1)),
    ("Dec 31 - Jan 1, 2022", (2021, 12, 31), (2022, 1, 1)),
    ("Feb 30, 2021", None, None),
    ("soon", None, None),
    (None, None, None),
]


def test_date_ranges(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(DATES)], "i int, t string")
    got = {r.i: r.r for r in df.select("i", text.parse_date_range(F.col("t")).alias("r")).collect()}
    for i, (t, a, b) in enumerate(DATES):
        assert (got[i].first, got[i].last) == (a and dt.date(*a), b and dt.date(*b)), t


@pytest.mark.parametrize(
    "raw,want",
    [
        ("/a/b/?x=1#y", "https://e.org/a/b"),
        ("HTTP://E.org//x/", "https://e.org//x"),
        ("//Other.org/z", "https://other.org/z"),
        ("rel/path", "https://e.org/rel/path"),
        ("https:///e.org/q", "https://e.org/q"),
        (" ", None),
        (None, None),
    ],
)
def test_urls(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "u string")
    assert df.select(text.normal_url(F.col("u"), "e.org").alias("u")).first().u == want


def test_event_families(spark):
    cases = {"100 Meters": "sprints", "400m Hurdles": "hurdles", "4x100 Relay": "relays", "800": "middle", "Mile": "middle", "5000m": "distance", "2 Mile": "distance", "High Jump": "jumps", "Hammer": "throws", "Decathlon": "combined", "3000m Steeplechase": "distance", "Chess": "other"}
    df = spark.createDataFrame([(k,) for k in cases], "e string")
    assert {r.e: r.f for r in df.select("e", text.event_family(F.col("e")).alias("f")).collect()} == cases


def test_names_and_distances(spark):
    df = spark.createDataFrame([("Université de Montréal & Co @ Home", "4M"), (None, "8k"), ("A+B", "5000"), ("x", "500")], "n string, d string")
    got = df.select(text.name_key(F.col("n")).alias("n"), text.course_metres(F.col("d")).alias("d")).collect()
    assert [r.n for r in got] == ["universitedemontrealandcoathome", "", "aandb", "x"]
    assert [r.d for r in got] == [4 * 1609.344, 8000.0, 5000.0, None]
    folded = spark.createDataFrame([("Šimić Łódź",), ("ﬁn ²",), ("Straße",), ("Ångström, J.",)], "n string").select(text.name_key(F.col("n")).alias("n")).collect()
    assert [r.n for r in folded] == ["simicodz", "fin2", "strasse", "angstromj"]


def test_all_status_codes_and_bare_metres(spark):
    rows = [("time", c) for c in marks.STATUS_CODES] + [("distance", " d.q. "), ("distance", "7.45"), ("distance", "dsq."), ("time", "10.5.")]
    got = [r.m for r in spark.createDataFrame(rows, "k string, r string").select(marks.parse_mark(F.col("k"), F.col("r")).alias("m")).collect()]
    assert [m.kind for m in got[:15]] == list(marks.STATUS_CODES) and {m.state for m in got[:15]} == {"status"}
    assert got[15].state == "unrecognized" and (got[16].kind, got[16].value) == ("metric", 7.45) and got[17].kind == "DSQ" and got[18].value == 10.5


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-5, 5)), st.one_of(st.none(), st.integers(-5, 5))), min_size=1, max_size=8))
def test_safe_corr_matches_the_definition(spark, pairs):
    df = spark.createDataFrame([(None if a is None else float(a), None if b is None else float(b)) for a, b in pairs], "a double, b double")
    got = df.agg(exprs.safe_corr("a", "b").alias("r")).first().r
    both = [(a, b) for a, b in pairs if a is not None and b is not None]
    n = len(both)
    sa = sum((a - sum(x for x, _ in both) / n) ** 2 for a, _ in both) if n else 0
    sb = sum((b - sum(y for _, y in both) / n) ** 2 for _, b in both) if n else 0
    if sa < 1e-12 or sb < 1e-12:
        assert got is None
    else:
        ma, mb = sum(a for a, _ in both) / n, sum(b for _, b in both) / n
        assert math.isclose(got, sum((a - ma) * (b - mb) for a, b in both) / math.sqrt(sa * sb), abs_tol=1e-9)


def test_rank_strength_of_one(spark):
    df = spark.createDataFrame([(1, 1), (1, 3), (3, 3)], "r int, n int")
    assert [r[0] for r in df.select(exprs.rank_strength("r", "n")).collect()] == [1.0, 1.0, 0.0]
    assert df.select(exprs.rank_strength("r", "n", None)).first()[0] is None


def test_name_similarity_and_best_match(spark):
    from upslope.functions.similarity import best_match

    left = spark.createDataFrame([(1, "José Núñez"), (1, "Ann Lee"), (2, None)], "team int, a string")
    right = spark.createDataFrame([(1, "Jose Nunez"), (1, "Jon Nunes"), (2, "Ann Lee")], "team int, b string")
    got = best_match(left, right, ["team"], "a", "b").collect()
    assert [(r.a, r.b, r.similarity) for r in got] == [("José Núñez", "Jose Nunez", 1.0)]
