"""Every registered query that has SQL, on the smallest tables, against DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.queries() if n in entry.oracle_sql()]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 4) + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat().removesuffix("T00:00:00")
    return str(v)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, small, duck, name):
    df = entry.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(entry.oracle_sql()[name])
    at = [d[0] for d in result.description]
    assert sorted(at) == columns
    want = sorted(tuple(plain(r[at.index(c)]) for c in columns) for r in result.fetchall())
    assert len(got) == len(want)
    assert got == want, next((a, b) for a, b in zip(got, want) if a != b)


def test_resolved_scores_equal_sql_to_the_last_digit(spark, medium):
    name = "id_resolve_rows"
    columns = ["page_id", "person_id", "row_index", "method", "score"]
    got = entry.queries()[name](spark, medium)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{medium}/supplier.parquet')")
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want)


def test_every_query_name_is_registered_once():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
