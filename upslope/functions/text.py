"""Dates, addresses, events, names and distances as they stand in source pages."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_DATE = r"(?i)^([a-z]{3})[a-z]*\.?\s+(\d{1,2})(?:\s*-\s*(?:([a-z]{3})[a-z]*\.?\s+)?(\d{1,2}))?,?\s+(\d{4})$"


def _month(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(name)).cast("int")


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", y, F.lpad(m.cast("string"), 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def parse_date_range(text: Column) -> Column:
    """Struct (first, last) of "Mar 5, 2021", "Mar 5-6, 2021" or "Mar 30 - Apr 1, 2021"; nulls if none fits.

    A range that would end before it begins starts in the year before.
    """
    x = F.regexp_replace(F.trim(text), "[‐-―−]", "-")

    def part(i: int) -> Column:
        return F.regexp_extract(x, _DATE, i)

    start_month = _month(part(1))
    end_month = F.when(part(3) == "", start_month).otherwise(_month(part(3)))
    end_day = F.when(part(4) == "", part(2)).otherwise(part(4))
    last = _date(part(5), end_month, end_day)
    year = F.try_to_number(F.nullif(part(5), F.lit("")), F.lit("9999")).cast("int")
    first_year = F.when(start_month > end_month, year - 1).otherwise(year).cast("string")
    first = _date(first_year, start_month, part(2))
    fits = x.rlike(_DATE) & first.isNotNull() & last.isNotNull() & (first <= last)
    return F.struct(F.when(fits, first).alias("first"), F.when(fits, last).alias("last"))


def normal_url(url: Column, host: str) -> Column:
    """Absolute address of a link on ``host``: https, lower-case host, without query, fragment and last slash; null if empty."""
    x = F.nullif(F.trim(url), F.lit(""))
    x = F.regexp_replace(x, r"(?i)^https?:/+", "https://")
    full = (
        F.when(x.startswith("https://"), x)
        .when(x.startswith("//"), F.concat(F.lit("https:"), x))
        .when(x.startswith("/"), F.concat(F.lit(f"https://{host}"), x))
        .otherwise(F.concat(F.lit(f"https://{host}/"), x))
    )
    full = F.regexp_replace(F.regexp_replace(full, r"[?#].*$", ""), r"/+$", "")
    at = r"^https://([^/]*)(.*)$"
    return F.when(x.isNotNull(), F.concat(F.lit("https://"), F.lower(F.regexp_extract(full, at, 1)), F.regexp_extract(full, at, 2)))


def event_family(name: Column) -> Column:
    """Family of an event by its name, and for plain runs by its distance in metres."""
    x = F.lower(F.trim(name))
    m = F.try_to_number(F.nullif(F.regexp_extract(x, r"(\d{2,5})", 1), F.lit("")), F.lit("99999")).cast("int")
    return (
        F.when(x.rlike("relay|^4 ?x"), "relays")
        .when(x.rlike("hurdle"), "hurdles")
        .when(x.rlike("decathlon|heptathlon|pentathlon"), "combined")
        .when(x.rlike("steeple"), "distance")
        .when(x.rlike("shot|discus|hammer|javelin|weight"), "throws")
        .when(x.rlike("jump|vault"), "jumps")
        .when(x.rlike("mile"), F.when(x.rlike(r"^(1 )?mile"), "middle").otherwise("distance"))
        .when(m.between(50, 400), "sprints")
        .when((m > 400) & (m < 2000), "middle")
        .when(m >= 2000, "distance")
        .otherwise("other")
    )


@F.pandas_udf(StringType())
def _folded(names: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, case folded; Spark has no such function."""

    def fold(x: str) -> str:
        return x.lower() if x.isascii() else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).casefold()

    return names.map(fold)


def name_key(name: Column) -> Column:
    """ASCII letters and digits of a name, folded (é to e, ﬁ to fi, ² to 2); & and + read and, @ reads at. Null becomes empty."""
    x = _folded(F.coalesce(name, F.lit("")))
    x = F.regexp_replace(F.regexp_replace(x, "[&+]", "and"), "@", "at")
    return F.regexp_replace(x, "[^a-z0-9]", "")


def course_metres(text: Column) -> Column:
    """Metres of a cross-country distance: 5K, 8k, 4M or 4 mi (miles), or bare 1000 to 20000."""
    x = F.trim(text)

    def number(pattern: str) -> Column:
        return F.try_to_number(F.nullif(F.regexp_extract(x, pattern, 1), F.lit("")), F.lit("999999.999")).cast("double")

    mile, km, bare = r"^(\d+(?:\.\d+)?)\s*(?:M|(?i:mi|miles?))$", r"^(\d+(?:\.\d+)?)\s*(?i:k|km|kilomet(?:er|re)s?)$", r"^(\d{4,5})\s*m?$"
    plain = number(bare)
    return F.coalesce(number(mile) * 1609.344, number(km) * 1000.0, F.when(plain.between(1000, 20000), plain))


def nearest(value: Column, standards: list[float]) -> Column:
    """Struct (standard, difference, relative) of the nearest standard, the smaller one of equally near."""
    best = F.array_min(F.array(*(F.struct(F.abs(value - s).alias("difference"), F.lit(float(s)).alias("standard")) for s in standards)))
    hit = F.when(value.isNotNull(), best)
    return F.struct(hit["standard"].alias("standard"), hit["difference"].alias("difference"), (hit["difference"] / hit["standard"]).alias("relative"))
