"""Parsing of result marks with native expressions: one pass, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes that stand in place of a mark.
STATUS_CODES = ("DNF", "DNS", "DQ", "DSQ", "NM", "NH", "NT", "SCR", "FS", "FOUL", "WD", "ND", "NP", "ENR", "PASS")
_SPACE = "[   \\s]+"
_DASH = "[‐-―−]"
_PRIME = "[‘’′`]"
_DOUBLE = "[“”″]"
_NOTE = r"(?i)(?:\s*(?:[#@*+$!]|\([^)]*\)|\[[^\]]*\]|[a-z](?<![hm]))\s*)+$"
_HMS = r"^(\d{1,2}):([0-5]?\d):([0-5]?\d(?:\.\d+)?)$"
_MS = r"^(\d{1,3}):([0-5]?\d(?:\.\d+)?)$"
_S = r"^(\d+(?:\.\d+)?)$"
_METRIC = r"(?i)^(\d+(?:\.\d+)?)\s*(?:m|meters?|metres?)?$"
_FEET = r"(?i)^(\d+)\s*(?:'|-|ft\.?)\s*(?:(\d+(?:\.\d+)?)\s*(?:\"|''|in\.?)?)?$"
_POINTS = r"(?i)^(\d+(?:\.\d+)?)\s*(?:pts?|points?)?$"


def clean_mark(raw: Column) -> Column:
    """Trimmed text with plain spaces, dashes and quotes; null becomes empty."""
    x = F.coalesce(raw.cast("string"), F.lit(""))
    for pattern, plain in ((_DASH, "-"), (_PRIME, "'"), (_DOUBLE, '"'), (_SPACE, " ")):
        x = F.regexp_replace(x, pattern, plain)
    return F.trim(x)


def parse_mark(mark_type: Column, raw: Column) -> Column:
    """Struct (state, kind, value, annotated) of a mark.

    ``mark_type`` is time, distance or points.  state is ``blank``, ``status``,
    ``parsed`` or ``unrecognized``; kind says which form matched (or the status code);
    value is in seconds, metres or points and null unless parsed.  In h:m:s minutes
    and seconds are below 60, in m:s only seconds; inches are below 12.  A distance without a unit is in
    metres.  Codes may be in either case, with spaces or with full stops at their ends.
    """
    text = clean_mark(raw)
    upper = F.regexp_replace(F.regexp_replace(F.upper(text), r"^\.+|\.+$", ""), " ", "")
    bare = F.regexp_replace(text, _NOTE, "")
    annotated = (bare != text) & (bare != "") & ~((mark_type == "points") & text.rlike(_POINTS))  # the unit is no annotation
    bare = F.when(bare == "", text).otherwise(bare)
    timed = F.regexp_replace(F.regexp_replace(bare, r"(?i)\s*\.?h$", ""), r"\.$", "")
    hand = (mark_type == "time") & (timed != bare)

    def group(x: Column, pattern: str, i: int) -> Column:
        return F.try_to_number(F.nullif(F.regexp_extract(x, pattern, i), F.lit("")), F.lit("9999999999.999999")).cast("double")

    none = F.lit(None).cast("double")
    inches = F.coalesce(group(bare, _FEET, 2), F.lit(0.0))
    forms = [
        ("time", timed.rlike(_HMS), "hms", group(timed, _HMS, 1) * 3600 + group(timed, _HMS, 2) * 60 + group(timed, _HMS, 3)),
        ("time", timed.rlike(_MS), "ms", group(timed, _MS, 1) * 60 + group(timed, _MS, 2)),
        ("time", timed.rlike(_S), "s", group(timed, _S, 1)),
        ("distance", bare.rlike(_METRIC), "metric", group(bare, _METRIC, 1)),
        ("distance", bare.rlike(_FEET) & (inches < 12), "imperial", (group(bare, _FEET, 1) * 12 + inches) * 0.0254),
        ("points", bare.rlike(_POINTS), "points", group(bare, _POINTS, 1)),
    ]
    kind, value = F.lit(None).cast("string"), none
    for of, fits, name, v in reversed(forms):
        hit = (mark_type == of) & fits
        kind, value = F.when(hit, name).otherwise(kind), F.when(hit, v).otherwise(value)
    status = upper.isin(*STATUS_CODES)
    state = F.when(text == "", "blank").when(status, "status").when(value.isNotNull(), "parsed").otherwise("unrecognized")
    return F.struct(
        state.alias("state"),
        F.when(state == "status", upper).when(state == "parsed", kind).alias("kind"),
        F.when(state == "parsed", value).alias("value"),
        ((state == "parsed") & (annotated | hand)).alias("annotated"),
    )
