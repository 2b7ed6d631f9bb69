"""Line deduplication by site-relative frequency.

A line is boilerplate of a site if the share of the site's pages that hold it exceeds
a ratio.  Lines of one page count once, so counting (site, line) pairs needs
one row per task and pair after map-side combine, however large the site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upslope.llm.url_filter import url_host
from upslope.scratch import materialize

_HIDDEN = r"(?is)<!--.*?-->|<(?:script|style|head)\b.*?</(?:script|style|head)\s*>"
_BLOCK = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|th|thead|title|tr|ul)\b[^>]*>"


def html_lines(html: Column) -> Column:
    """The visible lines of a page: block tags end a line, other tags vanish, blank lines drop out."""
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, "\n")
    shown = F.regexp_replace(F.regexp_replace(shown, _BLOCK, "\n"), r"<[^>]*>", "")
    return text_lines(shown)


def text_lines(text: Column) -> Column:
    """Lines of a text, trimmed of spaces and tabs, without blank ones."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "[\n\r]+"), lambda x: F.regexp_replace(x, r"^[ \t]+|[ \t]+$", ""))
    return F.filter(lines, lambda x: x != "")


def boilerplate_lines(pages: DataFrame, host_col: str, lines_col: str, ratio: tuple[int, int] = (1, 10), min_pages: int = 5) -> DataFrame:
    """(host, line_hash, n_pages, host_pages) of lines on more than ``ratio`` of a host's pages.

    Lines on fewer than ``min_pages`` pages are never boilerplate, so a small site keeps its text.
    A null host is a site of its own.  Lines are told apart by a 64-bit hash.
    """
    per_host = pages.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("host_pages"))
    held = pages.select(F.col(host_col).alias("h"), F.explode(F.array_distinct(F.transform(lines_col, lambda x: F.xxhash64(x)))).alias("line_hash"))
    counts = held.groupBy("h", "line_hash").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_pages)
    joined = counts.join(per_host, F.col("h").eqNullSafe(F.col("host")))
    return joined.where(F.col("n_pages") * ratio[1] > F.col("host_pages") * ratio[0]).select("host", "line_hash", "n_pages", "host_pages")


def dedup_lines(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    ratio: tuple[int, int] = (1, 10),
    min_pages: int = 5,
) -> DataFrame:
    """Every page with its visible lines less the boilerplate of its host.

    Returns ``id_col``, ``host``, ``n_lines``, ``n_dropped`` and ``text`` (the kept
    lines, joined by newlines).  Null html has no lines; a null url or one without a
    host belongs to the site with the empty name; repeated pages count as
    often as they are in the table; a line that repeats within a page counts once and
    is dropped at all its places; an empty table gives no rows.
    """
    cut = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), html_lines(F.col(html_col)).alias("lines"))
    cut = materialize(cut, "lines")
    bad = materialize(boilerplate_lines(cut, "host", "lines", ratio, min_pages).select("host", "line_hash"), "boilerplate")
    by_host = bad.groupBy(F.col("host").alias("bad_host")).agg(F.collect_set("line_hash").alias("bad"))
    joined = cut.join(by_host, F.col("host") == F.col("bad_host"), "left")
    none = F.array().cast("array<bigint>")
    kept = F.filter("lines", lambda x: ~F.array_contains(F.coalesce("bad", none), F.xxhash64(x)))
    return joined.withColumn("kept", kept).select(
        id_col,
        "host",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("text"),
    )
