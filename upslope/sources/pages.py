"""Result pages: tables of marks by meet and season, parsed in Arrow batches with the standard library."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = {"br", "hr", "img", "input", "link", "meta", "area", "base", "col", "source", "wbr"}


class TableReader(HTMLParser):
    """Collects headings, links and the rows of tables; a row belongs to the last heading before it.

    A cell that is not closed ends with the next cell or row.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.heading, self.hidden = "", "", 0
        self.rows: list[tuple[str, list[str], list[str]]] = []
        self.row: list[str] | None = None
        self.links: list[str] = []
        self.target: list[str] | None = None
        self.text: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in ("h1", "h2", "h3", "h4", "caption", "title"):
            self.text, self.target = [], self.text
        elif tag == "tr":
            self._end_row()
            self.row, self.links = [], []
        elif tag in ("td", "th") and self.row is not None:
            self._end_cell()
            self.text, self.target = [], self.row
        elif tag == "a" and self.row is not None:
            self.links += [v for k, v in attrs if k == "href" and v]
        elif tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("h1", "h2", "h3", "h4", "caption"):
            self.heading, self.target = self._shown(), None
        elif tag == "title":
            self.title, self.target = self._shown(), None
        elif tag in ("td", "th"):
            self._end_cell()
        elif tag in ("tr", "table"):
            self._end_row()

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)

    def close(self):
        super().close()
        self._end_row()

    def _shown(self) -> str:
        return re.sub(r"\s+", " ", "".join(self.text)).strip()

    def _end_cell(self):
        if self.row is not None and self.target is self.row:
            self.row.append(self._shown())
            self.target = None

    def _end_row(self):
        self._end_cell()
        if self.row:
            self.rows.append((self.heading, self.row, self.links))
        self.row = None


_WIND = re.compile(r"\(?([+-]?\d+\.\d)\)?\s*$")
_PLACE = re.compile(r"^\s*(\d+)(?:st|nd|rd|th)?\s*(?:\(([A-Za-z]+)\))?\s*$")


def split_mark(cell: str) -> tuple[str, str | None, str | None]:
    """(mark, secondary mark, wind) of a cell such as ``7.45m 24-5.5 (+1.2)``."""
    wind = None
    m = _WIND.search(cell)
    if m and (cell[: m.start()].strip()) and ("(" in m[0] or m[1][0] in "+-"):
        wind, cell = m[1], cell[: m.start()]
    parts = cell.split()
    return (parts[0] if parts else "", " ".join(parts[1:]) or None, wind)


def split_place(cell: str) -> tuple[int | None, str | None]:
    """(place, round) of a cell such as ``3rd (F)``."""
    m = _PLACE.match(cell)
    return (int(m[1]), m[2]) if m else (None, None)


def parse_result_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per table row of each page.

    Returns ``id_col``, ``row_index``, ``page_title``, ``section`` (heading above), ``cells``, ``links``, ``event`` (first
    cell), ``mark``, ``secondary_mark``, ``wind``, ``place`` and ``round`` (last cell).  Null html and pages without tables
    give no rows.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    names = ["id", "row_index", "page_title", "section", "cells", "links", "event", "mark", "secondary_mark", "wind", "place", "round"]
    types = [None, pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.string()] * 4, pa.int32(), pa.string()]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = TableReader()
                reader.feed(html or "")
                reader.close()
                for i, (section, cells, links) in enumerate(reader.rows):
                    mark, second, wind = split_mark(cells[1]) if len(cells) > 1 else ("", None, None)
                    out.append((page, i, reader.title, section, cells, links, cells[0], mark or None, second, wind, *(split_place(cells[-1]) if len(cells) > 2 else (None, None))))
            kinds = [batch.schema.field(0).type, *types[1:]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    schema = f"id {kind}, row_index int, page_title string, section string, cells array<string>, links array<string>, event string, mark string, secondary_mark string, wind string, place int, round string"
    return pages.select(id_col, html_col).mapInArrow(parse, schema).withColumnRenamed("id", id_col)


def list_items(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, position, href, label) of the links in list items, natively."""
    item = r"(?is)<li[^>]*>\s*<a[^>]*href=[\"']([^\"']*)[\"'][^>]*>([^<]*)"
    html = F.coalesce(F.col(html_col), F.lit(""))
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(item), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(item), F.lit(2)).alias("label"))
    out = pages.select(id_col, F.posexplode(pairs).alias("position", "p"))
    return out.select(id_col, F.col("position").cast("long").alias("position"), "p.href", "p.label")


def page_fields(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, title, lang, paragraphs, links) natively."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    return pages.select(
        id_col,
        F.regexp_extract(html, r"(?is)<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract(html, r"(?is)<html[^>]*lang=\"([^\"]*)\"", 1).alias("lang"),
        F.regexp_count(html, F.lit(r"(?i)<p[ >]")).cast("long").alias("paragraphs"),
        F.regexp_count(html, F.lit(r"(?i)<a ")).cast("long").alias("links"),
    )


_RECORD_LINE = re.compile(r"^(?P<mark>\d[\d:.'\"\- ]*m?)\s{2,}(?P<holder>[^\d,][^,]*?)(?:,\s*(?P<school>.*?))?(?:\s{2,}(?P<date>.*\d{4}))?$")


def parse_record_text(text: str) -> list[tuple[str, str, str, str | None, str | None]]:
    """(event, mark, holder, school, date) of a plain-text record list: a line without a mark names the event of those below it."""
    event, out = "", []
    for line in text.splitlines():
        line = line.strip()
        m = _RECORD_LINE.match(line)
        if m and event:
            out.append((event, m["mark"].strip(), m["holder"].strip(), m["school"] or None, m["date"] or None))
        elif line and not m:
            event = line.rstrip(":")
    return out


def parse_record_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Records of each page, from its table rows or, without any, from its text line by line."""
    kind = pages.schema[id_col].dataType.simpleString()
    names = ["id", "row_index", "event", "mark", "holder", "school", "record_date"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = TableReader()
                reader.feed(html or "")
                reader.close()
                rows = [(c[0], c[1], c[2], *([*c[3:5], None, None][:2])) for _, c, _ in reader.rows if len(c) >= 3 and any(x.isdigit() for x in c[1])]
                rows = rows or parse_record_text(re.sub(r"<[^>]*>", "\n", html or ""))
                out += [(page, i, *r) for i, r in enumerate(rows)]
            kinds = [batch.schema.field(0).type, pa.int32(), *[pa.string()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    return pages.select(id_col, html_col).mapInArrow(parse, f"id {kind}, row_index int, event string, mark string, holder string, school string, record_date string").withColumnRenamed("id", id_col)
