"""Profile pages: a person's header, season list, schools and results, read in one pass over the html.

The reader keeps a stack of open elements instead of a tree; text goes to the
elements that asked for it, and what belongs together is joined at the end.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = {"br", "hr", "img", "input", "link", "meta", "area", "base", "col", "source", "wbr"}
_HEADER_LINES = 150

# Names of states and kinds, ids and classes of the pages.
OK, NO_PANEL, UNRESOLVED = "OK", "MEET_RESULTS_PANEL_NOT_FOUND", "[UNRESOLVED CURRENT SCHOOL]"
CURRENT, TRANSFER = "PROFILE_CURRENT_SCHOOL", "PROFILE_TRANSFER_MARKER"
XC_KIND, DETAIL_KIND, MEET_KIND, OTHER_KIND = "XC_RESULT_OR_MEET", "RESULT_DETAIL", "MEET_OR_RESULTS_PAGE", "OTHER"
SEASONS, RESULTS = "session-history", "meet-results"
_TRANSFER = re.compile(r"competing\s+for\s+(.+)", re.I)
SEASON_TYPES = [("Outdoor", "outdoor"), ("Indoor", "indoor"), ("Cross Country", r"\bxc\b|cross[ _-]country")]

_YEAR = re.compile(r"\b(?:19|20)\d{2}\b")
_DETAIL = re.compile(r"^/results/\d+/\d+(?:/|$)", re.I)
_ROUND = re.compile(r"\(([^()]*)\)")
_WIND = re.compile(r"\(([+-]?\d+(?:\.\d+)?)\)")

RESULT = "struct<section_index:int,row_index:int,season_year:string,season_type:string,season_label:string,meet_id:string,result_id:string,meet_name:string,meet_date:string,event:string,mark:string,secondary_mark:string,wind:string,place:string,round:string,raw_place:string,meet_url:string,result_url:string,highlighted:boolean>"
SECTION = "struct<section_index:int,school:string,marker:string,method:string,is_current:boolean>"
LINK = "struct<section_index:int,url:string,url_sha256:string,kind:string>"


def url_path(url: str) -> str:
    """The path of an address without a final slash; an address that cannot be split has none."""
    try:
        return urlsplit(url).path.rstrip("/")
    except ValueError:
        return ""


def result_ids(url: str) -> tuple[str | None, str | None]:
    """(meet, result) numbers behind ``results`` in a path; cross-country paths name a meet only."""
    parts = [p for p in url_path(url).split("/") if p]
    rest = parts[parts.index("results") + 1 :] if "results" in parts else []
    if rest and rest[0].lower() == "xc":
        return (rest[1] if len(rest) > 1 and rest[1].isdigit() else None), None
    if not rest or not rest[0].isdigit():
        return None, None
    return rest[0], rest[1] if len(rest) > 1 and rest[1].isdigit() else None


def url_kind(path: str) -> str:
    low = path.lower()
    if low.startswith("/results/xc/"):
        return XC_KIND
    if _DETAIL.match(path):
        return DETAIL_KIND
    return MEET_KIND if low.startswith("/results/") else OTHER_KIND


def season_type(label: str, classes: set[str]) -> str | None:
    """Season of a heading, by its classes or its words."""
    said = " ".join([label.lower(), *sorted(classes)])
    return next((name for name, pattern in SEASON_TYPES if re.search(pattern, said)), None)


def _folded(name: str) -> str:
    return " ".join(re.findall(r"[a-z0-9]+", name.lower()))


class ProfileReader(HTMLParser):
    """Collects what a profile page says; ``finish`` joins it."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base = base
        self.open: list[tuple[str, str, Callable[[str], None] | None, list[str]]] = []
        self.tags: Counter[str] = Counter()
        self.ids: Counter[str] = Counter()
        self.asking: list[list[str]] = []
        self.lines: list[str] | None = []
        self.name = self.school = self.team = None
        self.seasons: dict[str, tuple[str | None, str | None, str]] = {}
        self.season: tuple[str | None, str | None, str] | None = None
        self.sections: list[tuple[str, str]] = []
        self.links: dict[tuple[int, str], str] = {}
        self.rows: list[dict] = []
        self.meet: dict | None = None
        self.row: dict | None = None
        self.panel = False

    def _inside(self, tag: str) -> bool:
        return self.tags[tag] > 0

    def _within(self, region: str) -> bool:
        return self.ids[region] > 0

    def _close_to(self, at: int) -> None:
        while len(self.open) > at:
            tag, name, then, text = self.open.pop()
            self.tags[tag] -= 1
            self.ids[name] -= 1
            if then is not None:
                self.asking.pop()
                then(" ".join(" ".join(text).split()))
            if tag == "tr" and self.row is not None:
                self._end_row()
            elif tag == "table":
                self.meet = None

    def _close_open(self, tags: tuple[str, ...], stop: tuple[str, ...]) -> None:
        """End an element that a sibling of its kind begins after."""
        if not any(self.tags[t] for t in tags):
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in tags:
                self._close_to(i)
                return
            if self.open[i][0] in stop:
                return

    def handle_starttag(self, tag, attrs):
        values = {k: v or "" for k, v in attrs}
        classes = set(values.get("class", "").lower().split())
        if tag == "tr":
            self._close_open(("tr",), ("table",))
        elif tag in ("td", "th"):
            self._close_open(("td", "th"), ("tr", "table"))
        if tag in _VOID:
            return
        then = None
        if tag == "h3" and "large-title" in classes and self.name is None:
            then = lambda text: setattr(self, "name", text)
        elif tag == "h3" and self._within(SEASONS):
            then = lambda text: self._start_season(text, classes)
        elif tag == "a" and "href" in values:
            then = self._link(values["href"])
        elif self._within(RESULTS):
            then = self._in_results(tag, classes)
        self.panel = self.panel or values.get("id") == RESULTS
        self.open.append((tag, values.get("id", ""), then, []))
        self.tags[tag] += 1
        self.ids[values.get("id", "")] += 1
        if then is not None:
            self.asking.append(self.open[-1][3])

    def _link(self, href: str) -> Callable[[str], None] | None:
        if self._within(SEASONS) and self.season is not None and "/results/" in href:
            self.seasons[url_path(href)] = self.season
        then, meet, row = None, self.meet, self.row
        if self._within(RESULTS):
            self._keep_link(href)
            if self._inside("thead"):
                if meet is not None and "url" not in meet:
                    meet["url"] = href
                    then = lambda text: meet.update(name=text)
            elif row is not None and len(row["cells"]) == 1 and "url" not in row:
                row["url"] = href
                then = lambda text: row.update(mark=text)
        if "/teams/tf/" in href and self.team is None:
            self.team = url_path(href).split("/")[-1].replace(".html", "")
            before = then

            def then(text):
                self.school = text.title()
                if before is not None:
                    before(text)

        return then

    def _keep_link(self, href: str) -> None:
        try:
            part = urlsplit(urljoin(self.base, " ".join(href.split())))
        except ValueError:
            return
        url = urlunsplit((part.scheme.lower(), part.netloc.lower(), part.path.rstrip("/") or "/", part.query, ""))
        if "/results/" in url.lower():
            self.links.setdefault((len(self.sections), url), url_kind(part.path.rstrip("/") or "/"))

    def _in_results(self, tag: str, classes: set[str]) -> Callable[[str], None] | None:
        meet, row = self.meet, self.row
        if tag == "div" and "transfer" in classes:
            return self._start_section
        if tag == "table":
            self.meet = {}
        elif tag == "tr" and not self._inside("thead"):
            self.row = {"cells": [], "spans": [], "highlighted": "highlight" in classes}
        elif tag == "td" and row is not None:
            return lambda text: row["cells"].append(text)
        elif tag == "span":
            if self._inside("thead"):
                if meet is not None and "date" not in meet:
                    meet["date"] = ""
                    return lambda text: meet.update(date=text)
            elif row is not None and len(row["cells"]) == 1:
                return lambda text: row["spans"].append(text) if text else None
        return None

    def _start_season(self, label: str, classes: set[str]) -> None:
        year = _YEAR.search(label)
        self.season = (year[0] if year else None, season_type(label, classes), label)

    def _start_section(self, marker: str) -> None:
        found = _TRANSFER.search(marker)
        if found:
            self.sections.append((found[1].strip("↓▼ "), marker))

    def _end_row(self) -> None:
        row, self.row = self.row, None
        if self.meet and "url" in self.meet and "url" in row and len(row["cells"]) >= 3:
            self.rows.append(row | {"meet": dict(self.meet), "section": len(self.sections)})

    def handle_endtag(self, tag):
        if not self.tags[tag]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._close_to(i)
                return

    def handle_data(self, data):
        if self._inside("script") or self._inside("style"):
            return
        for text in self.asking:
            text.append(data)
        line = " ".join(data.split())
        if self.lines is not None and line:
            if line.lower() == "college bests" or _TRANSFER.search(line) or len(self.lines) >= _HEADER_LINES:
                self.header, self.lines = self.lines, None
            else:
                self.lines.append(line)

    def finish(self, schools: list[str]) -> tuple:
        """(status, name, class, school, team, sections, results, links) of the page."""
        self.close()
        self._close_to(0)
        named = re.fullmatch(r"(.*?)\s*\(([^()]*)\)", self.name or "")
        name, year = (named[1].strip().title(), named[2].strip()) if named else ((self.name or "").title(), None)
        by_name = {_folded(s): s for s in reversed(schools) if s and _folded(s)}
        header = self.header if self.lines is None else self.lines
        school = next((by_name[_folded(x)] for x in header if _folded(x) in by_name), None) or self.school
        if not self.panel:
            return NO_PANEL, name or None, year, school, self.team, [], [], []
        sections = [(0, school or UNRESOLVED, None, CURRENT, True)]
        sections += [(i, s, marker, TRANSFER, False) for i, (s, marker) in enumerate(self.sections, 1)]
        links = [(i, url, hashlib.sha256(url.encode()).hexdigest(), kind) for (i, url), kind in self.links.items()]
        return OK, name or None, year, school, self.team, sections, [self._result(i, r) for i, r in enumerate(self.rows)], links

    def _result(self, index: int, row: dict) -> tuple:
        meet, url = row["meet"], row["url"]
        paths = [url_path(url), url_path(meet["url"])]
        year, kind, label = next((self.seasons[p] for p in paths if p in self.seasons), (None, None, None))
        if any("/results/xc/" in p.lower() for p in paths):
            said = _YEAR.search(meet.get("date", ""))
            kind, year = kind or "Cross Country", year or (said[0] if said else None)
            label = label or (f"{year} XC" if year else None)
        winds = [m[1] for s in row["spans"] if (m := _WIND.fullmatch(s))]
        second = " | ".join(s for s in row["spans"] if not _WIND.fullmatch(s))
        raw = row["cells"][2]
        found = _ROUND.search(raw)
        own, result = result_ids(url)
        values = (row["section"], index, year, kind, label, own or result_ids(meet["url"])[0], result, meet.get("name"), meet.get("date") or None, row["cells"][0], row.get("mark"), second or None, winds[-1] if winds else None)
        return (*values, _ROUND.sub("", raw).strip() or None, found[1].strip() or None if found else None, raw or None, meet["url"], url, row["highlighted"])


def parse_profiles(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", schools_col: str | None = None, base: str = "https://example.org/") -> DataFrame:
    """One row per page: ``status``, header, and arrays ``sections``, ``results`` and ``links``.

    The current school is the first of the names in ``schools_col`` (an array) that stands alone on a line of the header,
    else the one the team link names.  A transfer marker begins another school's section.  Null, empty or
    other pages without a panel of results have the state ``MEET_RESULTS_PANEL_NOT_FOUND`` and empty arrays.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, status string, name string, class_year string, school string, team_id string, sections array<{SECTION}>, results array<{RESULT}>, links array<{LINK}>"
    fields = {s: [f.split(":")[0] for f in s[len("struct<") : -1].split(",")] for s in (SECTION, RESULT, LINK)}
    kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    arrays = [pa.list_(pa.struct([(f.split(":")[0], kinds[f.split(":")[1]]) for f in s[len("struct<") : -1].split(",")])) for s in (SECTION, RESULT, LINK)]
    types = [*[pa.string()] * 5, *arrays]
    names = ["id", "status", "name", "class_year", "school", "team_id", "sections", "results", "links"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for html, schools in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                reader = ProfileReader(base)
                reader.feed(html or "")
                *head, sections, results, links = reader.finish(schools or [])
                nested = ((SECTION, sections), (RESULT, results), (LINK, links))
                out.append((*head, *([dict(zip(fields[s], x, strict=True)) for x in values] for s, values in nested)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], t) for i, t in enumerate(types))], names=names)

    schools = F.col(schools_col) if schools_col else F.lit(None).cast("array<string>")
    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"), schools.alias("schools")).mapInArrow(parse, schema).withColumnRenamed("id", id_col)


def unfold(profiles: DataFrame, part: str, id_col: str = "page_id") -> DataFrame:
    """Rows of ``sections``, ``results`` or ``links`` of parsed profiles, with the page's id."""
    return profiles.select(id_col, F.explode(part).alias("r")).select(id_col, "r.*")
