"""Secret scans with multipart credential linking.

Strong patterns are reported wherever they match.  Weak candidates (short access
identifiers, account names, short secrets, endpoints) are reported only when a
complementary part lies in the same scope: within ``reach`` code points and in
the same block of text (no blank line between), or a secret and an endpoint overlap.  Everything runs on native
expressions: matches come from ``regexp_extract_all``, their places from the
lengths of what ``split`` leaves between them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VALUE = r"[A-Za-z0-9+/_.=-]"
_ASSIGN = rf"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?({_VALUE}+)"
_ASSIGN_ANY = rf"(?i){_ASSIGN}"


@dataclass(frozen=True)
class Pattern:
    """``role`` says which parts complement it; ``strong`` matches need no partner."""

    kind: str
    regex: str
    role: str
    strong: bool
    value_group: int = 0
    min_value: int = 0
    max_value: int = 1 << 30


#: Kinds in the order in which spans with the same start are listed.
PATTERNS = (
    Pattern("assign", _ASSIGN_ANY, "secret", True, 2, 12),
    Pattern("access", r"AKIA[A-Z0-9]{14,}", "ident", True),
    Pattern("hex", r"[0-9a-f]{16,}", "secret", True),
    Pattern("weak_assign", _ASSIGN_ANY, "secret", False, 2, 6, 11),
    Pattern("weak_access", r"(?<![A-Z0-9])AKIA[A-Z0-9]{4,13}(?![A-Z0-9])", "ident", False),
    Pattern("account", r"(?i)(?<![a-z0-9_])(?:user(?:_?name)?|login|client_?id|account_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{3,}", "ident", False),
    Pattern("endpoint", r"(?i)(?<![a-z0-9])(?:https?|jdbc:[a-z]+|mongodb(?:\+srv)?|postgres(?:ql)?|mysql|redis|amqps?|ftps?|ldaps?)://[^\x20\x09-\x0D\"'<>]{4,}", "endpoint", False),
)
#: What a weak part of each role needs beside it.
COMPLEMENTS = {"ident": ("secret",), "secret": ("ident", "endpoint"), "endpoint": ("secret",)}
BASE_KINDS = ("assign", "access", "hex")
_STRUCT = "struct<start:int,end:int,ord:int,kind:string,role:string,strong:boolean>"
_PART = f"array<{_STRUCT}>"
_CHUNK = 256


def _running(steps: Column, step, kind: str) -> Column:
    """What ``step`` gives for each element in turn, null left out: an array that grows chunk by chunk.

    ``step`` takes the place so far and the element and returns the next place and a value.  Appending to one array
    would copy it each time; here a step copies at most ``_CHUNK`` values.
    """
    none, nothing = F.from_json(F.lit("[]"), f"array<{kind}>"), F.from_json(F.lit("[]"), f"array<array<{kind}>>")

    def one(acc: Column, x: Column) -> Column:
        at, value = step(acc["at"], x)
        full = F.size(acc["now"]) >= _CHUNK
        now = F.when(full, none).otherwise(acc["now"])
        done = F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
        return F.struct(at.alias("at"), done.alias("done"), F.when(value.isNotNull(), F.concat(now, F.array(value))).otherwise(now).alias("now"))

    start = F.struct(F.lit(0).alias("at"), nothing.alias("done"), none.alias("now"))
    return F.aggregate(steps, start, one, lambda acc: F.concat(F.flatten(acc["done"]), acc["now"]))


def _places(text: Column, pattern: Pattern, order: int) -> Column:
    """All matches of one pattern as parts, in order."""
    regex = F.lit(pattern.regex)
    found = F.regexp_extract_all(text, regex, F.lit(0))
    gaps = F.transform(F.split(text, pattern.regex, -1), F.length)
    lengths = F.transform(found, F.length)
    values = F.transform(F.regexp_extract_all(text, regex, F.lit(pattern.value_group)), F.length) if pattern.value_group else lengths
    steps = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), lengths.alias("m"), values.alias("v"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["g"]
        end = start + x["m"]
        part = F.struct(start.alias("start"), end.alias("end"), F.lit(order).alias("ord"), F.lit(pattern.kind).alias("kind"), F.lit(pattern.role).alias("role"), F.lit(pattern.strong).alias("strong"))
        return end, F.when(x["v"].between(pattern.min_value, pattern.max_value), part)

    return F.when(F.size(found) > 0, _running(steps, step, _STRUCT)).otherwise(F.from_json(F.lit("[]"), _PART))


def _blank_lines(text: Column) -> Column:
    """Where runs of two or more newlines begin, in order."""
    runs = F.transform(F.regexp_extract_all(text, F.lit(r"\n{2,}"), F.lit(0)), F.length)
    gaps = F.transform(F.split(text, r"\n{2,}", -1), F.length)
    steps = F.arrays_zip(F.slice(gaps, 1, F.size(runs)).alias("g"), runs.alias("m"))
    return _running(steps, lambda at, x: (at + x["g"] + x["m"], at + x["g"]), "int")


def _up_to(places: Column, x: Column) -> Column:
    """How many of the sorted ``places`` are at most ``x``, by bisection."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(places) + 1)).cast("int") + 1)

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        right = (acc["lo"] < acc["hi"]) & (F.get(places, middle) <= x)
        return F.struct(F.when(right, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(right, acc["hi"]).otherwise(middle).alias("hi"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(places).alias("hi")), halve, lambda acc: acc["lo"])


def _linked(text: Column, parts: Column, reach: int) -> Column:
    """Strong parts, and the weak ones with a complementary part in their scope.

    What lies between a part and its nearest partner on a side lies between the part
    and all farther ones too, so only the nearest on each side are tried.  A secret
    that overlaps an endpoint is in its scope; other parts that overlap are two
    readings of one place and don't complement each other.
    """

    def places(role: str, at: str) -> Column:
        return F.array_sort(F.transform(F.filter(parts, lambda q: q["role"] == role), lambda q: q[at]))

    def beside(p: Column, starts: Column, ends: Column, blanks: Column, overlaps: bool) -> Column:
        before, until = _up_to(ends, p["start"]), _up_to(starts, p["end"] - 1)
        left, right = F.get(ends, before - 1), F.get(starts, until)
        near = F.lit(False)
        for a, b in ((left, p["start"]), (p["end"], right)):
            # no part holds a newline, so a run of them that begins between two parts lies between them
            near = near | F.coalesce((b - a <= reach) & (_up_to(blanks, b - 1) == _up_to(blanks, a - 1)), F.lit(False))
        return near | (until > before) if overlaps else near

    def keep(p: Column, at: Column) -> Column:
        out = p["strong"]
        for role, partners in COMPLEMENTS.items():
            for q in partners:
                out = out | ((p["role"] == role) & beside(p, at[f"{q}_start"], at[f"{q}_end"], at["blanks"], "endpoint" in (role, q)))
        return out

    bound = F.struct(parts.alias("parts"), _blank_lines(text).alias("blanks"), *(places(r, x).alias(f"{r}_{x}") for r in COMPLEMENTS for x in ("start", "end")))
    # The lambda's variable holds the sorted places, so they are made once for a text.
    return F.transform(F.array(bound), lambda at: F.filter(at["parts"], lambda p: keep(p, at)))[0]


def _digest(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, text_col: str = "text", reach: int = 200, out_col: str = "spans") -> DataFrame:
    """``docs`` with an array of credential spans.

    Each span has ``start`` and ``end`` (code points, end exclusive), ``kind``,
    ``role`` and ``strong``, sorted by start and then by kind as listed in
    ``PATTERNS``.  A weak candidate is included if a complementary part is in
    its scope: beside it, or, of a secret and an endpoint, overlapping it.  A null or empty text has no
    spans; rows are independent, so repeated rows get equal spans; an existing
    column named ``out_col`` is replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    empty = F.from_json(F.lit("[]"), _PART)
    found = []
    for i, pattern in enumerate(PATTERNS):
        at = F.when(text.rlike(pattern.regex), _places(text, pattern, i)).otherwise(empty)
        found.append(at)
    out = docs.withColumn(out_col, F.array_sort(F.concat(*found)))
    weak = F.exists(F.col(out_col), lambda p: ~p["strong"])
    return out.withColumn(out_col, F.when(weak, _linked(text, F.col(out_col), reach)).otherwise(F.col(out_col)))


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """Counts and digests of the spans of every row."""
    scanned = scan_secrets(docs.select(id_col, text_col), text_col, reach, "__spans")
    spans = F.col("__spans")
    base = F.filter(spans, lambda p: p["strong"])

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda p: p["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select(id_col, *map(count, BASE_KINDS), F.sha2(_digest(base), 256).alias("base_sha256"), _digest(spans).alias("spans"))


def redact_secrets(docs: DataFrame, text_col: str = "text", reach: int = 200, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span of the text replaced by ``mark``; overlapping spans merge."""
    scanned = scan_secrets(docs, text_col, reach, "__spans")
    text = F.col(text_col)

    def step(acc: Column, p: Column) -> Column:
        piece = F.concat(F.substring(text, acc["at"] + 1, F.greatest(p["start"] - acc["at"], F.lit(0))), F.when(p["start"] >= acc["at"], mark).otherwise(""))
        return F.struct(F.greatest(acc["at"], p["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return scanned.withColumn(text_col, F.when(F.size("__spans") > 0, F.aggregate(F.col("__spans"), start, step, rest)).otherwise(text)).drop("__spans")
