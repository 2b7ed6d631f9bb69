"""Quality rules as a short-circuit cascade.

Every rule looks at a few statistics of one text.  On a sample the cascade
measures what each rule costs and which texts it rejects.  The rule with the most
rejections per second goes first, then the one with the most among the texts
that are left, and so on.  A text leaves at its first
rejection and statistics that no asked rule needs are never computed.  The
verdict is a conjunction, so it does not depend on the order.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upslope.llm._arrow import map_arrow
from upslope.llm._text import utf8

_BLANK = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"


class TextStats:
    """Statistics of one text, each computed when first asked for."""

    def __init__(self, text: bytes):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text.translate(None, _BLANK).decode("utf-8", "replace"))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, _SYMBOLS))

    @cached_property
    def n_marks(self) -> int:
        return self.text.count(b"!") + self.text.count(b"?")

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that lie in a three-word window which the text holds twice or more."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        often = Counter(windows)
        covered, end = 0, 0
        for i, window in enumerate(windows):
            if often[window] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
        return covered


@dataclass(frozen=True)
class Rule:
    """``rejects`` says whether a text fails; from the sample come ``cost`` (seconds a text) and ``rate``
    (share of all texts that pass the rules before it and fail this one)."""

    name: str
    rejects: Callable[[TextStats], bool]
    cost: float = field(default=0.0, compare=False)
    rate: float = field(default=0.0, compare=False)


def default_rules() -> list[Rule]:
    """The production rules; the first two are the base of the contract."""
    return [
        Rule("too_short", lambda s: s.n_words < 50),
        Rule("repeated_words", lambda s: 100 * s.n_repeat_words > 50 * s.n_words),
        Rule("word_length", lambda s: not 2 * s.n_words <= s.word_chars <= 25 * s.n_words),
        Rule("symbols", lambda s: 100 * s.n_symbols > 30 * s.n_words),
        Rule("duplicate_lines", lambda s: 100 * s.n_dup_lines > 50 * len(s.lines)),
        Rule("marks", lambda s: 100 * s.n_marks > 50 * s.n_words),
    ]


BASE_RULES = ("too_short", "repeated_words")


def asked(rules: list[Rule], stats: TextStats) -> tuple[bool, int]:
    """Ask the rules in order up to the first that rejects: the verdict and how many were asked."""
    for n, rule in enumerate(rules, 1):
        if rule.rejects(stats):
            return False, n
    return True, len(rules)


def passes(rules: list[Rule], stats: TextStats) -> bool:
    return asked(rules, stats)[0]


def greedy_order(rules: list[Rule], costs: list[float], masks: dict[int, int]) -> list[Rule]:
    """Rules by rejections per second among the texts that the rules before them leave.

    ``masks`` counts sampled texts by the set of rules that reject them, as bits.
    """
    total, left, out = max(1, sum(masks.values())), dict(masks), []
    open_ = set(range(len(rules)))
    while open_:
        hits = {i: sum(n for m, n in left.items() if m >> i & 1) for i in open_}
        best = min(open_, key=lambda i: (-hits[i] / total / max(costs[i], 1e-9), rules[i].name))
        out.append(Rule(rules[best].name, rules[best].rejects, costs[best], hits[best] / total))
        left = {m: n for m, n in left.items() if not m >> best & 1}
        open_.remove(best)
    return out


def order_rules(docs: DataFrame, text_col: str, rules: list[Rule], sample_rows: int = 2000, seed: int = 7) -> list[Rule]:
    """The rules (62 at most) in cascade order, measured on about ``sample_rows`` rows.

    Every rule is timed on fresh statistics, so a rule is charged for what it
    alone would compute.  Only sums leave the executors.  With no rows the
    rules keep their order.
    """
    total = docs.count()
    if not total:
        return rules

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, masks = [0.0] * len(rules), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                mask = 0
                for i, rule in enumerate(rules):
                    began = time.perf_counter()
                    mask |= rule.rejects(TextStats(text)) << i
                    cost[i] += time.perf_counter() - began
                masks[mask] += 1
        rows = [(-1, m, n, 0.0) for m, n in masks.items()] + [(i, 0, 0, c) for i, c in enumerate(cost)]
        types = (pa.int32(), pa.int64(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["rule", "mask", "n", "cost"])

    sample = docs.select(utf8(F.col(text_col)).alias("t")).sample(min(1.0, sample_rows / total), seed)
    rows = map_arrow(sample, measure, "rule int, mask long, n long, cost double").groupBy("rule", "mask").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost")).collect()
    masks = {r.mask: r.n for r in rows if r.rule < 0}
    n = max(1, sum(masks.values()))
    costs = {r.rule: r.cost / n for r in rows if r.rule >= 0}
    return greedy_order(rules, [costs.get(i, 0.0) for i in range(len(rules))], masks)


def quality_filter(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, sample_rows: int = 2000) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns.

    Null and empty texts have no words and are rejected as too short; repeated
    rows are judged alike; an empty table stays empty; columns of any name pass
    through unchanged.
    """
    ordered = order_rules(docs, text_col, rules or default_rules(), sample_rows)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([passes(ordered, TextStats(t or b"")) for t in texts], pa.bool_()))

    return map_arrow(docs, keep, docs.schema)


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None, sample_rows: int = 2000, count_asked: bool = False) -> DataFrame:
    """Statistics and verdict of every row: one row out for each row in.

    A null text counts as empty, a null id stays null, an empty table gives no rows, and other
    columns are left out.  The cascade gives the verdict ``kept`` first; the statistics that it did not
    need are filled in for the report afterwards.  ``base_failed`` is the
    verdict of the base rules alone.  With ``count_asked`` a column ``n_asked`` says
    how many rules the cascade asked.
    """
    rules = rules or default_rules()
    base = [r for r in rules if r.name in BASE_RULES]
    ordered = order_rules(docs, text_col, rules, sample_rows)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    id_type = docs.schema[id_col].dataType.simpleString()

    verdicts = ["base_failed", "kept"]

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in (*names, *verdicts, "n_asked")}
            for text in batch.column(1).to_pylist():
                stats = TextStats(text)
                kept, n = asked(ordered, stats)
                out["kept"].append(kept)
                out["n_asked"].append(n)
                for name in names:
                    out[name].append(getattr(stats, name))
                out["base_failed"].append(not passes(base, stats))
            arrays = [batch.column(0), *(pa.array(out[n], pa.int64()) for n in names), *(pa.array(out[v], pa.bool_()) for v in verdicts)]
            if count_asked:
                arrays.append(pa.array(out["n_asked"], pa.int64()))
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, *names, *verdicts, *(["n_asked"] if count_asked else [])])

    schema = f"`{id_col}` {id_type}, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean" + ", n_asked long" * count_asked
    return map_arrow(docs.select(F.col(id_col), utf8(F.col(text_col)).alias("t")), report, schema)
