"""Similarity of names, for the few distinct pairs that exact keys leave open."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most characters of a mark that rows are joined on; the rest is compared after.
_KEY = 16


def folded(name: str | None) -> str:
    """Lower case, compatibility forms resolved, marks dropped, one space between words."""
    plain = unicodedata.normalize("NFKD", name or "")
    return " ".join("".join(c for c in plain if not unicodedata.combining(c)).lower().split())


@functools.lru_cache(1 << 16)
def ratio(a: str, b: str) -> float:
    """The matching-blocks ratio of two words, from 0 to 1."""
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def add_similarity(df: DataFrame, a: str, b: str, name: str = "similarity") -> DataFrame:
    """``df`` with the matching-blocks ratio of two name columns, from 0 to 1; null names are empty.

    Each distinct pair is compared once.
    """
    pairs = df.select(F.col(a).alias("__a"), F.col(b).alias("__b")).distinct()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ratio = [SequenceMatcher(None, folded(x), folded(y), autojunk=False).ratio() for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ratio, pa.float64())], names=["__a", "__b", name])

    scored = pairs.mapInArrow(compare, f"__a string, __b string, `{name}` double")
    return df.join(scored, F.col(a).eqNullSafe(F.col("__a")) & F.col(b).eqNullSafe(F.col("__b"))).drop("__a", "__b")


def best_match(left: DataFrame, right: DataFrame, block: list[str], a: str, b: str, least: float = 0.85) -> DataFrame:
    """The most similar right name for each left row within a block, if similar enough; ties go to the smaller name.

    Blocks keep the number of compared pairs near the number of rows; a block is an equi-join key.
    """
    both = add_similarity(left.join(right, block), a, b)
    top = both.where(F.col("similarity") >= least).groupBy(*left.columns).agg(F.max(F.struct("similarity", F.col(b))).alias("__m"))
    return top.select(*left.columns, F.col("__m.similarity").alias("similarity"), F.col(f"__m.{b}").alias(b))


def add_folded(df: DataFrame, name: str, out: str) -> DataFrame:
    """``df`` with the folded form of a name column; null names fold to an empty one."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = pa.array([folded(x) for x in batch.column(name).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, plain], names=[*batch.schema.names, out])

    return df.mapInArrow(fold, T.StructType([*df.schema, T.StructField(out, T.StringType())]))


def resolve_rows(targets: DataFrame, rows: DataFrame, page: str = "page_id", least_last: float = 0.8, least_first: float = 0.4) -> DataFrame:
    """Rows of its page that belong to each target: (target columns, ``row_index``, ``method``, ``score``).

    ``targets`` has ``person_id``, ``name`` and ``mark``; ``rows`` has ``row_index``, ``link_id`` and ``link_name`` of the
    row's link to a person, and ``row_text``.  The first method with a row decides: ``id``, equal ids; ``name``,
    equal folded names; ``similar``, rows that hold the mark under a name whose last and first words are similar
    enough, of which those with the highest score (0.6 last, 0.4 first) stay.  Targets without a row are left out;
    null names, marks and ids match nothing, nor do names that fold to nothing.

    Each method is an equi-join, on the page and the id, the folded name or the start of the mark, so only pairs
    that share one of these are looked at, not all pairs of a page.
    """

    def token(text: str):
        return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9.:]", "")

    columns, last = targets.columns, lambda name: F.substring_index(name, " ", -1)
    left = add_folded(targets, "name", "__name").withColumns({"__mark": token("mark"), "__last": last("__name")})
    left = left.withColumns({"__key": F.left("__mark", F.lit(_KEY)), "__page": F.col(page)})
    right = rows.select(F.col(page).alias("__at"), "row_index", F.col("link_id").alias("__id"), F.col("link_name").alias("__link"), token("row_text").alias("__text"))
    right = add_folded(right, "__link", "__other").withColumn("__end", last("__other"))
    same_page, named = F.col("__page") == F.col("__at"), F.col("__name") != ""
    by_id = left.join(right, same_page & (F.col("person_id") == F.col("__id"))).withColumns({"__step": F.lit(1), "score": F.lit(1.0)})
    by_name = left.where(named).join(right, same_page & (F.col("__name") == F.col("__other"))).withColumns({"__step": F.lit(2), "score": F.lit(1.0)})

    marked = left.where(named & (F.col("__mark") != ""))
    # Of each row's text the pieces that are as long as a key of the page and start like one.
    lengths = marked.groupBy(F.col("__page").alias("__of"), F.length("__key").alias("__n")).agg(F.collect_set(F.left("__key", F.lit(2))).alias("__heads"))
    starts = F.sequence(F.lit(1), F.length("__text") - F.col("__n") + 1)
    starts = F.filter(starts, lambda i: F.array_contains("__heads", F.substring("__text", i, F.least(F.lit(2), F.col("__n")))))
    pieces = F.array_distinct(F.transform(starts, lambda i: F.substring("__text", i, F.col("__n"))))
    held = right.where("__link is not null").join(lengths, F.col("__at") == F.col("__of")).where("length(__text) >= __n")
    held = held.withColumn("__piece", F.explode(pieces))
    a, b = F.length("__last"), F.length("__end")
    # The ratio is at most that of equal words of these lengths.
    close = F.lit(2.0) * F.least(a, b) / (a + b) >= least_last
    both = marked.join(held, same_page & (F.col("__key") == F.col("__piece")) & F.contains("__text", "__mark") & close)
    both = both.select(*columns, "row_index", "__name", "__other")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, scores = [], []
            for i, (x, y) in enumerate(zip(batch.column("__name").to_pylist(), batch.column("__other").to_pylist(), strict=True)):
                x, y = x.split(" "), y.split(" ")
                if (end := ratio(x[-1], y[-1])) >= least_last and (start := ratio(x[0], y[0])) >= least_first:
                    at.append(i)
                    scores.append(0.6 * end + 0.4 * start)
            kept = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(scores, pa.float64())], names=[*kept.schema.names, "score"])

    alike = both.mapInArrow(compare, T.StructType([*both.schema, T.StructField("score", T.DoubleType())])).withColumn("__step", F.lit(3))
    found = [x.select(*columns, "row_index", "__step", "score") for x in (by_id, by_name, alike)]
    found = found[0].unionByName(found[1]).unionByName(found[2]).withColumn("__rank", F.struct("__step", -F.col("score")))
    found = found.withColumn("__best", F.min("__rank").over(W.partitionBy(*columns))).where("__rank = __best")
    method = F.element_at(F.array(F.lit("id"), F.lit("name"), F.lit("similar")), F.col("__step")).alias("method")
    return found.select(*columns, "row_index", method, "score")
