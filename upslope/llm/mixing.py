"""Mixing sources to target weights by weighted fair queueing.

Each source queues its documents in a seeded random order, twice.  A queued
document's virtual finish time is the source's cumulative words up to and with
it, divided by the source's target; the mix serves all queues by ascending
finish time until the total budget is spent.  The global order is never sorted
as a whole: finish times fall into ranges, the ranges' totals find the one in
which the budget runs out, and only that range is sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from upslope.llm._copies import count_copies, number_copies
from upslope.llm._text import word_count
from upslope.operators.ordering import prefix_sums
from upslope.scratch import drop_tables, materialize

WEIGHTS = (3, 1, 2)
EPOCHS = 2


def source_targets(sizes: DataFrame, budget: Column, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Targets of (source, source_size): weight times a common level, at most ``epochs`` times the size.

    Sources are ordered by code point, null last, and take the weights in turn.
    The level is the one at which the targets add up to ``budget``: sources sorted
    by the level at which they are full, it is the first level that the next
    source doesn't fill.
    """
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w.cast("double")).withColumn("cap", F.lit(float(epochs)) * F.col("source_size"))
    s = s.withColumn("full", F.col("cap") / F.col("w"))
    by_full = W.orderBy("full", F.col("source").asc_nulls_last())
    before = by_full.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(1))
    s = s.withColumn("level", (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    s = s.withColumn("at", F.max(F.when(F.col("level") <= F.col("full"), F.col("level"))).over(everything))
    return s.select("source", "source_size", "w", F.least("cap", F.coalesce(F.col("w") * F.col("at"), F.col("cap"))).alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: tuple[int, int] = (3, 2),
    weights: tuple[int, ...] = WEIGHTS,
    seed: str = "mix",
    range_rows: int = 256,
) -> DataFrame:
    """How many words of each document the mix takes.

    The budget is ``share`` (a fraction) of all words.  Returns ``id_col``,
    ``size`` (words), ``source_size`` and ``target`` of the document's source,
    and ``taken``: size times how often the mix serves the document.

    A null text has size 0 and is never taken; a null source is a source of its
    own, ordered last; a null id is queued like any other.  Rows that agree in id,
    source and size are interchangeable: they are numbered, and each has a place of its own in
    the random order.  An empty table gives no rows.  Reruns
    agree, whatever the partitioning.  One task holds a row for each source.
    """
    name = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("\0"), F.col("size").cast("string")))
    name = F.concat(F.lit(seed), name, F.when(F.col("copy") > 0, F.concat(F.lit("#"), F.col("copy").cast("string"))).otherwise(""))
    unit = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    counts = materialize(count_copies(rows), "mix-counts")
    most = counts.agg(F.max("n")).first()[0] or 0
    rows = materialize(number_copies(counts, most).withColumn("u", unit), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("b"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    budget = total.b * share[0] / share[1]
    targets = source_targets(sizes.drop("n"), F.lit(float(budget)), weights)

    # cumulative words of a source: ranges of the random order first, then within a range
    n_ranges = max(1, math.ceil(total.n / range_rows))
    t = targets.join(sizes.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    t = t.select(F.col("source").alias("s"), "source_size", "target", F.ceil(F.col("n") / range_rows).alias("ranges"))
    ranged = rows.join(t, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    ranged = ranged.withColumn("g", F.floor(F.col("u") * (F.col("ranges") / F.lit(2.0**52))).cast("long"))
    parts = ranged.groupBy("source", "g").agg(F.sum("size").alias("part"))
    base = prefix_sums(parts, ["source"], "g", "part").select(F.col("source").alias("s"), F.col("g").alias("b"), "base")
    inner = W.partitionBy("source", "g").orderBy("u", F.col("id").asc_nulls_first(), "size", "copy").rowsBetween(W.unboundedPreceding, 0)
    queue = ranged.withColumn("run", F.sum("size").over(inner))
    queue = queue.join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("g") == F.col("b"))).drop("s", "b")
    cum = F.col("base") + F.col("run")
    for e in range(EPOCHS):
        queue = queue.withColumn(f"f{e}", (cum + e * F.col("source_size")) / F.nullif(F.col("target"), F.lit(0.0)))
    before = rows
    queue = materialize(queue.select("id", "source", "size", "source_size", "target", "u", "copy", *(f"f{e}" for e in range(EPOCHS))), "mix-queue")
    drop_tables(before, counts)

    def key(epoch: int) -> Column:
        return F.struct(F.col(f"f{epoch}").alias("f"), F.lit(epoch).alias("e"), F.coalesce("source", F.lit("")).alias("s"), F.col("u"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("i"), F.col("size").alias("z"), F.col("copy").alias("c"))

    served = queue.where("size > 0").select("size", F.explode(F.array(*map(key, range(EPOCHS)))).alias("k"))
    served = served.withColumn("r", F.floor(F.col("k.f") * n_ranges).cast("long"))
    totals = served.groupBy("r").agg(F.sum("size").alias("part"))
    totals = prefix_sums(totals, [], "r", "part")
    last = totals.where(F.col("base") + F.col("part") > budget).orderBy("r").limit(1)
    found = last.collect()
    if not found:
        taken = F.lit(EPOCHS)
    else:
        r, spent = found[0].r, found[0].base
        edge = served.where(F.col("r") == r).withColumn("cum", F.sum("size").over(W.orderBy("k").rowsBetween(W.unboundedPreceding, 0)) + F.lit(spent))
        cut = edge.where(F.col("cum") <= budget).agg(F.max("k").alias("k")).first().k
        taken = F.lit(0)
        for e in range(EPOCHS):
            in_range = F.floor(F.col(f"f{e}") * n_ranges).cast("long")
            inside = in_range < r
            if cut is not None:
                bound = F.struct(F.lit(cut.f).alias("f"), F.lit(cut.e).alias("e"), F.lit(cut.s).alias("s"), F.lit(cut.u).cast("long").alias("u"), F.lit(cut.i).alias("i"), F.lit(cut.z).cast("long").alias("z"), F.lit(cut.c).cast("long").alias("c"))
                inside = inside | ((in_range == r) & (key(e) <= bound))
            taken = taken + F.when(inside, 1).otherwise(0)
    return queue.select(F.col("id").alias(id_col), "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), F.when(F.col("size") > 0, F.col("size") * taken).otherwise(0).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", broadcast_rows: int = 500_000, **options) -> DataFrame:
    """The rows of ``docs`` that the mix serves, each as often as it is served.

    Columns pass through unchanged.  Rows that share an id count as one document
    and are served as often as the one served most.  The servings are broadcast only
    while there are at most ``broadcast_rows``.
    """
    mixed = mix_sources(docs, id_col, text_col, source_col, **options).where("taken > 0")
    times = mixed.groupBy(F.col(id_col).alias("__mix_id")).agg(F.max(F.expr("taken div size")).cast("int").alias("__mix_n"))
    times = materialize(times, "mix-servings")
    if times.count() <= broadcast_rows:
        times = F.broadcast(times)
    joined = docs.join(times, docs[id_col].eqNullSafe(F.col("__mix_id")))
    return joined.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__mix_n"))).alias("__mix_copy")).drop("__mix_copy")
