"""Numbers for rows that agree in everything, so that they can be told apart and spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upslope.scratch import materialize

#: Copies that one task writes out at a time.
CHUNK = 4096


def count_copies(rows: DataFrame, out: str = "n") -> DataFrame:
    """The distinct rows and how often each occurs; counted within tasks first, so a row that fills a third of the table costs one row per task."""
    return rows.groupBy(*rows.columns).agg(F.count("*").alias(out))


def number_copies(counts: DataFrame, most: int, n: str = "n", out: str = "copy") -> DataFrame:
    """Each of the counted rows ``n`` times, with ``out`` = 0, 1, ... for its copies; the numbers depend on the rows alone.

    ``most`` is the largest count.  Above ``CHUNK`` the counts are cut into chunks, and those are
    dealt to other tasks before they are written out.
    """
    columns = [c for c in counts.columns if c != n]
    if most <= CHUNK:
        return counts.select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(out))
    chunks = materialize(counts, "copies").withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(`{n}` - 1) div {CHUNK}"))))
    first = F.col("__chunk") * CHUNK
    chunks = chunks.withColumn("__at", F.sequence(first, F.least(first + CHUNK, F.col(n)) - 1))
    many = chunks.where(F.col(n) > CHUNK).repartition(F.xxhash64(*columns, "__chunk"))
    return chunks.where(F.col(n) <= CHUNK).unionByName(many).select(*columns, F.explode("__at").alias(out))
