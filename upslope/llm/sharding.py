"""Two-pass external shuffle into shards.

Pass one scatters records by a seeded hash into buckets that fit in memory; pass
two puts each bucket into a Fisher-Yates permutation drawn from the seed and the
bucket's number, concatenates the buckets and writes the shards.  Shards are equal
cuts of the resulting order, so their row counts differ by one at most.  Hash, draws
and order depend on the seed and the rows alone, not on how they are partitioned, so a
task that runs again places its records where they were.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upslope.llm._copies import count_copies, number_copies
from upslope.operators.ordering import prefix_sums
from upslope.scratch import materialize

LAW = "rows"
#: Bytes of an index in the state of a permutation.
_INDEX = 3
#: Most buckets whose starts are sent to all tasks.
_SENT = 500_000


def draw_permutation(n: Column, bucket: Column, seed: int) -> Column:
    """A Fisher-Yates permutation of 0 .. n-1, drawn from seed and bucket and packed; n is below 2 ** 24.

    Built inside out: step i draws j from 0 .. i, moves what stands at j to the end
    and puts i at j.  The state is a binary of three bytes an index, so a step
    copies bytes and no array of objects.
    """

    def step(state: Column, i: Column) -> Column:
        at = F.pmod(F.xxhash64(F.lit(seed), bucket, i), i + 1).cast("int") * _INDEX + 1
        own = F.unhex(F.lpad(F.hex(i), 2 * _INDEX, "0"))
        return F.concat(F.overlay(state, own, at, F.lit(_INDEX)), F.substring(state, at, F.lit(_INDEX)))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(b"").cast("binary"), step)


def packed_index(state: Column, k: Column) -> Column:
    """The k-th index of a packed permutation."""
    return F.conv(F.hex(F.substring(state, k * _INDEX + 1, F.lit(_INDEX))), 16, 10).cast("int")


def shuffle_rows(rows: Column, bucket: Column, seed: int) -> Column:
    """The array in the order of the bucket's permutation."""
    bound = F.struct(F.array_sort(rows).alias("rows"), draw_permutation(F.size(rows), bucket, seed).alias("state"))
    # The lambda's variable holds the sorted rows and the permutation, so they are made once for a bucket.
    order = lambda b: F.transform(F.sequence(F.lit(0), F.size(b["rows"]) - 1), lambda k: F.get(b["rows"], packed_index(b["state"], k)))
    return F.transform(F.array(bound), order)[0]


def text_digest(text: Column) -> dict[str, Column]:
    """``size`` (UTF-8 bytes plus 8) and ``text_crc32`` of a text; a null text counts as empty."""
    data = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    return {"size": (F.octet_length(data) + 8).cast("long"), "text_crc32": F.crc32(data)}


def shard_records(
    docs: DataFrame,
    n_shards: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: list[str] | None = None,
    seed: int = 1,
    bucket_rows: int = 2048,
    bucket_bytes: int = 4 << 20,
    in_order: bool = False,
) -> DataFrame:
    """Every row with its shard and its slot in that shard.

    Returns ``id_col``, ``size`` (UTF-8 bytes plus 8), ``text_crc32``, ``shard``
    and ``slot``, and the columns named in ``carry`` (which travel with the
    record; by default none, so that only narrow rows are shuffled).  A carried
    column named like one of these is replaced by it; carried columns must be comparable (no maps).

    A null text counts as empty (size 8, checksum 0), a null id stays null.
    Rows that agree in everything returned are numbered, so copies are scattered like other
    rows and none of them fills a bucket.  An empty table gives no
    rows.  ``bucket_rows`` and ``bucket_bytes`` bound what one bucket holds on
    average; the number of buckets follows the input.  With ``in_order`` ranges of
    buckets are dealt to tasks, so that each holds a stretch of the order (up to
    ``_SENT`` buckets), ready for ``write_shards``; places are the same either way.
    """
    own = [id_col, "size", "text_crc32", "shard", "slot"]
    extra = [c for c in carry or [] if c not in own]
    digest = text_digest(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("id"),
        digest["size"].alias("size"),
        digest["text_crc32"].alias("crc"),
        *([F.struct(*[F.col(c) for c in extra]).alias("rec")] if extra else []),
    )
    counts = count_copies(rows.select("id", "size", "crc"))
    if not extra:
        counts = materialize(counts, "shard-rows")
    none = F.lit(0)
    total = counts.agg(*(F.coalesce(x, none).alias(k) for k, x in (("n", F.sum("n")), ("b", F.sum(F.col("n") * F.col("size"))), ("most", F.max("n"))))).first()
    if not extra:
        keyed = number_copies(counts, total.most)
    elif total.most > 1:
        keyed = number_copies(count_copies(rows), total.most)
    else:
        keyed = rows.withColumn("copy", F.lit(0).cast("long"))
    n_buckets = max(1, math.ceil(total.n / bucket_rows), math.ceil(total.b / bucket_bytes) if extra else 0)
    keyed = keyed.withColumn("h", F.xxhash64(F.lit(seed), *keyed.columns)).withColumn("bucket", F.pmod("h", F.lit(n_buckets)))
    record = F.struct("h", *(c for c in keyed.columns if c not in ("h", "bucket")))
    dealt = keyed.select("bucket", record.alias("r"))
    filled = (dealt.repartitionByRange("bucket") if in_order else dealt).groupBy("bucket").agg(F.collect_list("r").alias("rs"))
    starts = prefix_sums(keyed.groupBy("bucket").agg(F.count("*").alias("rows")), [], "bucket", "rows", "start").select("bucket", "start")
    placed = (
        filled.join(F.broadcast(starts) if in_order and n_buckets <= _SENT else starts, "bucket")
        .select("start", F.posexplode(shuffle_rows(F.col("rs"), F.col("bucket"), seed)).alias("i", "r"))
        .select((F.col("start") + F.col("i")).alias("at"), "r.*")
    )
    n = max(total.n, 1)
    placed = placed.withColumn("s", F.expr(f"(at * {n_shards}L) div {n}L"))
    return placed.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        *([F.col(f"rec.`{c}`").alias(c) for c in extra]),
        F.col("s").cast("int").alias("shard"),
        (F.col("at") - F.expr(f"(s * {n}L + {n_shards - 1}L) div {n_shards}L")).cast("long").alias("slot"),
    )


def write_shards(sharded: DataFrame, path: str, in_order: bool = False) -> DataFrame:
    """Write one folder for each shard and return a scan of them.

    Ranges of (shard, slot) are written as files in slot order, so a large shard is
    written by many tasks.  With ``in_order`` tasks hold such ranges already
    (``shard_records``), and no record is moved again.  An empty table writes no shard.
    """
    ranged = sharded if in_order else sharded.repartitionByRange("shard", "slot")
    ordered = ranged.sortWithinPartitions("shard", "slot")
    ordered.write.mode("overwrite").partitionBy("shard").parquet(path)
    columns = [c for c in sharded.schema if c.name != "shard"] + [sharded.schema["shard"]]
    return sharded.sparkSession.read.schema(type(sharded.schema)(columns)).parquet(path).select(*sharded.columns)
