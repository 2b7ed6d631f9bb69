"""Language-model scores of whole documents.

Counts of all training words are gathered exactly, without collecting the
vocabulary anywhere: a task numbers the words of a block of documents, sends each
distinct word's hash once to the word's bucket and gets the corpus count back,
so what moves is distinct words per block.  The commonest words become symbols
of a gated recurrent network (see ``gru``), rarer ones fall into bands by count
and get their share of the band.

Documents are dealt by a hash of id and text to shards of about ``SHARD_TOKENS`` tokens.
Each shard trains a copy of the network and the copies are averaged, weighted by
what they saw; then every document is scored.  What a shard holds, in which
order, and the order of the sums depend on the rows alone, so scores don't change with the
partitioning or when a task runs again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upslope.llm import gru
from upslope.llm._arrow import map_arrow
from upslope.llm._copies import count_copies, number_copies
from upslope.llm._text import utf8, word_hashes
from upslope.scratch import drop_tables, materialize

HEADS = 1024
BANDS = 48
_BLOCK_TOKENS = 2_000_000
#: Tokens of a shard, on average.
SHARD_TOKENS = 2_000_000
#: Rows that one step of a reduction adds up.
_FAN_IN = 16
#: Rows with one id above which equal rows are told apart before they are dealt.
_MANY = 1000


def is_held_out(id_col: str, parts: int = 7, held: int = 2):
    """Whether crc32 of the id as text leaves the held-out remainder; a null id counts as empty text."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts) == held


def _binary(rows: list[tuple], types: tuple, names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=list(names))


class _Numbering(dict):
    """Word -> number in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _number_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of documents (block, id, held, toks) and one row per block with its words (words, counts).

    Words are numbered by ascending hash, so a range of hashes is a range of numbers.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ("block", "id", "held", "toks", "words", "counts")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        held_rows: list[tuple] = []
        numbers, size, types = _Numbering(), 0, None

        def close() -> Iterator[pa.RecordBatch]:
            h = word_hashes(list(numbers))
            order = np.argsort(h, kind="stable")
            rank = np.empty(len(h), np.uint32)
            rank[order] = np.arange(len(h), dtype=np.uint32)
            learned = [toks for _, held, toks in held_rows if not held]
            counts = np.bincount(rank[np.concatenate(learned)] if learned else [], minlength=len(h)).astype(np.int64)
            for k in range(0, len(held_rows), 2000):
                yield _binary([(block, doc, held, rank[toks].tobytes(), None, None) for doc, held, toks in held_rows[k : k + 2000]], types, names)
            yield _binary([(block, None, None, None, h[order].tobytes(), counts.tobytes())], types, names)

        for batch in batches:
            types = (pa.int64(), batch.schema.field(0).type, pa.bool_(), pa.binary(), pa.binary(), pa.binary())
            for doc, held, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = text.lower().split()
                toks = np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))
                held_rows.append((doc, held, toks))
                size += len(toks) + 10  # a row counts even without words
                if size >= _BLOCK_TOKENS:
                    yield from close()
                    block, held_rows, numbers, size = block + 1, [], _Numbering(), 0
        if held_rows:
            yield from close()

    rows = docs.select(F.col(id_col), is_held_out(id_col).alias("held"), utf8(F.col(text_col)).alias("t"))
    return map_arrow(rows, number, f"block long, id {kind}, held boolean, toks binary, words binary, counts binary")


def _gather_counts(blocks: DataFrame, n_buckets: int) -> DataFrame:
    """Per (bucket, block): corpus counts of the block's words in that bucket, in order.

    ``top_at`` and ``top_hash`` name the block's words among the bucket's commonest;
    the first row of a bucket also carries its totals.
    """
    shift = np.uint64(64 - int(np.log2(n_buckets)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                h, c = np.frombuffer(words, np.uint64), np.frombuffer(counts, np.int64)
                cuts = np.searchsorted(h >> shift, np.arange(n_buckets + 1).astype(np.uint64))
                rows = [(k, block, h[a:b].tobytes(), c[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
                if rows:
                    yield _binary(rows, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), ("bucket", "block", "h", "c"))

    out_types = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    out_names = ("bucket", "block", "c", "top_at", "top_hash", "heads", "head_counts", "band_words", "band_counts")

    def total(rows: list[tuple]) -> pa.RecordBatch:
        hs = [np.frombuffer(r[2], np.uint64) for r in rows]
        flat = np.concatenate(hs)
        u, inverse = np.unique(flat, return_inverse=True)
        c = np.zeros(len(u), np.int64)
        np.add.at(c, inverse, np.concatenate([np.frombuffer(r[3], np.int64) for r in rows]))
        top = np.argsort(-c, kind="stable")[:HEADS]
        top = top[c[top] > 0]
        is_top = np.zeros(len(u), bool)
        is_top[top] = True
        band = band_of(c)
        stats = (u[top].tobytes(), c[top].tobytes(), np.bincount(band, c > 0, BANDS).astype(np.int64).tobytes(), np.bincount(band, c, BANDS).astype(np.int64).tobytes())
        out, at = [], 0
        for i, (r, h) in enumerate(zip(rows, hs, strict=True)):
            own = inverse[at : at + len(h)]
            at += len(h)
            hit = np.flatnonzero(is_top[own]).astype(np.uint32)
            out.append((r[0], r[1], c[own].tobytes(), hit.tobytes(), h[hit].tobytes(), *(stats if i == 0 else (None,) * 4)))
        return _binary(out, out_types, out_names)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if rows and rows[0][0] != r[0]:
                    yield total(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield total(rows)

    sent = map_arrow(blocks.where("words is not null").select("block", "words", "counts"), send, "bucket int, block long, h binary, c binary")
    dealt = sent.repartition("bucket").sortWithinPartitions("bucket", "block")
    schema = "bucket int, block long, c binary, top_at binary, top_hash binary, heads binary, head_counts binary, band_words binary, band_counts binary"
    return map_arrow(dealt, answer, schema)


def band_of(c: np.ndarray) -> np.ndarray:
    """0 for unseen words, else 1 + floor(log2(count))."""
    return np.where(c > 0, np.frexp(np.maximum(c, 1).astype(np.float64))[1], 0).clip(0, BANDS - 1)


class Vocabulary:
    """Head symbols and bands with their totals; bounded by ``HEADS`` and ``BANDS``."""

    def __init__(self, heads: np.ndarray, head_counts: np.ndarray, band_words: np.ndarray, band_counts: np.ndarray, n_train: int):
        order = np.argsort(heads, kind="stable")
        self.hashes, self.symbols = heads[order], order + 1  # symbol 0 is the end of a text
        self.n_train = n_train
        band = band_of(head_counts)
        self.tail_words = band_words - np.bincount(band, minlength=BANDS)
        self.tail_counts = band_counts - np.bincount(band, head_counts, BANDS).astype(np.int64)
        self.distinct = int(band_words.sum()) + (n_train > 0)
        self.total = int(band_counts.sum()) + n_train
        counts = np.zeros(HEADS + BANDS)
        counts[0] = n_train
        counts[self.symbols] = head_counts[order]
        counts[HEADS:] = self.tail_counts
        self.counts = counts

    def tail_score(self, c: np.ndarray) -> np.ndarray:
        """Log10 share of a word with a count within its band; the unseen word has all of its band."""
        band = band_of(c)
        mass = (self.tail_counts + self.tail_words).astype(np.float64)
        return np.where(c > 0, np.log10((c + 1) / np.maximum(mass[band], 1)), 0.0)

    @property
    def norm(self) -> float:
        return float(np.log10(self.total + self.distinct + 1))


def _vocabulary(replies: DataFrame, n_train: int, n_buckets: int) -> Vocabulary:
    """Collects band totals and at most ``HEADS`` words: rows are reduced to those bounds in steps of ``_FAN_IN``."""
    keep = HEADS - 1

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, c = np.empty(0, np.uint64), np.empty(0, np.int64)
        words, counts = np.zeros(BANDS, np.int64), np.zeros(BANDS, np.int64)
        for batch in batches:
            for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                h, c = np.concatenate([h, np.frombuffer(a, np.uint64)]), np.concatenate([c, np.frombuffer(b, np.int64)])
                order = np.lexsort((h, -c))[:keep]
                h, c = h[order], c[order]
                words, counts = words + np.frombuffer(x, np.int64), counts + np.frombuffer(y, np.int64)
        yield _binary([tuple(x.tobytes() for x in (h, c, words, counts))], (pa.binary(),) * 4, ("heads", "head_counts", "band_words", "band_counts"))

    schema = "heads binary, head_counts binary, band_words binary, band_counts binary"
    stats = replies.where("heads is not null")
    few = n_buckets
    while few > _FAN_IN:
        few = -(-few // _FAN_IN)
        stats = stats.withColumn("part", F.pmod(F.xxhash64("heads"), F.lit(few))).repartition(few, "part")
        stats = map_arrow(stats.select("heads", "head_counts", "band_words", "band_counts"), reduce, schema)
    row = map_arrow(stats.select("heads", "head_counts", "band_words", "band_counts").repartition(1), reduce, schema).first()
    arrays = [np.frombuffer(bytes(row[i]), t) for i, t in enumerate((np.uint64, np.int64, np.int64, np.int64))]
    return Vocabulary(*arrays, n_train)


def _code_documents(blocks: DataFrame, replies: DataFrame, vocabulary: Vocabulary, id_type: str) -> DataFrame:
    """Documents as symbols, with their base scores."""
    shared = blocks.sparkSession.sparkContext.broadcast(vocabulary)
    names = ("id", "held", "n_tokens", "n_known", "base_score", "tail_score", "symbols")

    def code(left: pa.Table, right: pa.Table) -> pa.Table:
        v = shared.value
        parts = sorted(zip(*(right.column(n).to_pylist() for n in ("bucket", "c", "top_at", "top_hash")), strict=True))
        c = np.concatenate([np.frombuffer(p[1], np.int64) for p in parts] or [np.empty(0, np.int64)])
        symbol = (HEADS + band_of(c)).astype(np.uint16)
        tail = v.tail_score(c)
        base = np.log10(c + 1.0) - v.norm
        at = 0
        for p in parts:
            h, local = np.frombuffer(p[3], np.uint64), np.frombuffer(p[2], np.uint32).astype(np.int64) + at
            k = np.searchsorted(v.hashes, h)
            k[k == len(v.hashes)] = 0
            hit = v.hashes[k] == h if len(v.hashes) else np.zeros(len(h), bool)
            symbol[local[hit]] = v.symbols[k[hit]]
            tail[local[hit]] = 0
            at += len(p[1]) // 8
        end_base = np.log10(v.n_train + 1.0) - v.norm
        rows = []
        for doc, held, toks in zip(*(left.column(n).to_pylist() for n in ("id", "held", "toks")), strict=True):
            t = np.frombuffer(toks, np.uint32)
            ids = np.concatenate([symbol[t], np.zeros(1, np.uint16)])
            rows.append((doc, held, len(t) + 1, int((c[t] > 0).sum()) + (v.n_train > 0), float(base[t].sum() + end_base), float(tail[t].sum()), ids.tobytes()))
        types = (left.schema.field("id").type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
        return pa.Table.from_batches([_binary(rows, types, names)])

    docs = blocks.where("toks is not null").select("block", "id", "held", "toks")
    answers = replies.select("block", "bucket", "c", "top_at", "top_hash")
    schema = f"id {id_type}, held boolean, n_tokens long, n_known long, base_score double, tail_score double, symbols binary"
    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(code, schema)


def _pack_shards(coded: DataFrame, n_shards: int, id_type: str) -> DataFrame:
    """One row for each shard with all its documents, in the order of their hash."""
    names = ("shard", "ids", "held", "n_tokens", "n_known", "base_score", "tail_score", "symbols")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            whole = pa.Table.from_batches(parts).combine_chunks()
            ids = whole.column("id").combine_chunks()
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids)
            flat = [whole.column(n).to_numpy().astype(t).tobytes() for n, t in (("held", bool), ("n_tokens", np.int64), ("n_known", np.int64), ("base_score", float), ("tail_score", float))]
            symbols = b"".join(whole.column("symbols").to_pylist())
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), ids, *(pa.array([x], pa.binary()) for x in (*flat, symbols))], names=list(names))

        shard, parts = None, []
        for batch in batches:
            own = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if parts and own[i] != shard:
                    yield close()
                    parts = []
                shard = int(own[i]) if j > i else shard
                if j > i:
                    parts.append(batch.slice(i, j - i))
        if parts:
            yield close()

    h = F.xxhash64("id", "symbols")
    dealt = coded.select("*", h.alias("h")).withColumn("shard", F.pmod(F.xxhash64(F.lit(5), "h", "copy"), F.lit(n_shards)).cast("int"))
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "h", "copy")
    dealt = dealt.select("shard", "id", "held", "n_tokens", "n_known", "base_score", "tail_score", "symbols")
    schema = f"shard int, ids array<{id_type}>, " + ", ".join(f"{n} binary" for n in names[2:])
    return map_arrow(dealt, pack, schema)


def _texts(symbols: bytes, n_tokens: bytes) -> list[np.ndarray]:
    """The documents of a shard."""
    ends = np.cumsum(np.frombuffer(n_tokens, np.int64))
    return np.split(np.frombuffer(symbols, np.uint16), ends[:-1])


def _average(copies: DataFrame, n_shards: int) -> np.ndarray | None:
    """Mean of the networks, weighted by the symbols they saw, added up in the order of their shards.

    Each step adds up to ``_FAN_IN`` neighbours, so no task reads more networks than that and the driver gets one.
    """
    schema = "at int, w double, flat binary"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, weight, total = None, 0.0, None
        for batch in batches:
            for p, w, flat in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if p != part and total is not None:
                    yield _binary([(part, weight, (total / weight).tobytes())], (pa.int32(), pa.float64(), pa.binary()), ("at", "w", "flat"))
                    weight, total = 0.0, None
                x = w * np.frombuffer(flat, np.float64)
                part, weight, total = p, weight + w, x if total is None else total + x
        if total is not None:
            yield _binary([(part, weight, (total / weight).tobytes())], (pa.int32(), pa.float64(), pa.binary()), ("at", "w", "flat"))

    rows, few = copies, n_shards
    while True:
        few = -(-few // _FAN_IN)
        rows = rows.select(F.expr(f"at div {_FAN_IN}").cast("int").alias("part"), "at", "w", "flat").repartition(few, "part").sortWithinPartitions("part", "at")
        rows = map_arrow(rows, add, schema)
        if few == 1:
            break
    found = rows.collect()
    return np.frombuffer(bytes(found[0].flat), np.float64).astype(np.float32) if found else None


def train_network(shards: DataFrame, vocabulary: Vocabulary, n_shards: int, rounds: int = 2) -> gru.Gru:
    """One pass over all training documents in ``rounds`` disjoint shares.

    In each round every shard trains a copy on its documents of the share,
    starting from the common network, and the copies are averaged.
    """
    net = gru.Gru.initial(vocabulary.counts, HEADS, BANDS)
    context = shards.sparkSession.sparkContext
    training = shards.select("shard", "held", "n_tokens", "symbols")
    for r in range(rounds):
        start = context.broadcast(net.flat)

        def fit(batches: Iterator[pa.RecordBatch], r=r, start=start) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard, held, n_tokens, symbols in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    texts = _texts(symbols, n_tokens)
                    docs = [texts[i] for i in np.flatnonzero(~np.frombuffer(held, bool))[r::rounds].tolist()]
                    if not docs:
                        continue
                    own = gru.Gru(HEADS, BANDS, start.value.copy())
                    seen = gru.train(own, docs, gru.Adam(own))
                    yield _binary([(shard, float(seen), own.flat.astype(np.float64).tobytes())], (pa.int32(), pa.float64(), pa.binary()), ("at", "w", "flat"))

        copies = materialize(map_arrow(training, fit, "at int, w double, flat binary"), "lm-copies")
        flat = _average(copies, n_shards)
        drop_tables(copies)
        start.unpersist()
        if flat is not None:
            net = gru.Gru(HEADS, BANDS, flat)
    return net


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Scores of every whole document.

    Returns ``id_col``, ``held_out``, ``n_tokens`` (words and the end), ``n_known`` (tokens
    with a training count), ``train_tokens``, ``base_score`` (add-one unigram) and
    ``score`` (the network's log10 probability of the text).

    A null or blank text is the end alone; a null id is learned from; repeated
    rows count as often as they are in the table; without training documents every
    word is unseen; other columns are left out; an empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = materialize(_number_words(docs, id_col, text_col), "lm-blocks", "zstd")
    rows = blocks.where("toks is not null")
    facts = rows.agg(F.count("*").alias("n"), F.count_if(~F.col("held")).alias("learned"), F.coalesce(F.sum(F.octet_length("toks") / 4), F.lit(0)).alias("words")).first()
    n_blocks = blocks.where("words is not null").count()
    n_shards = max(1, round((facts.n + facts.words) / shard_tokens))
    n_buckets = 1 << min(16, max(4, int(np.ceil(np.log2(2 * n_blocks + 1)))))
    replies = materialize(_gather_counts(blocks, n_buckets), "lm-counts", "zstd")
    if n_blocks and replies.limit(1).count():
        vocabulary = _vocabulary(replies, facts.learned, n_buckets)
    else:
        none = np.empty(0, np.int64)
        vocabulary = Vocabulary(none.view(np.uint64), none, np.zeros(BANDS, np.int64), np.zeros(BANDS, np.int64), facts.learned)
    coded = _code_documents(blocks, replies, vocabulary, kind)
    most = rows.groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    coded = number_copies(count_copies(coded), most) if most > _MANY else coded.withColumn("copy", F.lit(0).cast("long"))
    shards = materialize(_pack_shards(coded, n_shards, kind), "lm-shards", "zstd")
    drop_tables(blocks, replies)
    net = train_network(shards, vocabulary, n_shards, rounds)
    shared = spark.sparkContext.broadcast(net.flat)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = gru.Gru(HEADS, BANDS, shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch.column(1)[k].values
                held, n_tokens, n_known, base, tail, symbols = (batch.column(i)[k].as_py() for i in range(2, 8))
                score = gru.score(own, _texts(symbols, n_tokens)) + np.frombuffer(tail)
                columns = [ids, pa.array(np.frombuffer(held, bool)), *(pa.array(np.frombuffer(x, np.int64)) for x in (n_tokens, n_known)), pa.array(np.frombuffer(base)), pa.array(score)]
                whole = pa.RecordBatch.from_arrays(columns, names=["id", "held", "n_tokens", "n_known", "base_score", "score"])
                for at in range(0, len(ids), 2000):
                    yield whole.slice(at, 2000)

    rated = map_arrow(shards, rate, f"id {kind}, held boolean, n_tokens long, n_known long, base_score double, score double")
    return rated.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(vocabulary.total).cast("long").alias("train_tokens"), "base_score", "score")
