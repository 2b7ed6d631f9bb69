"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over a window of words: some positions count, the others
are ignored, so a substitution at an ignored position leaves the hash unchanged.
Hashes of benchmark windows meet those of document windows, and every hit is
verified on its diagonal: the benchmark item is laid over the document at the
hit's offset, words are compared place by place, and some stretch with a score
above 0 (a match earns 1, a mismatch costs ``penalty``) must have ``min_matches``
matches, or 7 in 10 of the item's words if that is less.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upslope.llm._arrow import map_arrow
from upslope.llm._text import _MIX, WORD, finalize, utf8, word_hashes
from upslope.scratch import materialize

#: Masks of weight 6 over windows of 6 to 10 words; a substitution leaves the seeds intact that ignore its place.
SEEDS = ("111111", "1110111", "11010111", "1011001101")
#: Further masks of weight 4, each for items of 6 words to so many: with ``SEEDS`` they meet every way to
#: substitute up to 3 in 10 words of an item of 6 to 18.
SHORT_SEEDS = (("1111", 18), ("11011", 18), ("1100101", 11), ("1010011", 11), ("10111", 7), ("101011", 7))
#: Items with fewer words are looked up as a whole, every word equal.
LEAST_WORDS = 6
_EDGE = "\"'`.,;:!?()[]{}<>*_"


def normal_words(text: bytes) -> list[bytes]:
    """Lower-case words without punctuation at their ends; words of punctuation alone drop out."""
    return [w for w in (x.strip(_EDGE.encode()) for x in text.lower().split()) if w]


def seed_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    """The hash of every window of a word-hash array under one mask."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, len(mask), np.uint64)
        for i, c in enumerate(mask):
            if c == "1":
                out = out * _MIX + h[i : i + n]
        return finalize(out)


def best_stretch(same: np.ndarray, penalty: int) -> tuple[int, int, int]:
    """(matches, start, end) of the stretch with the highest score, the earliest of equal ones."""
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, -penalty))])
    low = np.minimum.accumulate(score)
    end = int(np.argmax(score - low))
    start = int(np.argmin(score[: end + 1]))
    return int(same[start:end].sum()), start, end


def dense_stretch(same: np.ndarray, penalty: int) -> tuple[int, int, int]:
    """(matches, start, end) of the stretch with the most matches among those with a score above 0."""
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, -penalty))])
    total = np.concatenate([[0], np.cumsum(same)])
    # The running minimum falls, so the first place below an end's score is the farthest start.
    first = np.searchsorted(-np.minimum.accumulate(score), -score, "right")
    first = np.minimum(first, np.arange(len(score)))
    end = int(np.argmax(total - total[first]))
    at = np.flatnonzero(same[first[end] : end])
    return (len(at), int(first[end] + at[0]), int(first[end] + at[-1]) + 1) if len(at) else (0, 0, 0)


def needed(n_words: int, min_matches: int) -> int:
    """Matches asked of an item: all of up to five words, else 7 in 10, rounded up; ``min_matches`` at most."""
    return n_words if n_words < LEAST_WORDS else min(min_matches, -(-7 * n_words // 10))


class Index:
    """Seed hashes of benchmark items, sorted, with a bit table in front."""

    def __init__(self, ids: list, words: list[np.ndarray], seeds: tuple[str, ...]):
        self.ids, self.words = ids, words
        self.seeds, self.tables = [], []
        lengths = [(m, LEAST_WORDS, None) for m in seeds] + [(m, LEAST_WORDS, most) for m, most in SHORT_SEEDS] + [("1" * n, n, n) for n in range(1, LEAST_WORDS)]
        for mask, fewest, most in lengths:
            hs = [seed_hashes(h if fewest <= len(h) <= (most or len(h)) else h[:0], mask) for h in words]
            if not any(map(len, hs)):
                continue
            self.seeds.append(mask)
            at = np.concatenate([np.arange(len(x)) for x in hs] or [np.empty(0, int)])
            item = np.repeat(np.arange(len(hs)), [len(x) for x in hs])
            flat = np.concatenate(hs or [np.empty(0, np.uint64)])
            order = np.argsort(flat, kind="stable")
            bits = np.zeros(1 << 20, bool)
            bits[(flat & np.uint64(0xFFFFF)).astype(np.int64)] = True
            self.tables.append((flat[order], item[order], at[order], bits))

    def hits(self, h: np.ndarray) -> set[tuple[int, int]]:
        """(item, offset of the item's first word in the document) of all seed hits."""
        out: set[tuple[int, int]] = set()
        for mask, (flat, item, at, bits) in zip(self.seeds, self.tables, strict=True):
            windows = seed_hashes(h, mask)
            near = np.flatnonzero(bits[(windows & np.uint64(0xFFFFF)).astype(np.int64)])
            if not len(near):
                continue
            first = np.searchsorted(flat, windows[near], "left")
            last = np.searchsorted(flat, windows[near], "right")
            for p, a, b in zip(near[last > first].tolist(), first[last > first].tolist(), last[last > first].tolist(), strict=True):
                out.update(zip(item[a:b].tolist(), (p - at[a:b]).tolist(), strict=True))
        return out

    def overlaps(self, h: np.ndarray, min_matches: int, penalty: int) -> dict[int, tuple[int, int, int]]:
        """item -> (matches, start, end in document words) of the best verified overlap."""
        out: dict[int, tuple[int, int, int]] = {}
        for i, offset in self.hits(h):
            own = self.words[i]
            lo, hi = max(0, offset), min(len(h), offset + len(own))
            same, enough = h[lo:hi] == own[lo - offset : hi - offset], needed(len(own), min_matches)
            if int(same.sum()) < enough:
                continue
            matches, start, end = best_stretch(same, penalty)
            if matches < enough:
                matches, start, end = dense_stretch(same, penalty)
            if matches >= enough:
                out[i] = max(out.get(i, (0, 0, 0)), (matches, lo + start, lo + end), key=lambda x: (x[0], -x[1]))
        return out


_INDEXES: dict[str, Index] = {}


def _index(block) -> Index:
    """The worker's index of a broadcast block; it keeps the last one between tasks."""
    if block.value[0] not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[block.value[0]] = Index(*block.value[1:])
    return _INDEXES[block.value[0]]


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    seeds: tuple[str, ...] = SEEDS,
    min_matches: int = 13,
    penalty: int = 2,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """Pairs of documents and benchmark items with a verified overlap.

    Returns ``id_col``, ``item_col``, ``matches`` (equal words in the stretch),
    ``start_word`` and ``end_word`` (normalised words of the document, end
    exclusive).  The stretch is the one with the highest score if it has enough
    matches, else the one with the most; of equal ones the earliest.  An item of up to five words is
    found where all its words stand in sequence.  Items come to the executors in blocks of about ``block_bytes`` of text,
    each block against all documents, so what is broadcast does not grow with
    the benchmark.

    Null and blank texts or items overlap with nothing; repeated documents are judged
    alike, and repeated items (equal id and text) count once; null ids are reported as null; other columns are
    left out; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("item"), utf8(F.col(item_text_col)).alias("t"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first().b
    n_blocks = max(1, math.ceil(total / block_bytes))
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, matches long, start_word long, end_word long"
    out = None
    for k in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64("item", "t"), F.lit(n_blocks)) == k).distinct().orderBy("item").collect()
        words = [word_hashes(normal_words(bytes(r.t))) for r in block]
        index = spark.sparkContext.broadcast((uuid.uuid4().hex, [r.item for r in block], words, seeds))

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            search = _index(index)
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found = search.overlaps(word_hashes(normal_words(text)), min_matches, penalty)
                    rows += [(doc, search.ids[i], *found[i]) for i in sorted(found)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], batch.schema.field(0).type), pa.array([r[1] for r in rows], to_arrow), *(pa.array([r[i] for r in rows], pa.int64()) for i in (2, 3, 4))],
                    names=["id", "item", "matches", "start_word", "end_word"],
                )

        to_arrow = pa.int64() if item_kind == "bigint" else pa.int32() if item_kind == "int" else pa.string()
        part = map_arrow(docs.select(F.col(id_col), utf8(F.col(text_col)).alias("t")), scan, schema)
        out = part if out is None else out.union(part)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "matches", "start_word", "end_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = 500_000, least_words: int = LEAST_WORDS, **options) -> DataFrame:
    """``docs`` without the documents that overlap a benchmark item; all columns pass through.

    Items below ``least_words`` words are no reason to drop a document: a clean text may hold them by chance.
    Each row is judged by its own text, so null and repeated ids don't matter; null and empty texts stay,
    an empty table on either side drops nothing.  The
    fingerprints of texts that go are broadcast only while there are at most ``broadcast_rows``.
    """
    text, item_text = options.pop("text_col", "text"), options.get("item_text_col", "text")
    items = benchmark.where(F.regexp_count(F.coalesce(F.col(item_text), F.lit("")), F.lit(WORD)) >= least_words)
    key = F.sha2(utf8(docs[text]), 256)
    keyed = docs.select(key.alias("__key"), docs[text].alias("__text"))
    gone = find_overlaps(keyed, items, "__key", "__text", **options).select(F.col("__key").alias("__gone"))
    gone = materialize(gone.distinct(), "decon-gone")
    if gone.count() <= broadcast_rows:
        gone = F.broadcast(gone)
    return docs.join(gone, key == F.col("__gone"), "left_anti")
