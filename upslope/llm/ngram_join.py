"""Exact Jaccard join on word n-grams, as a distributed T-occurrence search.

A document's set are the hashes of its distinct shingles; documents with equal
sets are one node.  Two sets with similarity t share a shingle among the first
``n - ceil(t * n) + 1`` of each, in any order of shingles that all sets use.
The order here puts shingles that many documents hold last, so short inverted
lists decide.

1. One pass over the texts writes every node's sorted set and finds shingles that
   are frequent within a task.  A second counts the first shingles of all sets over the
   whole table and adds those whose list is long, though no task held many of them.
   The most frequent ones go last in the order; they only steer it: a shingle missing there costs time, not links.
2. Inverted lists of the first shingles give candidates.  Of a list up to
   ``SHORT_LIST`` nodes all pairs are counted; a pair stays if what its prefixes share
   leaves the required overlap within reach.  A longer list is cut down to a
   star, within a task and then across tasks, so a list of m nodes leaves m - 1
   edges.  The components of pairs and stars are the candidate groups.
3. Each group is joined on whole sets with DivideSkip: the short lists of a node are
   merged, the L longest are probed by binary search for the nodes that
   occur often enough in the short ones, and a pair stays if the shared
   shingles reach the required overlap.  A group above ``SPLIT_NODES`` nodes or
   ``block_shingles`` is cut by set size, so that only neighbouring
   size classes can match, and each class into blocks; pairs of blocks
   are joined as tasks of their own.
4. Linked nodes form classes by connected components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from upslope.llm._arrow import map_arrow
from upslope.llm._text import shingle_hashes, utf8
from upslope.operators.graph import connected_components
from upslope.scratch import drop_tables, materialize

#: Entries of the table of frequent shingles (16 bytes each when broadcast).
MAX_FREQUENT = 1 << 18
#: Entries of inverted lists that one bucket should hold, and the bits that number the buckets.
_BUCKET_ENTRIES = 1 << 18
_BUCKET_BITS = (12, 18)
#: Counts of first shingles over the whole table, and the share of them that new long lists must hold for another.
_ROUNDS = 8
_WORTH = 0.01
#: Longest inverted list of which all pairs are counted.
SHORT_LIST = 64
#: Groups above so many nodes are cut into blocks of about half as many, up to ``MOST_BLOCKS`` unless memory asks for more.
SPLIT_NODES = 128
MOST_BLOCKS = 32
#: Shingles that a task holds at once.
_HELD = 2_000_000


def required(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Least overlap of a set of ``n`` with any set at the threshold: ceil(percent * n / 100)."""
    return (percent * n + 99) // 100


def _columns(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[tuple]:
    """The rows of a batch as Python values, a slice at a time."""
    for k in range(0, batch.num_rows, rows):
        yield from zip(*(c.to_pylist() for c in batch.slice(k, rows).columns), strict=True)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _node_table(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n, node, items): the set of each row as bytes of sorted 64-bit hashes; node is null without words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            items = [shingle_hashes(t, width) for t in batch.column(1).to_pylist()]
            raw = [x.tobytes() for x in items]
            node = [xxhash.xxh3_64_intdigest(r, seed=len(r)) - (1 << 63) if r else None for r in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in items], pa.int64()), pa.array(node, pa.int64()), pa.array(raw, pa.binary())],
                names=["id", "n", "node", "items"],
            )

    return map_arrow(docs.select(F.col(id_col), utf8(F.col(text_col)).alias("t")), sets, f"id {kind}, n long, node long, items binary")


def _first_shingles(nodes: DataFrame, percent: int) -> int:
    """About how many shingles come first in their sets."""
    size = nodes.where("node is not null").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).first()
    return (size.n or 0) * (100 - percent) // 100 + size.rows


def _bucket_bits(entries: int) -> int:
    """Bits of a hash that number the buckets of inverted lists: more for larger tables, so that a bucket stays in memory."""
    low, high = _BUCKET_BITS
    return min(high, max(low, math.ceil(math.log2(max(1, entries / _BUCKET_ENTRIES)))))


def _cut_buckets(h: np.ndarray, bits: int, *columns: np.ndarray) -> Iterator[tuple]:
    """(bucket, part of h, parts of the columns) by the upper bits of sorted hashes."""
    bucket = (h >> np.uint64(64 - bits)).astype(np.int32)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    return ((int(k[0]), *part) for k, *part in zip(*(np.split(x, cuts) for x in (bucket, h, *columns)), strict=True) if len(k))


def _most_frequent(top: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the most frequent shingles of (h, c), at most ``MAX_FREQUENT`` and cut between counts."""
    above = 0
    for r in top.groupBy(F.least("c", F.lit(4096)).alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("c")).collect():
        if above and above + r.n > MAX_FREQUENT:
            break
        above, least = above + r.n, r.c

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy().tobytes()], pa.binary()) for c in batch.columns], names=["h", "c"])

    rows = map_arrow(top.where(F.col("c") >= least).limit(MAX_FREQUENT), pack, "h binary, c binary").collect()
    h = np.frombuffer(b"".join(bytes(r.h) for r in rows), np.int64).view(np.uint64)
    return h, np.frombuffer(b"".join(bytes(r.c) for r in rows), np.int64)


def _ordered(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Sorted hashes and their places by count, of the ``MAX_FREQUENT`` with the largest counts."""
    by_count = np.lexsort((h, c))[-MAX_FREQUENT:]
    h = h[by_count]
    order = np.argsort(h)
    return np.stack([h[order], order.astype(np.uint64)])


def _frequent(nodes: DataFrame, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that stand out within tasks and their counts, most frequent ones at most ``MAX_FREQUENT``."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate(parts), return_counts=True)
            u, c = u[c > 1], c[c > 1]
            return pa.RecordBatch.from_arrays([_signed(u), pa.array(c, pa.int64())], names=["h", "c"])

        for batch in batches:
            for node, items in _columns(batch):
                if node in seen:
                    continue
                seen.add(node)
                parts.append(np.frombuffer(items, np.uint64))
                held += len(parts[-1])
                if held > _HELD:
                    yield flush()
                    parts, held = [], 0
                    seen = set()
        if parts:
            yield flush()

    counts = map_arrow(nodes.where("node is not null").select("node", "items"), local, "h long, c long")
    top = materialize(counts.groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= least), "ngram-frequent")
    found = _most_frequent(top, least)
    drop_tables(top)
    return found


def _common_order(nodes: DataFrame, percent: int, entries: int) -> np.ndarray:
    """Sorted hashes and places of the shingles that come last in the common order.

    Those that stand out within tasks make a first order.  The first shingles of all sets
    under it are counted over the whole table; a list above ``SHORT_LIST`` makes its shingle frequent
    as well, so that its documents meet in rarer ones.  As those may be frequent too, the count is repeated,
    ``_ROUNDS`` times at most, while what it finds holds a share of ``_WORTH`` of all first shingles.
    """
    h, c = _frequent(nodes)
    for _ in range(_ROUNDS):
        more, n = _long_lists(nodes, _ordered(h, c), percent, _bucket_bits(entries))
        new = n[~np.isin(more, h)].sum()
        every, at = np.unique(np.concatenate([h, more]), return_inverse=True)
        most = np.zeros(len(every), np.int64)
        np.maximum.at(most, at, np.concatenate([c, n]))
        h, c = every, most
        if new < _WORTH * entries:
            break
    return _ordered(h, c)


def _long_lists(nodes: DataFrame, frequent: np.ndarray, percent: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and lengths of the lists above ``SHORT_LIST`` nodes, the longest at most ``MAX_FREQUENT``."""
    shared = nodes.sparkSession.sparkContext.broadcast(frequent)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            h = np.concatenate(hs)
            mark = np.repeat(np.array(list(seen), np.int64), [len(x) for x in hs]).astype(np.uint16)
            order = np.argsort(h, kind="stable")
            h, mark, many = h[order], mark[order], _lengths(h[order])
            keep = (many <= SHORT_LIST) | np.concatenate([[True], h[1:] != h[:-1]])  # of a long list one entry stands for all
            many = np.where(many <= SHORT_LIST, 1, np.minimum(many, 65535)).astype(np.uint16)
            rows = [(k, *(x.tobytes() for x in part)) for k, *part in _cut_buckets(h[keep], bits, mark[keep], many[keep])]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "h", "mark", "many"])

        seen: dict[int, None] = {}
        hs: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for node, items in _columns(batch):
                if node in seen:
                    continue
                seen[node] = None
                hs.append(prefix(np.frombuffer(items, np.uint64), shared.value, percent)[0])
                held += len(hs[-1])
                if held > _HELD // 2:
                    yield flush()
                    hs, held = [], 0
                    seen = {}
        if hs:
            yield flush()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            h, mark, many = (np.concatenate(x) for x in (hs, marks, counts))
            order = np.lexsort((mark, h))
            h, mark, many = h[order], mark[order], many[order].astype(np.int64)
            again = np.concatenate([[False], (h[1:] == h[:-1]) & (mark[1:] == mark[:-1])])
            many[again] -= 1  # equal sets of several tasks count once
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            n = np.add.reduceat(many, first)
            long = n > SHORT_LIST
            return pa.RecordBatch.from_arrays([_signed(h[first][long]), pa.array(n[long], pa.int64())], names=["h", "c"])

        hs, marks, counts, bucket = [], [], [], None
        for batch in batches:
            for k, a, b, c in _columns(batch):
                if k != bucket and hs:
                    yield close()
                    hs, marks, counts = [], [], []
                bucket = k
                hs.append(np.frombuffer(a, np.uint64))
                marks.append(np.frombuffer(b, np.uint16))
                counts.append(np.frombuffer(c, np.uint16))
        if hs:
            yield close()

    lists = map_arrow(nodes.where("node is not null").select("node", "items"), local, "bucket int, h binary, mark binary, many binary")
    dealt = lists.repartition("bucket").sortWithinPartitions("bucket")
    long = materialize(map_arrow(dealt, total, "h long, c long"), "ngram-long")
    shared.unpersist()
    found = _most_frequent(long, SHORT_LIST + 1)
    drop_tables(long)
    return found


def prefix(items: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The shingles of a set that come first in the common order, and the place of the last of them.

    Places grow with the order: half the hash for ordinary shingles, then the
    frequent ones by count.
    """
    size = len(items) - required(len(items), percent) + 1
    place = items >> np.uint64(1)
    if frequent.shape[1]:
        at = np.searchsorted(frequent[0], items)
        at[at == frequent.shape[1]] = 0
        hit = frequent[0][at] == items
        place[hit] = frequent[1][at[hit]] + np.uint64(1 << 63)
    first = np.argsort(place, kind="stable")[:size]
    return items[first], int(place[first[-1]] >> np.uint64(1))


def _star(h: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the nodes of each hash to the first of them; ``h`` is sorted."""
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    head = node[np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))] if len(h) else node
    edge = head != node
    return node[edge], head[edge]


def _lengths(h: np.ndarray) -> np.ndarray:
    """Of each entry of a sorted array the number of equal ones."""
    cuts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]])) if len(h) else np.zeros(1, int)
    return np.repeat(np.diff(cuts), np.diff(cuts))


def _counted(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and how often each occurs."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(x) else np.zeros(0, int)
    return x[first], y[first], np.diff(np.concatenate([first, [len(x)]]))


PAIR, EDGE, NODE = 0, 1, 2


def _candidate_edges(nodes: DataFrame, frequent: np.ndarray, percent: int, bits: int) -> DataFrame:
    """Edges (src, dst) between nodes that may be similar; pairs that share no path of them are not."""
    shared = nodes.sparkSession.sparkContext.broadcast(frequent)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            h = np.concatenate(hs)
            node = np.repeat(np.array(ids, np.int64), [len(x) for x in hs])
            order = np.lexsort((node, h))
            h, node = h[order], node[order]
            again = np.concatenate([[False], (h[1:] == h[:-1]) & (node[1:] == node[:-1])])
            h, node = h[~again], node[~again]
            long = _lengths(h) > SHORT_LIST
            src, dst = _star(h[long], node[long])
            src, dst, _ = _counted(src, dst)
            heads = long & np.concatenate([[True], h[1:] != h[:-1]])
            keep = ~long | heads
            h, node, star = h[keep], node[keep], heads[keep]
            rows = [(k, -1, *(x.tobytes() for x in part)) for k, *part in _cut_buckets(h, bits, node, star)]
            own = int(ids[0]) & ((1 << bits) - 1)
            rows.append((own, EDGE, src.tobytes(), dst.tobytes(), b""))
            rows.append((own, NODE, np.array(ids, np.int64).tobytes(), np.array(places, np.int64).tobytes(), np.array(sizes, np.int64).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "kind", "a", "b", "c"])

        hs, ids, places, sizes, held = [], [], [], [], 0
        for batch in batches:
            for node, raw in _columns(batch):
                items = np.frombuffer(raw, np.uint64)
                first, place = prefix(items, shared.value, percent)
                hs.append(first)
                ids.append(node)
                places.append(place)
                sizes.append(len(items))
                held += len(first)
                if held > _HELD // 2:
                    yield flush()
                    hs, ids, places, sizes, held = [], [], [], [], 0
        if hs:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, ns, stars, bucket = [], [], [], None
        xs, ys, held = [], [], 0

        def out(kind: int, x: np.ndarray, y: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), *(pa.array(v.astype(np.int64)) for v in (x, y, m))], names=["kind", "x", "y", "m"])

        def close() -> pa.RecordBatch:
            nonlocal held
            h, node, star = np.concatenate(hs), np.concatenate(ns), np.concatenate(stars)
            order = np.lexsort((node, h))
            h, node, star = h[order], node[order], star[order]
            again = np.concatenate([[False], (h[1:] == h[:-1]) & (node[1:] == node[:-1])])
            starred = np.unique(h[star])
            h, node = h[~again], node[~again]
            long = (_lengths(h) > SHORT_LIST) | np.isin(h, starred)
            src, dst, m = _counted(*_star(h[long], node[long]))
            h, node = h[~long], node[~long]
            for d in range(1, SHORT_LIST):
                same = h[d:] == h[:-d]
                if not same.any():
                    break
                xs.append(node[:-d][same])
                ys.append(node[d:][same])
                held += int(same.sum())
            return out(EDGE, src, dst, m)

        for batch in batches:
            for k, kind, a, b, c in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if kind != -1:
                    x, y = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
                    yield out(kind, x, y, np.frombuffer(c, np.int64) if c else np.ones(len(x)))
                    continue
                if k != bucket and hs:
                    yield close()
                    hs, ns, stars = [], [], []
                    if held > 2_000_000:
                        yield out(PAIR, *_counted(np.concatenate(xs), np.concatenate(ys)))
                        xs, ys, held = [], [], 0
                bucket = k
                hs.append(np.frombuffer(a, np.uint64))
                ns.append(np.frombuffer(b, np.int64))
                stars.append(np.frombuffer(c, bool))
        if hs:
            yield close()
        if xs:
            yield out(PAIR, *_counted(np.concatenate(xs), np.concatenate(ys)))

    schema = "bucket int, kind int, a binary, b binary, c binary"
    posted = map_arrow(nodes.where("node is not null").select("node", "items"), lists, schema)
    dealt = posted.repartition("bucket").sortWithinPartitions("bucket")
    met = materialize(map_arrow(dealt, meet, "kind int, x long, y long, m long"), "ngram-met")
    shared.unpersist()
    pairs = met.where(F.col("kind") == PAIR).groupBy("x", "y").agg(F.sum("m").alias("m"))
    info = met.where(F.col("kind") == NODE).groupBy(F.col("x").alias("node")).agg(F.first("y").alias("place"), F.first("m").alias("n"))
    near = pairs.join(info.select(F.col("node").alias("x"), F.col("place").alias("px"), F.col("n").alias("nx")), "x")
    near = near.join(info.select(F.col("node").alias("y"), F.col("place").alias("py"), F.col("n").alias("ny")), "y")
    # up to the smaller last place all shared shingles are counted; beyond it that set has required(n) - 1 more
    bound = F.when(F.col("px") < F.col("py"), F.col("nx")).when(F.col("px") > F.col("py"), F.col("ny")).otherwise(F.greatest("nx", "ny"))
    rest = F.floor((bound * percent + 99) / 100) - 1
    reach = (100 + percent) * (F.col("m") + rest) >= percent * (F.col("nx") + F.col("ny"))
    alike = 100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")
    near = near.where(reach & alike).select(F.col("x").alias("src"), F.col("y").alias("dst"))
    stars = met.where(F.col("kind") == EDGE).select(F.col("x").alias("src"), F.col("y").alias("dst"))
    edges = materialize(near.union(stars).distinct(), "ngram-edges")
    drop_tables(met)
    return edges


def divide_skip(sets: list[np.ndarray], percent: int, pair_of: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Links of each set to earlier ones: pairs of its index and the indexes of its partners.

    ``sets`` are ordered by size, ascending.  With ``pair_of`` (0 or 1 for each set) only
    links between different sides count.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    universe, item, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(item, kind="stable")  # inverted lists, one after another, owners ascending
    lists, start = owner[order], np.concatenate([[0], np.cumsum(count)])
    flat = item[order] * len(sets) + lists  # sorted, so that one binary search probes any list
    begin = np.concatenate([[0], np.cumsum(sizes)])
    low = 0
    for x in range(1, len(sets)):
        n = sizes[x]
        least = required(n, percent)
        while sizes[low] < least:
            low += 1
        if low >= x:
            continue
        own = item[begin[x] : begin[x + 1]]
        own = own[np.argsort(count[own], kind="stable")]
        longest = count[own[-1]]
        skipped = min(int(least) - 1, int(least / (np.log2(longest) + 1)))
        short, long = own[: n - skipped], own[n - skipped :]
        short = short[count[short] > 1]
        if not len(short):
            continue
        merged = np.concatenate([lists[start[i] : start[i + 1]] for i in short])
        merged = merged[(merged >= low) & (merged < x)] - low
        seen = np.bincount(merged, minlength=1)
        found = np.flatnonzero(seen >= least - skipped)
        if pair_of is not None:
            found = found[pair_of[found + low] != pair_of[x]]
        if not len(found):
            continue
        overlap = seen[found]
        found = found + low
        if len(long):
            probe = long[:, None] * len(sets) + found[None, :]
            at = np.searchsorted(flat, probe.ravel())
            at[at == len(flat)] = 0
            overlap = overlap + (flat[at] == probe.ravel()).reshape(probe.shape).sum(0)
        union = n + sizes[found] - overlap
        yield x, found[100 * overlap >= percent * union]


def _join_groups(members: DataFrame, percent: int) -> DataFrame:
    """(node, root, links) of each node in each group task; ``members`` has (task, side, node, copies, items)."""

    def one(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: (len(r[3]), r[1]))
        side = np.array([r[0] for r in rows])
        copies = np.array([r[2] for r in rows], np.int64)
        parent = np.arange(len(rows))
        links = np.zeros(len(rows), np.int64)

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        for x, partners in divide_skip(sets, percent, side if side.any() else None):
            links[x] += copies[partners].sum()
            links[partners] += copies[x]
            for root in {find(p) for p in partners.tolist()}:
                parent[root] = find(x)
        root = np.array([find(i) for i in range(len(rows))])
        least = np.full(len(rows), np.iinfo(np.int64).max)
        node = np.array([r[1] for r in rows], np.int64)
        np.minimum.at(least, root, node)
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(least[root], pa.int64()), pa.array(links, pa.int64())], names=["node", "root", "links"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        task = None
        for batch in batches:
            for t, *row in _columns(batch):
                if t != task and rows:
                    yield one(rows)
                    rows = []
                task = t
                rows.append(tuple(row))
        if rows:
            yield one(rows)

    dealt = members.select("task", "side", "node", "copies", "items").repartition("task").sortWithinPartitions("task")
    return map_arrow(dealt, join, "node long, root long, links long")


def _candidate_bits(groups: DataFrame, bits: int = 1 << 24) -> np.ndarray:
    """A bitmap of fixed size with a bit for each candidate node; it only spares work."""
    word = F.pmod("node", F.lit(bits))
    rows = groups.select(F.shiftright(word, 5).alias("w"), F.expr(f"cast(1 as bigint) << cast(pmod(node, {bits}) & 31 as int)").alias("b"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy().tobytes()], pa.binary()) for c in batch.columns], names=["w", "b"])

    out = np.zeros(bits >> 5, np.uint32)
    for r in map_arrow(rows.groupBy("w").agg(F.bit_or("b").alias("b")), pack, "w binary, b binary").collect():
        out[np.frombuffer(bytes(r.w), np.int64)] = np.frombuffer(bytes(r.b), np.int64).astype(np.uint32)
    return out


def similar_sets(nodes: DataFrame, percent: int, block_shingles: int = 1_000_000, written: list[DataFrame] | None = None) -> DataFrame:
    """(node, component, links): class and number of links to rows with other sets, of nodes with links.

    ``nodes`` is a written table (id, n, node, items).  Large tables that the result
    does not read are added to ``written``.
    """
    spark = nodes.sparkSession
    entries = _first_shingles(nodes, percent)
    edges = _candidate_edges(nodes, _common_order(nodes, percent, entries), percent, _bucket_bits(entries))
    groups = connected_components(edges)
    drop_tables(edges)
    bitmap = spark.sparkContext.broadcast(_candidate_bits(groups))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sent = np.int64(len(bitmap.value) * 32), set()
        for batch in batches:
            node = batch.column(0).to_numpy()
            at = node % bits
            hit = ((bitmap.value[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1)).astype(bool)
            for i in np.flatnonzero(hit).tolist():
                hit[i] = node[i] not in sent  # a task sends one of equal sets
                sent.add(node[i])
            if len(sent) > _HELD // 4:
                sent.clear()  # a node sent twice only costs its way
            yield batch.filter(pa.array(hit))

    held = nodes.where("node is not null").select("node", "n", "items")
    held = map_arrow(held, candidates, held.schema)
    whole = held.join(groups.select("node", F.col("component").alias("g")), "node")
    whole = whole.groupBy("g", "node").agg(F.first("n").alias("n"), F.first("items").alias("items"))
    whole = whole.join(nodes.where("node is not null").groupBy("node").agg(F.count("*").alias("copies")), "node")
    whole = materialize(whole, "ngram-groups")
    bitmap.unpersist()
    if written is not None:
        written.append(whole)
    step = max(math.log(100 / percent), 1e-6) * (1 + 1e-9)  # sets at the threshold are at most one class apart
    size_class = F.floor(F.log(F.col("n")) / step).cast("int").alias("size_class")
    counted = whole.select("g", size_class, "n").groupBy("g", "size_class").agg(F.count("*").alias("nodes"), F.sum("n").alias("shingles"))
    by_group = W.partitionBy("g")
    large = counted.withColumn("all_nodes", F.sum("nodes").over(by_group)).withColumn("all_shingles", F.sum("shingles").over(by_group))
    large = large.where((F.col("all_nodes") > SPLIT_NODES) | (F.col("all_shingles") > block_shingles))
    for_memory, for_tasks = F.ceil(F.col("shingles") / block_shingles), F.least(F.lit(MOST_BLOCKS), F.ceil(2 * F.col("nodes") / SPLIT_NODES))
    large = materialize(large.select(F.col("g").alias("lg"), F.col("size_class").alias("lc"), F.greatest(for_memory, for_tasks).cast("int").alias("k")), "ngram-large")
    if large.limit(1).count() == 0:
        out = _join_groups(whole.select(F.col("g").alias("task"), F.lit(0).alias("side"), "node", "copies", "items"), percent)
        out = materialize(out, "ngram-links")
        linked = out.select("node", F.col("root").alias("component"), "links")
        return linked.where("links > 0")
    blocks = large.select("lg", "lc", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("block"))
    a = blocks.select(F.col("lg").alias("ag"), F.col("lc").alias("ac"), F.col("block").alias("i"))
    b = blocks.select("lg", F.explode(F.array("lc", F.col("lc") - 1)).alias("near"), "lc", F.col("block").alias("j"))
    pairs = a.join(b, (F.col("ag") == F.col("lg")) & (F.col("ac") == F.col("near"))).where("lc > ac or i <= j")
    pairs = pairs.withColumn("task", F.xxhash64("ag", "ac", "i", "lc", "j"))
    sides = pairs.select("task", F.lit(0).alias("side"), F.col("ag").alias("sg"), F.col("ac").alias("sc"), F.col("i").alias("sb"))
    sides = sides.union(pairs.where("lc > ac or i < j").select("task", F.lit(1), "lg", "lc", "j"))
    cut = whole.withColumn("size_class", size_class).join(large, (F.col("g") == F.col("lg")) & (F.col("size_class") == F.col("lc")))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("node"), F.col("k").cast("long")).cast("int"))
    parts = cut.join(sides, (F.col("g") == F.col("sg")) & (F.col("size_class") == F.col("sc")) & (F.col("block") == F.col("sb")))
    parts = parts.select("task", "side", "node", "copies", "items")
    rest = whole.join(large.select("lg").distinct(), F.col("g") == F.col("lg"), "left_anti").select(F.col("g").alias("task"), F.lit(0).alias("side"), "node", "copies", "items")
    out = materialize(_join_groups(rest.union(parts), percent), "ngram-links")
    roots = connected_components(out.where("links > 0").select("node", "root"), "node", "root")
    total = out.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    return total.join(roots, "node").select("node", "component", "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, written: list[DataFrame] | None = None) -> DataFrame:
    """Class of every row under the links of an exact n-gram Jaccard join.

    Returns ``id_col``, ``n_shingles`` (size of the row's set), ``component_id``
    (smallest id of the class) and ``n_links`` (other rows at the threshold, copies included).

    Two rows link when 100 times their shared shingles is at least ``percent`` times
    the union.  Rows whose text has fewer than ``width`` words have one shingle,
    the whole sequence; null and blank texts have none, link with nothing and
    are their own class.  Repeated rows are copies of each other.  A null id
    takes part but names no class unless all ids of the class are null.
    An empty table gives no rows.  Intermediate tables that the result reads, or
    that only it could read, are added to ``written`` for the caller to drop.
    """
    nodes = materialize(_node_table(docs, id_col, text_col, width), "ngram-sets")
    linked = similar_sets(nodes, percent, written=written)
    if written is not None:
        written.append(nodes)
    own = nodes.where("node is not null").groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    own = materialize(own.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node")), "ngram-nodes")
    classes = own.groupBy("component").agg(F.min("first").alias("component_id"))
    named = own.join(classes, "component").select(F.col("node").alias("__node"), "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    rows = nodes.select("id", "n", "node")
    return rows.join(named, F.col("node") == F.col("__node"), "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, broadcast_rows: int = 500_000) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest id; all columns pass through.

    A document is an id with a text.  Rows that agree in both stay or go together; of texts that share an id
    the one with the smallest hash stays, and null ids come after all others.  Null and blank texts are in no
    class and stay; an empty table stays empty.  The documents
    that go are broadcast only while there are at most ``broadcast_rows``.
    """
    written: list[DataFrame] = []
    row = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))
    found = near_duplicates(docs.select(row.alias("__row"), F.col(text_col).alias("__text")), "__row", "__text", width, percent, written)
    gone = found.where(F.col("__row") != F.col("component_id")).select(F.col("__row.id").alias("__id"), F.col("__row.text").alias("__hash")).distinct()
    gone = materialize(gone, "ngram-gone")
    drop_tables(*written)
    if gone.count() <= broadcast_rows:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text_col]) == F.col("__hash")), "left_anti")
