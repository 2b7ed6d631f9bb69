"""Token ids in length-delimited binary records.

A data file is a sequence of records, each framed as

    length of the payload   8 bytes
    masked crc32 of those   4 bytes
    payload                 document id (8 bytes), tokens (4 bytes), the ids
    masked crc32 of it      4 bytes

with all integers little-endian.  Ids take 2 bytes each if the vocabulary has at
most 65,536 entries and 4 otherwise.  A checksum is masked by rotating it right by
15 bits and adding a constant, so that checksums of data that holds checksums
stay useful.  Beside each data file stands an index of its records' offsets (8
bytes each, and the file's length last), so that a reader can fetch any record.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upslope.llm._arrow import map_arrow, slices
from upslope.llm._text import utf8
from upslope.operators.ordering import prefix_sums
from upslope.scratch import materialize, new_path

_MASK_DELTA = 0xA282EAD8
_HEAD = struct.Struct("<QI")
_META = struct.Struct("<qI")
_FOOT = struct.Struct("<I")
#: Text that is encoded at once.
_BLOCK_BYTES = 5 << 20


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record around a payload."""
    length = struct.pack("<Q", len(payload))
    return length + _FOOT.pack(masked_crc(length)) + payload + _FOOT.pack(masked_crc(payload))


def unframe(data: bytes, at: int) -> tuple[bytes, int]:
    """The payload of the record at an offset and the offset after it; raises on a broken checksum."""
    length, check = _HEAD.unpack_from(data, at)
    if check != masked_crc(data[at : at + 8]):
        raise ValueError(f"broken length at {at}")
    end = at + _HEAD.size + length
    payload = data[at + _HEAD.size : end]
    if len(payload) != length or _FOOT.unpack_from(data, end)[0] != masked_crc(payload):
        raise ValueError(f"broken record at {at}")
    return payload, end + _FOOT.size


def pack_document(doc: int, ids: bytes, n: int) -> bytes:
    """The payload of a document's record."""
    return _META.pack(doc, n) + ids


def unpack_document(payload: bytes, kind: np.dtype) -> tuple[int, np.ndarray]:
    """Document id and ids of a payload."""
    doc, n = _META.unpack_from(payload)
    return doc, np.frombuffer(payload, kind, n, _META.size)


class Encoder:
    """A byte-level BPE tokenizer that encodes each distinct piece of text once.

    Pieces are cut at single spaces between other characters: the tokenizer's own
    pre-tokenization always separates there and puts the space in front of the next
    word, so ids of pieces concatenate to ids of the text.  A block of texts is
    split and its distinct pieces are found by Arrow; unknown ones are
    encoded a few dozen to a string and told apart by the tokens that begin with a
    space, and the ids of all texts are gathered from the pieces' in one step.
    Texts where a space stands beside other white space, or that hold a
    special token, are encoded whole.  Known pieces are kept up to ``cache_bytes``;
    beyond it only those stay that several blocks asked for.
    """

    def __init__(self, path: str, cache_bytes: int = 20 << 20, joined: int = 100):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism; a pool in each worker only takes memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.dtype("<u2") if len(vocabulary) <= 1 << 16 else np.dtype("<u4")
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.begins[i] = token.startswith("\u0120")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache_bytes, self.joined = cache_bytes, joined
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())  # a piece that begins a text is kept with a space in front; no other piece holds one
        self.start, self.length, self.asked = (np.empty(0, np.int32) for _ in range(3))
        self.arena = np.empty(0, self.width)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.width) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str], spaced: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of the pieces, and how many of them each piece has."""
        if not spaced:
            ids = self._encode(pieces)
            return ids, [np.array([len(x) for x in ids], np.int64)]
        groups = [pieces[i : i + self.joined] for i in range(0, len(pieces), self.joined)]
        ids, lengths = self._encode([" " + " ".join(g) for g in groups]), []
        for k, group in enumerate(groups):
            cuts = np.flatnonzero(self.begins[ids[k]])
            if len(cuts) != len(group):
                alone = self._encode([" " + p for p in group])
                ids[k], length = np.concatenate(alone), np.array([len(x) for x in alone], np.int64)
            else:
                length = np.diff(cuts, append=len(ids[k]))
            lengths.append(length)
        return ids, lengths

    def _numbers(self, pieces: pa.Array, spaced: bool) -> np.ndarray:
        """Numbers of distinct pieces; unknown ones are encoded and kept."""
        keys = pieces if spaced else pc.binary_join_element_wise(pa.scalar("", pa.large_string()), pieces, pa.scalar(" ", pa.large_string()))
        numbers = pc.index_in(keys, value_set=self.known).fill_null(-1).to_numpy().copy()
        new = np.flatnonzero(numbers < 0)
        if len(new):
            ids, lengths = self._encode_pieces(pieces.take(pa.array(new)).to_pylist(), spaced)
            length = np.concatenate(lengths).astype(np.int32)
            at = len(self.start)
            self.start = np.concatenate([self.start, (len(self.arena) + np.cumsum(length) - length).astype(np.int32)])
            self.length = np.concatenate([self.length, length])
            self.asked = np.concatenate([self.asked, np.zeros(len(length), np.int32)])
            self.arena = np.concatenate([self.arena, *ids])
            numbers[new] = np.arange(at, at + len(new))
            self.known = pa.concat_arrays([self.known, keys.take(pa.array(new))])
        self.asked[numbers] += 1
        return numbers

    def _gather(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of pieces one after another."""
        length = self.length[numbers]
        ends = np.cumsum(length, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        return self.arena[np.repeat(self.start[numbers] - (ends - length), length) + np.arange(total)]

    def _trim(self) -> None:
        """Once the cache is full keep the pieces that several blocks asked for, most asked first, in half the room."""
        cost = pc.binary_length(self.known).to_numpy() + self.length * self.width.itemsize + 20
        if cost.sum() <= self.cache_bytes:
            return
        order = np.argsort(-self.asked, kind="stable")
        order = order[(self.asked[order] > 1) & (cost[order] <= 256)]
        keep = np.sort(order[np.cumsum(cost[order]) <= self.cache_bytes // 2])
        self.arena = self._gather(keep)
        self.known, self.length, self.asked = self.known.take(pa.array(keep)), self.length[keep], self.asked[keep] // 2
        self.start = (np.cumsum(self.length) - self.length).astype(np.int32)

    def encode(self, texts: pa.Array | list[bytes]) -> list[np.ndarray]:
        """Ids of each text; null counts as empty, bytes that are not UTF-8 become replacement characters."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.binary())
        try:
            texts = texts.fill_null(b"").cast(pa.large_string())
        except pa.ArrowInvalid:
            texts = pa.array([(t or b"").decode("utf-8", "replace") for t in texts.to_pylist()], pa.large_string())
        if not len(texts):
            return []
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        coded = lists.flatten().dictionary_encode()
        where, pieces = coded.indices.to_numpy(), coded.dictionary
        # a piece that is empty, begins or ends with white space stands beside a space
        odd = pc.or_(pc.equal(pieces, ""), pc.not_equal(pc.utf8_trim_whitespace(pieces), pieces))
        whole = pa.array(np.zeros(len(texts), bool))
        for s in self.special:
            if " " in s:
                whole = pc.or_(whole, pc.match_substring(texts, s))
            else:
                odd = pc.or_(odd, pc.match_substring(pieces, s))
        odd = odd.to_numpy(zero_copy_only=False)[where]
        odd[offsets[:-1]] &= np.diff(offsets) > 1
        whole = whole.to_numpy(zero_copy_only=False) | (np.add.reduceat(odd, offsets[:-1], dtype=np.int64) > 0)
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offsets))
        head = np.zeros(len(where), bool)
        head[offsets[:-1]] = True
        used = ~whole[owner]
        number = np.zeros(len(where), np.int32)
        for spaced in (False, True):
            part = used & (head != spaced)
            at = where[part]
            asked = np.zeros(len(pieces), bool)
            asked[at] = True
            own = np.flatnonzero(asked)
            found = np.zeros(len(pieces), np.int32)
            found[own] = self._numbers(pieces.take(pa.array(own)), spaced)
            number[part] = found[at]
        number = number[used]
        ends = np.cumsum(np.bincount(owner[used], self.length[number], len(texts)).astype(np.int64))
        flat = self._gather(number)
        out = [flat[i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        alone = np.flatnonzero(whole)
        for i, ids in zip(alone.tolist(), self._encode(texts.take(pa.array(alone)).to_pylist()), strict=True):
            out[i] = ids
        self._trim()
        return out


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_records(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, file_bytes: int = 64 << 20) -> DataFrame:
    """Encode every text and write records in ascending id order below ``path``; returns the manifest.

    ``path`` is a URI of a folder that all executors reach.  A task writes files of
    about ``file_bytes`` under names of its own and reports them only when it ends, so
    files of a failed attempt are never listed.  The manifest has a row per file:
    ``part`` and ``piece`` order the files, ``file`` names them, ``docs`` and ``tokens`` count.

    A null text counts as empty, rows with a null id come first and are
    recorded under the least 64-bit integer, repeated ids stand side by side in the
    order of their texts' hashes, and rows that agree in both are interchangeable, so
    they are cut into several ranges if there are many; an empty table gives no files.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), utf8(F.col(text_col)).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t")).withColumn("copy", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange("id", "h", "copy").sortWithinPartitions("id", "h", "copy").select("id", "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), _encoder(tokenizer)
        store, root = fs.FileSystem.from_uri(path)
        done, sink, offsets, count, at = [], None, [], 0, 0
        end = b"" if end_id is None else np.array([end_id], encoder.width).tobytes()

        def close() -> None:
            offsets.append(at)
            sink.close()
            with store.open_output_stream(f"{root}/{name}.idx") as f:
                f.write(np.array(offsets, "<i8").tobytes())
            done.append((part, len(done), name, len(offsets) - 1, count))

        for batch in (b for whole in batches for b in slices(whole, _BLOCK_BYTES, 4000)):
            for doc, got in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                if sink is None:
                    name = f"part-{part:06d}-{len(done):04d}-{uuid.uuid4().hex}"
                    store.create_dir(root, recursive=True)
                    sink, offsets, count, at = store.open_output_stream(f"{root}/{name}.rec"), [], 0, 0
                payload = got.tobytes() + end
                n = len(payload) // encoder.width.itemsize
                record = frame(pack_document(doc, payload, n))
                offsets.append(at)
                sink.write(record)
                at += len(record)
                count += n
                if at >= file_bytes:
                    close()
                    sink = None
        if sink is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))],
            names=["part", "piece", "file", "docs", "tokens"],
        )

    return materialize(map_arrow(ordered, write, "part int, piece int, file string, docs long, tokens long"), "manifest")


def read_records(spark: SparkSession, path: str, manifest: DataFrame, id_bytes: int = 2, then: Callable | None = None, schema: str = "part int, piece int, seq long, doc_id long, ids binary") -> DataFrame:
    """(part, piece, seq, doc_id, ids) of every record, where ``ids`` packs 32-bit integers; checks all checksums.

    The index gives the offsets; the file is read record by record, so a task
    holds one record and a read-ahead buffer.  ``then`` maps each file's number of ids before it (the
    manifest's ``base``, 0 without it) and its batches to batches of ``schema`` in the same task.
    """
    if "base" not in manifest.columns:
        manifest = manifest.withColumn("base", F.lit(0).cast("long"))

    def read(part: int, piece: int, name: str) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        kind = np.dtype(f"<u{id_bytes}")
        with store.open_input_stream(f"{root}/{name}.idx") as f:
            offsets = np.frombuffer(f.read(), "<i8")
        with store.open_input_stream(f"{root}/{name}.rec", buffer_size=1 << 20) as f:
            for first in range(0, len(offsets) - 1, 512):
                last = min(first + 512, len(offsets) - 1)
                docs, ids = [], []
                for k in range(first, last):
                    payload, _ = unframe(f.read(int(offsets[k + 1] - offsets[k])), 0)
                    doc, got = unpack_document(payload, kind)
                    docs.append(doc)
                    ids.append(got.astype("<u4").tobytes())
                seq = pa.array(range(first, last), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(docs), pa.int32()), pa.array([piece] * len(docs), pa.int32()), seq, pa.array(docs, pa.int64()), pa.array(ids, pa.binary())], names=["part", "piece", "seq", "doc_id", "ids"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, piece, name, base in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                records = read(part, piece, name)
                yield from records if then is None else then(base, records)

    files = max(1, manifest.count())
    listed = manifest.select("part", "piece", "file", "base").repartition(files, "part", "piece")
    return map_arrow(listed, each, schema)


def fetch_record(path: str, name: str, k: int) -> bytes:
    """The payload of the k-th record of a file, by its index."""
    store, root = fs.FileSystem.from_uri(path)
    with store.open_input_file(f"{root}/{name}.idx") as f:
        start, end = np.frombuffer(f.read_at(16, 8 * k), "<i8")
    with store.open_input_file(f"{root}/{name}.rec") as f:
        return unframe(f.read_at(int(end - start), int(start)), 0)[0]


def record_report(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write the records, read them back and describe each document.

    Returns ``doc_id``, ``start`` (ids of all documents before it in file order),
    ``n_tokens`` and ``ids_crc32`` (of the ids as 32-bit little-endian integers).
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "records")
    manifest = write_records(docs, path, tokenizer, id_col, text_col, end_id)

    def digest(base: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(4).to_pylist()
            lengths = np.array([len(x) // 4 for x in ids], np.int64)
            checks = [zlib.crc32(x) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(base + np.cumsum(lengths) - lengths), pa.array(lengths), pa.array(checks, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
            base += int(lengths.sum())

    from tokenizers import Tokenizer

    id_bytes = 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else 4
    numbered = manifest.withColumn("at", F.col("part").cast("long") * (1 << 20) + F.col("piece"))
    based = materialize(prefix_sums(numbered, [], "at", "tokens", chunk=1 << 24).select("part", "piece", "file", "base"), "manifest-base")
    read = read_records(spark, path, based, id_bytes, digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
    doc = F.when(F.col("doc_id") != F.lit(-(1 << 63)), F.col("doc_id"))
    return read.select(doc.alias(id_col), "start", "n_tokens", "ids_crc32")
