"""Words, as every operator of this subpackage counts them.

A word is a run of characters other than space and the five ASCII controls from
tab to carriage return.  On UTF-8 bytes that is exactly what ``bytes.split()``
splits at, and ``bytes.lower()`` changes only A-Z, so no text is decoded here.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def utf8(text: Column) -> Column:
    """The text's bytes; null becomes empty."""
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def word_count(text: Column) -> Column:
    """Number of words, native; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word, the same in every process."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def finalize(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles.

    With fewer than ``width`` words the whole sequence is one shingle; without
    words the result is empty.  Two different shingles of one corpus share a
    hash with a probability of about pairs / 2**64.
    """
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    with np.errstate(over="ignore"):
        k = min(width, n)
        out = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            out = out * _MIX + h[i : n - k + 1 + i]
        return np.unique(finalize(out))
