"""Helpers for operators that read whole texts in Arrow batches."""

from __future__ import annotations

import ctypes
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that an operator works on at once; a longer text makes a block of its own.
BLOCK_BYTES = 4 << 20
#: Words remembered per Python worker.
CACHE_WORDS = 200_000

U64 = np.uint64
_MULTIPLIER = U64(0x9E3779B97F4A7C15)
_FINAL = U64(0xD6E8FEB86659FD93)


def runs(*kinds: str) -> str:
    """Pattern of runs of the code points whose general category starts with one of `kinds` (L, M, N)."""
    found, first = [], None
    for point in (*range(0x10000), sys.maxunicode, *range(0x10000, 0x32400), *range(0xE0000, 0xE0200), sys.maxunicode):  # beyond and between, none is of L, M or N
        if unicodedata.category(chr(point))[0] in kinds:
            first = point if first is None else first
            last = point
        elif first is not None:
            found.append((first, last))
            first = None
    low, high = ("".join(f"\\U{s:08x}-\\U{e:08x}" for s, e in found if (s > 0xFFFF) == far) for far in (False, True))
    return rf"(?:[{low}]++|(?=[\U00010000-\U0010ffff])[{high}])++"  # a class of the lower plane alone is a table


def fold(text: str) -> str:
    """One form of texts that differ in case or in how a character is written (NFKC_Casefold)."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())


def give_back() -> None:
    """Return freed memory to the system. A Python worker serves one step after the other and otherwise keeps its peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def text_blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES):
    """Slices of the batches with their texts as UTF-8 bytes (None for null), `limit` bytes each."""
    give_back()
    for batch in batches:
        column = batch.column(text).cast(pa.binary())
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start), column.slice(start, stop - start).to_pylist()
            start = stop
    give_back()


class WordHashes(dict):
    """64-bit hash of each word; forgets all of them when it holds CACHE_WORDS."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def token_hashes(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), U64, len(words))


def mixed(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit mix: another seed gives another order of the same values."""
    h = (values ^ U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)) * _FINAL
    h ^= h >> U64(32)
    h *= _FINAL
    h ^= h >> U64(29)
    return h


def gram_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n tokens that begin at each place; empty if there are fewer."""
    count = len(tokens) - n + 1
    if count <= 0:
        return np.empty(0, U64)
    h = np.zeros(count, U64)
    for k in range(n):
        h = (h ^ tokens[k:k + count]) * _MULTIPLIER
        h ^= h >> U64(31)
    return h
