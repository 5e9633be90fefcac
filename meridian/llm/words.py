"""Vectorised word scanning over Arrow string columns.

Texts are handled as one UTF-8 buffer with row offsets. Words are maximal runs
of bytes that a byte table marks as word bytes; every word gets a 64-bit hash
(a polynomial over its bytes modulo 2**64, finalised by a bit mixer). Scanning
works in bounded pieces, so the temporary arrays do not grow with a text.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18  # bytes scanned at a time
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd, so that they have inverses; two bases give independent hashes


def byte_table(separators: bytes) -> np.ndarray:
    """A 256-entry table that is true for word bytes."""
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: Words as runs of anything but space, tab, line feed, vertical tab, form feed, carriage return.
SPACED = byte_table(b" \t\n\v\f\r")
#: Words as runs of ASCII letters, ASCII digits and anything outside ASCII.
ALNUM = byte_table(bytes(c for c in range(128) if not chr(c).isalnum()))
IDENTITY = np.arange(256, dtype=np.uint8)
#: A-Z become a-z; other bytes stay.
LOWER = IDENTITY.copy()
LOWER[65:91] += 32


class Words(NamedTuple):
    """Words of several texts: byte starts and ends, hashes, and each text's first word."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that close inputs give unrelated outputs."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of a hash base and of its inverse, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            up, down = np.full(n, self.base), np.full(n, self.inverse)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up[:n], self.down[:n]


_POWERS = [_Powers(b) for b in BASES]


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _pieces(data: np.ndarray, word: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about PIECE bytes that end at a text's end or at a separator."""
    a, n = 0, len(data)
    while a < n:
        b = a + PIECE
        if b >= n:
            yield a, n
            return
        k = int(cuts[np.searchsorted(cuts, b, "right") - 1])
        if k > a:
            b = k
        else:
            gaps = np.flatnonzero(~word[data[a:b]])
            if len(gaps):
                b = a + int(gaps[-1]) + 1
            else:  # a word longer than a piece: go on to its end
                end = int(cuts[np.searchsorted(cuts, a, "right")])
                while b < end and word[data[b]]:
                    b = min(end, b + 1)
        yield a, b
        a = b


def scan(data: np.ndarray, offsets: np.ndarray, word: np.ndarray = SPACED, fold: np.ndarray | None = None, both: bool = False) -> Words:
    """All words of the texts that ``offsets`` cuts ``data`` into, hashed after ``fold``; with ``both``, hashes by either base stand in two columns."""
    starts, ends, hashes = [], [], []
    for a, b in _pieces(data, word, offsets):
        raw = data[a:b]
        inside = word[raw]
        cut = offsets[np.searchsorted(offsets, a, "left") : np.searchsorted(offsets, b, "right")] - a
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        inner = cut[(cut >= 0) & (cut < b - a)]
        first[inner] |= inside[inner]
        inner = cut[(cut > 0) & (cut <= b - a)] - 1
        last[inner] |= inside[inner]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        value = (raw if fold is None else fold[raw]).astype(np.uint64)
        value += np.uint64(1)
        found = []
        for powers in _POWERS if both else _POWERS[:1]:
            up, down = powers.upto(b - a + 1)
            total = np.zeros(b - a + 1, np.uint64)
            np.cumsum(value * up[: b - a], out=total[1:])
            h = (total[e] - total[s]) * down[s]
            h += (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            found.append(mix(h))
        starts.append(s + a)
        ends.append(e + a)
        hashes.append(np.stack(found, 1) if both else found[0])
    if not starts:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros((0, 2) if both else 0, np.uint64), np.zeros(len(offsets), np.int64))
    s = np.concatenate(starts)
    return Words(s, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(s, offsets, "left"))


def hash_word(word: bytes) -> int:
    """The hash that ``scan`` gives to one word."""
    data = np.frombuffer(word, np.uint8)
    return int(scan(data, np.array([0, len(data)]), np.ones(256, bool)).hashes[0])


def rolling(hashes: np.ndarray, k: int, base: int = 0) -> np.ndarray:
    """Rabin-Karp hashes of all runs of k words; runs over text ends are included and must be masked."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _POWERS[base].upto(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[:n])


def whole_runs(first: np.ndarray, k: int, n_words: int) -> np.ndarray:
    """True for each run of k words, by its first word, that lies in one text."""
    n = n_words - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(n, bool)
    for d in range(len(first) - 1):
        a, b = max(0, int(first[d + 1]) - k + 1), int(first[d + 1])
        ok[max(a, int(first[d])) : min(b, n)] = False
    return ok


def give_back() -> None:
    """Return freed memory to the system: workers live on after a task, beside an executor with memory needs of its own."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def by_size(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold at most ``limit`` bytes; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
        total, a = np.concatenate([[0], np.cumsum(sizes)]), 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(total, total[a] + limit, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b
    give_back()
