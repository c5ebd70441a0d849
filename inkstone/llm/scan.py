"""Vectorised word scanning over Arrow string columns, for use inside `mapInArrow` tasks.

Texts are read as UTF-8 bytes, a bounded chunk of documents at a time, so memory does not depend on the size of a
partition; one document longer than a chunk is a chunk of its own. What a function makes of the rows that Spark sends at once
goes out in slices, so it doesn't depend on their number either. At the end of a task its worker, which stays for others, gives
the memory back that it doesn't hold any more.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
SLICE_BYTES = 1 << 22

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of `[^\x20\x09-\x0D]+`.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: digits, small letters and whatever is not ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_BASE = U(0x9E3779B97F4A7C15)
_BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(0, np.uint64), np.ones(0, np.uint64))


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h + U((int(seed) * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & (2**64 - 1))
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1]
    size = max(n, CHUNK_BYTES + 1)
    up, down = np.full(size, _BASE, np.uint64), np.full(size, _BASE_INVERSE, np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up, out=up), np.cumprod(down, out=down)
    if size == CHUNK_BYTES + 1:  # those of a longer document aren't kept
        _powers = up, down
    return up[:n], down


@dataclass
class Words:
    """Words of a chunk in order: their hashes, the document (row of the chunk) of each, bytes from `start` to `end`."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    n_docs: int

    def bounds(self) -> np.ndarray:
        """The words of document d are those from bounds()[d] to bounds()[d + 1]."""
        return np.searchsorted(self.doc, np.arange(self.n_docs + 1))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in bytes) of consecutive rows; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    if not len(texts):
        return
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, in batches of at most `limit` bytes of text, or of one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, side="right")))
            yield batch.slice(a, b - a)
            a = b


@cache
def _trim() -> Callable[[int], int]:
    """The C library's `malloc_trim`, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0) if sys.platform == "linux" else lambda _: 0


def release() -> None:
    """Gives freed memory back to the system, which allocators else keep for this process, idle or not."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def tidy(make: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """The generator function `make`, with `release` at its end."""

    @wraps(make)
    def out(*args):
        yield from make(*args)
        release()

    return out


def scan(data: np.ndarray, offsets: np.ndarray, member: np.ndarray, lower: bool = True) -> Words:
    """The words, runs of bytes in `member`, of documents that lie at `offsets` in `data`; A-Z count as a-z if `lower`.

    More than a chunk is scanned part by part."""
    if len(data) > CHUNK_BYTES and len(offsets) > 2:
        parts, a = [], 0
        while a < len(offsets) - 1:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK_BYTES, side="right")) - 1)
            w = scan(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], member, lower)
            parts.append((w.hash, w.doc + a, w.start + offsets[a], w.end + offsets[a]))
            a = b
        return Words(*(np.concatenate(x) for x in zip(*parts, strict=True)), len(offsets) - 1)
    n = len(data)
    if lower:
        data = LOWER[data]
    inside = member[data]
    opens, closes = np.ones(n, bool), np.ones(n, bool)
    np.logical_not(inside[:-1], out=opens[1:])
    np.logical_not(inside[1:], out=closes[:-1])
    edges = offsets[(offsets > 0) & (offsets < n)]
    opens[edges] = True
    closes[edges - 1] = True
    start, end = np.flatnonzero(inside & opens), np.flatnonzero(inside & closes) + 1
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=total[1:])
    h = (total[end] - total[start]) * down[start] if len(start) else np.zeros(0, np.uint64)
    h = mix(h + (end - start).astype(np.uint64))
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Words(h, doc, start, end, len(offsets) - 1)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n consecutive hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = mix(h[: len(h) - n + 1], n)
    for k in range(1, n):
        out = mix(out * U(3) + h[k : len(h) - n + 1 + k], k)
    return out


def shingle_sets(w: Words, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-word shingles of each document; the whole sequence is the one shingle of a shorter one."""
    grams, bounds = windows(w.hash, n), w.bounds()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        else:
            yield windows(w.hash[a:b], b - a) if b > a else grams[:0]
