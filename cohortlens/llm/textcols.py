"""Vectorised text helpers that run inside Spark tasks.

They read the bytes of an Arrow string column in place (one buffer and its
offsets), so word boundaries, word hashes and rolling hashes of a few megabytes
of documents take a handful of numpy passes and no per-word Python objects.
Work is cut into chunks of whole documents of about ``CHUNK`` bytes, which bounds
a worker's memory by the chunk or by the longest single document.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
ODD = np.uint64(0x9E3779B97F4A7C1B)
U = np.uint64

SPACE_WORDS = np.ones(256, np.uint8)
SPACE_WORDS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0

#: A-Z to a-z, every other byte as it is
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_SEEDS = np.random.default_rng(20240613).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD**i and ODD**-i (mod 2**64) for i <= n; kept between chunks of ordinary size."""
    have = _POWERS.get("p")
    if have is None or len(have) <= n:
        size = max(n + 1, CHUNK + CHUNK // 2)
        p = np.full(size, ODD, np.uint64)
        p[0] = 1
        q = np.full(size, U(pow(int(ODD), -1, 1 << 64)), np.uint64)
        q[0] = 1
        p, q = np.cumprod(p), np.cumprod(q)
        if size > 4 * CHUNK:
            return p, q
        _POWERS["p"], _POWERS["q"] = p, q
    return _POWERS["p"], _POWERS["q"]


def string_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is_null) of an Arrow string column; a null is an empty text."""
    nulls = np.asarray(col.is_null())
    arr = col.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset: arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    return data[first: int(offsets[-1])] if len(offsets) else data, offsets - first, nulls


class Chunk:
    """Some whole documents: row ids, their bytes one after the other, and where each begins."""

    __slots__ = ("cols", "data", "nulls", "off")

    def __init__(self, cols: list[pa.Array], data: np.ndarray, off: np.ndarray, nulls: np.ndarray):
        self.cols, self.data, self.off, self.nulls = cols, data, off, nulls

    def __len__(self) -> int:
        return len(self.off) - 1

    def bounds(self, i: int) -> tuple[int, int]:
        return int(self.off[i]), int(self.off[i + 1])


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK) -> Iterator[Chunk]:
    """Cut record batches into chunks of whole documents; the other columns follow in ``cols``."""
    for b in batches:
        if not b.num_rows:
            continue
        at = b.schema.get_field_index(text)
        data, off, nulls = string_parts(b.column(at))
        others = [b.column(i) for i in range(b.num_columns) if i != at]
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
            a, z = int(off[lo]), int(off[hi])
            yield Chunk([c.slice(lo, hi - lo) for c in others], data[a:z], off[lo: hi + 1] - a, nulls[lo:hi])
            lo = hi
    give_back()


def word_spans(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each document) of the maximal runs of bytes that ``table`` marks."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = table[data]
    before = np.empty(n, np.uint8)
    before[0] = 0
    before[1:] = inside[:-1]
    cut = off[1:-1]
    before[cut[cut < n]] = 0
    start = np.flatnonzero(inside & (before ^ 1))
    after = np.empty(n, np.uint8)
    after[-1] = 0
    after[:-1] = inside[1:]
    after[cut[cut > 0] - 1] = 0
    end = np.flatnonzero(inside & (after ^ 1)) + 1
    return start, end, np.searchsorted(start, off)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes have equal hashes wherever they stand."""
    if not len(start):
        return np.zeros(0, np.uint64)
    p, q = powers(len(data))
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SEEDS[data] * p[: len(data)], out=run[1:])
    return mix((run[end] - run[start]) * q[start] + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """The distinct hashes of k successive words of each document, ascending; fewer words make one shingle."""
    n = max(0, len(words) - k + 1)
    run = mix(words[:n])
    for j in range(1, k):
        run = mix(run * ODD + words[j: n + j])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(run[a: b - k + 1]))
        elif b > a:
            h = mix(words[a: a + 1] + U(b - a))
            for j in range(a + 1, b):
                h = mix(h * ODD + words[j: j + 1])
            out.append(h)
        else:
            out.append(words[:0])
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
