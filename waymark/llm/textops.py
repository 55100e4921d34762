"""Vectorised text primitives that run inside Arrow-fed Python workers.

A *word* is a maximal run of bytes other than the six ASCII white space
characters (space, tab, line feed, vertical tab, form feed, carriage return);
``bytes.split()`` cuts at exactly these.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection on 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the odd hash base and of its inverse modulo 2**64."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        made = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers = (made[0], made[1])
    return _powers


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes the empty text."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts holding about ``limit`` bytes; a longer text stands alone."""
    first = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > limit:
            yield first, i
            first, total = i, 0
        total += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and the bounds of each text's words (n+1 long).

    A word's hash is a polynomial over its bytes, taken as a difference of prefix
    sums, so that no word is ever handled by itself.
    """
    flat = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    if lower:
        flat = _LOWER[flat]
    inside = np.concatenate(([False], ~_SPACE[flat]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    base, inverse = powers(len(flat) + 1)
    sums = np.zeros(len(flat) + 1, dtype=np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * base[: len(flat)], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * inverse[starts])
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
    return words, bounds


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles in order, and their bounds.

    A text of 1 to k-1 words has one shingle, the whole sequence; one without words none.
    """
    counts = np.diff(bounds)
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out = np.concatenate(([0], np.cumsum(sizes)))
    total = np.zeros(max(len(words) - k + 1, 0), dtype=np.uint64)
    for j in range(k):
        total += words[j : len(words) - k + 1 + j] * np.uint64(_step(j))
    owner = np.repeat(np.arange(len(counts)), sizes)
    at = bounds[:-1][owner] + (np.arange(out[-1]) - out[:-1][owner])
    whole = counts[owner] >= k
    hashes = np.empty(out[-1], dtype=np.uint64)
    hashes[whole] = total[at[whole]]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        part = words[bounds[i] : bounds[i + 1]]
        steps = np.array([_step(j) for j in range(len(part))], dtype=np.uint64)
        hashes[out[i]] = (part * steps).sum(dtype=np.uint64) + np.uint64(len(part))
    return mix(hashes), out


def _step(j: int) -> int:
    return pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)


def word_count(text: bytes) -> int:
    return len(text.split())


class _Slot:
    key: object = None
    value: object = None


def cached(key: object, make: Callable[[], object]) -> object:
    """What ``make`` returns, made once in a worker until another key is asked for.

    One thing is kept at a time, whatever operators a worker serves one after another.
    """
    if _Slot.key != key:
        release()
        _Slot.value, _Slot.key = make(), key
    return _Slot.value


def release() -> None:
    """Let go of what an operator before has cached in this worker."""
    _Slot.key = _Slot.value = None
    trim()


def trim() -> None:
    """Give memory back to the system: a worker lives on after its task, beside others."""
    global _powers
    _powers = None
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # of the GNU C library alone
        ctypes.CDLL(None).malloc_trim(0)


def batch(columns: dict[str, Iterable], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
