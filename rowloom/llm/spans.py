"""Words, lines and rolling hashes of many texts at once, on the bytes of an Arrow column.

All functions work on one flat byte array with the bounds of its documents, so
that a batch of texts costs a few passes over arrays and no loop per word.
Hashes are polynomials modulo 2**64 over an odd base, read off prefix sums, and
mixed at the end. Equal content always has equal hashes; unequal content
collides with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of text worked on at once inside a task
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93


def _is(codes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(codes)] = True
    return t


#: what separates words: blank, tab, line feed, vertical tab, form feed, carriage return
SPACE = _is([0x20, *range(0x09, 0x0E)])
NEWLINE = _is([0x0A])


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``limit`` bytes of ``column``, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, start = np.cumsum(size), 0
    while start < len(size):
        base = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the bounds of each; a null text has no bytes."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of marked bytes within documents: starts, ends, and each document's bounds in them."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cut = bounds[(bounds > 0) & (bounds < len(inside))]
    opens[cut] |= inside[cut]
    closes[cut - 1] |= inside[cut - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all documents as ``runs`` gives them."""
    return runs(~SPACE[data], bounds)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i up to ``n``."""
    got = _powers.get(base)
    if got is None or len(got[0]) <= n:
        size = max(1 << 16, 2 * n)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        got = (made[0], made[1])
        if size <= 1 << 23:
            _powers[base] = got
    return got


def salt(n: int) -> np.uint64:
    """A 64-bit constant for the ``n``-th of several hashes of one value."""
    return np.uint64((n * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of a 64-bit hash."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """The hash of ``values[start:end]`` for every span, independent of where it lies."""
    p, inverse = _power(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * p[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def window_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of ``k`` words, by its first word; runs may cross documents."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return span_hashes(word_hashes, at, at + k, _WORD_BASE)


def owner(bounds: np.ndarray) -> np.ndarray:
    """For each element its document, from the documents' bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def window_starts(word_bounds: np.ndarray, k: int) -> np.ndarray:
    """Positions where a run of ``k`` words of one document starts."""
    total = int(word_bounds[-1])
    ok = np.zeros(total, dtype=bool)
    if total >= k:
        left = np.repeat(word_bounds[1:], np.diff(word_bounds)) - np.arange(total)
        ok = left >= k
    return np.flatnonzero(ok)


def per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` per document."""
    sums = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in a run of ``k`` from one of ``starts``."""
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + k, n), -1)
    return np.cumsum(edge[:n]) > 0


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as a Spark long."""
    return h.view(np.int64)


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the bounds of each row."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32), pa.int32()), pa.array(values, kind))
