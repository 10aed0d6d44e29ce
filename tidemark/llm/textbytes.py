"""Byte-level text handling over Arrow batches, vectorised with numpy.

Every helper works on one joined UTF-8 buffer in which each row is followed by a line feed, so a word
never runs over from one row to the next. Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that the contract's `[^\x20\x09-\x0D]+` leaves out of words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD = ~SPACE

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(v: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    v = v ^ (v >> np.uint64(33))
    v = v * np.uint64(0xFF51AFD7ED558CCD)
    v ^= v >> np.uint64(33)
    v *= np.uint64(0xC4CEB9FE1A85EC53)
    v ^= v >> np.uint64(33)
    return v


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        steps = np.full(size, base & _MASK, dtype=np.uint64)
        steps[0] = 1
        have = _powers[key] = np.multiply.accumulate(steps)
    return have[:n]


def joined(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes, each followed by a line feed, and the n + 1 row offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    texts = pc.binary_join_element_wise(texts, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def runs(texts: pa.Array | pa.ChunkedArray, max_bytes: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, buffer, offsets) for consecutive rows of about max_bytes; a longer row comes alone."""
    if len(texts) == 0:
        return
    buf, at = joined(texts)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(at, at[first] + max_bytes, side="right")) - 1)
        yield first, end, buf[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


#: ASCII letters and digits, and every byte beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def lower_latin(buf: np.ndarray) -> np.ndarray:
    """A-Z and the accented capitals of Latin-1 lower-cased."""
    out = _LOWER[buf]
    accent = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
    out[accent] += 32
    return out


def spans(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of `inside` bytes, and for each row the index of its first run (n + 1 values)."""
    held = np.zeros(len(buf) + 2, dtype=np.int8)
    held[1:-1] = inside[buf]
    edge = np.diff(held)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return starts, ends, np.searchsorted(starts, offsets)


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, from one running sum over the buffer."""
    n = len(buf)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[buf] * _power(_BASE, n), out=total[1:])
    value = (total[ends] - total[starts]) * _power(_INVERSE, n + 1)[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """arange(starts[i], starts[i] + lengths[i]) for all i, one after another."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) if total else np.zeros(0, np.int64)
    return np.arange(total, dtype=np.int64) + shift


def span_bytes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans' bytes one after another, and their offsets."""
    lengths = ends - starts
    return buf[ranges(starts, lengths)], np.concatenate(([0], np.cumsum(lengths)))


def _release() -> None:
    """Give freed memory back to the system, as a worker process outlives its task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with the worker's freed memory given back at the end of a task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _release()

    return wrapped


def splits_by(texts: pa.Array, max_rows: int) -> Iterator[tuple[int, int]]:
    for first in range(0, len(texts), max_rows):
        yield first, min(len(texts), first + max_rows)
