"""Texts of an Arrow batch as one byte buffer, with words and hashes found by numpy.

Spark hands batches of rows to a task; the functions here look at all texts of a
slice at once. Every class of characters used is ASCII, so bytes of UTF-8 stand for
code points: a byte from 0x80 on is part of a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
"""Bytes of text looked at together; a longer text is a slice of its own."""

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE

WORD = np.zeros(256, bool)
for _low, _high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    WORD[_low : _high + 1] = True

_BASE = 0x9E3779B97F4A7C15
_BYTE_VALUES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets of the texts; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32) if ends else np.zeros(1)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    all_bytes = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return all_bytes[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text each."""
    for batch in batches:
        _, offsets = texts_of(batch.column(column))
        first, n = 0, batch.num_rows
        while first < n:
            last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
            last = min(max(last, first + 1), n)
            yield batch.slice(first, last - first)
            first = last


def words_of(
    data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of word bytes inside a text, and the
    n + 1 word numbers at which the texts begin."""
    inside = is_word[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    before[filled] = False
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    after[last] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(values: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits, one to one."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same wherever they stand."""
    n = len(data)
    if len(_powers.get("up", ())) < n + 1:
        size = max(n + 1, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            powers = np.full(size, base, np.uint64)
            powers[0] = 1
            _powers[name] = np.cumprod(powers, dtype=np.uint64)
    up, down = _powers["up"], _powers["down"]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[:n], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    if n > 4 * SLICE_BYTES:
        _powers.clear()  # kept for usual slices only
    return mix(hashes + (ends - starts).astype(np.uint64))


def sums_per_text(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Sum of the values between each two neighbours of ``borders``."""
    running = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=running[1:])
    return running[borders[1:]] - running[borders[:-1]]
