"""Vectorised byte kernels over Arrow string columns.

Arrow keeps a string column as one contiguous UTF-8 buffer with an offset per
row, so per-byte work (word hashing, rolling hashes, class counts) runs as a few
numpy passes over a whole batch instead of a Python loop over rows. A null text
is treated as an empty one; callers that must tell them apart look at validity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass works on. Bounds a worker's memory at about
#: 30 times this, whatever the batch; a longer row forms a slice of its own.
SLICE_BYTES = 1 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_RADIX = (0x100000001B3, 0xD6E8FEB86659FD93)  # odd, so that their powers are invertible modulo 2**64

#: ASCII letters in lower case, digits, and every byte of a multi-byte character
#: make words; all other bytes separate them.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise hashes so that every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


#: What a byte counts in either polynomial.
_VALUES = (np.arange(1, 257, dtype=np.uint64), mix64(np.arange(1, 257, dtype=np.uint64) * _MIX2))


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row, with the end last."""
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        width, column = np.int32, column.cast(pa.string())
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(starts) == 0:
        starts = np.zeros(1, np.int64)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def slices(starts: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [first, last) of at most ``limit`` bytes, or of a single row."""
    first, n = 0, len(starts) - 1
    while first < n:
        last = int(np.searchsorted(starts, starts[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_spans(raw: np.ndarray, starts: np.ndarray, member: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; a word never crosses a row's end."""
    inside = np.empty(len(raw) + 1, dtype=bool)
    inside[:-1] = member[raw]
    inside[-1] = False
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = starts[:-1][starts[:-1] < len(raw)]
    begins[edge] = inside[edge]
    ends = np.zeros(len(raw) + 1, dtype=bool)
    ends[1:] = inside[:-1] & ~inside[1:]
    edge = starts[1:][starts[1:] > 0]
    ends[edge] |= inside[edge - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    return first, last, np.searchsorted(starts, first, side="right") - 1


def span_hasher(raw: np.ndarray, which: int = 0) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of (first, last): 64-bit hashes of the spans raw[first:last], from prefix sums of a polynomial.

    Equal spans have equal hashes wherever they stand; the powers that a span's
    position brings in are divided out again. ``which`` picks one of two
    independent polynomials, which together make 128 bits.
    """
    n = len(raw)
    powers, inverse = _powers(n + 1, which)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUES[which][raw] * powers[:n], out=sums[1:])

    def hashes(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mix64((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64) * _MULT)

    return hashes


def span_hashes(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hashes of ``span_hasher`` for one set of spans."""
    return span_hasher(raw)(first, last) if len(first) else np.zeros(0, np.uint64)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    if which in _tables and n <= len(_tables[which][0]):
        return _tables[which]
    size = max(n, SLICE_BYTES + 1)
    p, q = np.full(size, _RADIX[which], np.uint64), np.full(size, pow(_RADIX[which], -1, 1 << 64), np.uint64)
    p[0] = q[0] = 1
    both = np.cumprod(p), np.cumprod(q)
    if size <= 8 * SLICE_BYTES:  # an exceptionally long row is not worth keeping
        _tables[which] = both
    return both


def words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice: first row, last row, the words' hashes, and their row less first."""
    raw, starts = string_buffer(column)
    for first, last in slices(starts):
        part = LOWER[raw[starts[first] : starts[last]]]
        at = starts[first : last + 1] - starts[first]
        begin, end, row = word_spans(part, at)
        yield first, last, span_hashes(part, begin, end), row
