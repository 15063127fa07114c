"""Numpy helpers over batches of texts, used inside Spark tasks.

Texts arrive as Arrow string columns; ``text_chunks`` cuts each batch into pieces of bounded bytes, so that a worker
holds a few arrays of one piece at a time. One document is never cut: memory follows the longest document.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
PRIME = np.uint64((1 << 61) - 1)
BASE = 0x51342543DE82EF95 % int(PRIME)
INVERSE = pow(BASE, -1, int(PRIME))
BLOCK = 1 << 16
#: Powers that a worker keeps; those of longer texts are made anew and let go.
KEPT_POWERS = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over all output bits."""
    x = x.astype(np.uint64, copy=True)
    x += GOLDEN
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.cache
def byte_values(lower: bool = False) -> np.ndarray:
    """A random 64-bit value per byte; with ``lower``, A-Z share those of a-z."""
    table = mix(np.arange(256, dtype=np.uint64) + np.uint64(1 << 20))
    if lower:
        table[65:91] = table[97:123]
    return table


def _folded(x: np.ndarray) -> np.ndarray:
    """Residues modulo PRIME of numbers below 2^64."""
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.minimum(x, x - PRIME)  # below PRIME the difference wraps around to a larger number


def _shifted(x: np.ndarray) -> np.ndarray:
    """Residues times 2^31, not yet folded: 2^61 is 1 modulo PRIME."""
    return (x >> np.uint64(30)) + ((x & np.uint64((1 << 30) - 1)) << np.uint64(31))


def times(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Products modulo PRIME of residues, by blocks that fit a core's cache."""
    b = np.broadcast_to(b, a.shape)
    out = np.empty(len(a), np.uint64)
    s31, low31 = np.uint64(31), np.uint64((1 << 31) - 1)
    for i in range(0, len(a), BLOCK):
        x, y = a[i : i + BLOCK], b[i : i + BLOCK]
        x1, x0, y1, y0 = x >> s31, x & low31, y >> s31, y & low31
        # 2^62 is 2 modulo PRIME, and the sum stays below 2^64.
        out[i : i + BLOCK] = _folded(((x1 * y1) << np.uint64(1)) + _shifted(x1 * y0 + x0 * y1) + x0 * y0)
    return out


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) <= n:
        out = np.concatenate([out, times(out, np.uint64(pow(base, len(out), int(PRIME))))])
    return out


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0..n and its inverse powers modulo PRIME; up to KEPT_POWERS of them are kept."""
    if _POWERS and len(_POWERS["up"]) > n:
        return _POWERS["up"], _POWERS["down"]
    made = _powers(BASE, n), _powers(INVERSE, n)
    if n <= KEPT_POWERS:
        _POWERS.update(up=made[0], down=made[1])
    return made


class Spans:
    """Hashes of any slice of a value sequence in O(1), from one prefix sum.

    A slice's hash is the polynomial in BASE of its values modulo the prime 2^61 - 1, independent of where the slice
    starts. Modulo a power of two, texts over two symbols can be arranged to collide in every base; modulo a prime two
    different slices of n values collide for at most n of the 2^61 bases.
    """

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self.down = powers(n)
        self.sums = np.zeros(n + 1, np.uint64)
        low = np.uint64((1 << 31) - 1)
        before = np.zeros(2, np.uint64)  # sums so far of the upper and lower halves: below 2^64 for 2^32 values
        for i in range(0, n, BLOCK):
            term = times(_folded(values[i : i + BLOCK]), up[i : min(i + BLOCK, n)])
            high, rest = np.cumsum(term >> np.uint64(31)) + before[0], np.cumsum(term & low) + before[1]
            before[:] = high[-1], rest[-1]
            self.sums[i + 1 : i + 1 + len(term)] = _folded(_shifted(_folded(high)) + _folded(rest))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = times(_folded(self.sums[ends] + (PRIME - self.sums[starts])), self.down[starts])
        return mix(value ^ (mix((ends - starts).astype(np.uint64)) << np.uint64(3)))


def same_pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For slices of bytes: places of one slice of each different text, and which of them each slice equals.

    Slices are grouped by hash and then compared byte by byte; should a hash ever join two texts, they are told apart.
    """
    _, at, which = np.unique(Spans(byte_values()[data])(starts, ends), return_index=True, return_inverse=True)
    size = ends - starts
    first = at[which]
    odd = size[first] != size
    for i in range(0, len(starts), BLOCK):  # bounded index arrays
        part = slice(i, i + BLOCK)
        n = np.where(odd[part], 0, size[part])
        differs = data[ragged(starts[part], n)] != data[ragged(starts[first[part]], n)]
        if differs.any():
            odd[i + np.repeat(np.arange(len(n)), n)[differs]] = True
    if odd.any():
        raw, known, more = data.tobytes(), {}, []
        for k in np.flatnonzero(odd).tolist():
            text = raw[starts[k] : ends[k]]
            if text not in known:
                known[text] = len(at) + len(more)
                more.append(k)
            which[k] = known[text]
        at = np.concatenate([at, np.array(more, at.dtype)])
    return at, which


def release() -> None:
    """Gives memory that a worker no longer uses back to the machine, so that it doesn't weigh on later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (length n + 1) of an Arrow string or binary column; null is empty."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if large else np.int32
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def text_chunks(
    batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) pieces of at most ``most`` text bytes, or of one document."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        data, offs = text_buffers(batch.column(batch.schema.get_field_index(column)))
        i, n = 0, batch.num_rows
        while i < n:
            j = int(np.searchsorted(offs, offs[i] + most, side="right")) - 1
            j = min(n, max(j, i + 1), i + 4096)
            yield batch.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j
    data = offs = batch = None
    release()


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the first word of each document (length n + 1)."""
    ink = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    first = ink.copy()
    first[1:] &= ~ink[:-1] | cut[1:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:] | cut[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated index ranges start..start+length."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def binary_column(values: list[bytes | None]) -> pa.Array:
    return pa.array(values, pa.binary())
