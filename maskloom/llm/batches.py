"""Arrow batches of texts as flat byte arrays, and hashes of their words: the array side of the Python operators.

Everything here works on one Arrow batch inside a task. Texts are never turned into Python strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer document makes a longer chunk.
CHUNK = 1 << 20

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: A random 64-bit value per byte; the second table reads A-Z as a-z.
BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = BYTE_VALUES[97:123]

#: White space of the contracts: space, and tab to carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

_BASE = 0x2545F4914F6CDD1D
_powers = {True: np.ones(1, U64), False: np.ones(1, U64)}


def powers(n: int, up: bool) -> np.ndarray:
    """The first n powers of the hash base, or of its inverse modulo 2**64."""
    p = _powers[up]
    if len(p) < n:
        base = _BASE if up else pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            p = np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(max(n, CHUNK + (1 << 18)) - 1, base, U64)]))
        _powers[up] = p
    return p[:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column without nulls, and each row's offsets into them."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of stretches of whole rows of about `size` bytes."""
    if not len(column):
        return
    buf, offs = flat(column)
    row = 0
    while row < len(offs) - 1:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + size, "right")) - 1)
        end = min(end, len(offs) - 1)
        yield row, end, buf[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def words(buf: np.ndarray, offs: np.ndarray, folded: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a chunk, and the first word of each row (and the total)."""
    n = len(buf)
    space = IS_SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    after = np.empty(n + 1, bool)  # at i: a word can start at i, or end before i
    after[0] = after[n] = True
    after[1:n] = edge[1:n]
    start = ~space
    end = start.copy()
    start[1:] &= space[:-1] | after[1:n]
    end[:-1] &= space[1:] | after[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    total = np.zeros(n + 1, U64)
    np.cumsum((FOLDED_VALUES if folded else BYTE_VALUES)[buf] * powers(n, True), out=total[1:])
    h = mix((total[e] - total[s]) * powers(n + 1, False)[s])
    return s, e, h, np.searchsorted(s, offs)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; the last k - 1 are missing."""
    if len(h) < k:
        return h[:0]
    out = np.zeros(len(h) - k + 1, U64)
    for j in range(k):
        out = out * U64(0x9FB21C651E98DF25) + h[j : j + len(out)]
    return mix(out)
