"""Whole texts as numpy arrays: words, lines and hashes of many documents at once.

Helpers for tasks that read Arrow batches. A batch is cut into blocks of whole
documents of about ``BLOCK_BYTES``, so memory follows the block (or one very long
document), never the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
U64 = np.uint64

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit (multiply and shift rounds)."""
    x = np.asarray(x, dtype=U64).copy()
    with np.errstate(over="ignore"):
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers for a seed."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(1 << 32)) * U64(0x9E3779B97F4A7C15))


_RADIX = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_RADIX_INV = U64(pow(int(_RADIX), -1, 1 << 64))
_BYTES = stream(256, 7)
_BYTES[SPACE] = 0
_BYTES_LOWER = _BYTES[LOWER]


def _powers(n: int, base: np.uint64) -> np.ndarray:
    p = np.full(n, base, dtype=U64)
    p[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(p)


@dataclass
class Block:
    """Documents ``first .. first + n`` of a batch; each is followed by one line feed in ``data``."""

    first: int
    data: np.ndarray
    starts: np.ndarray  # n + 1 positions

    @property
    def n(self) -> int:
        return len(self.starts) - 1


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    cuts: np.ndarray  # n + 1: the words of document i are cuts[i] .. cuts[i + 1]


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of whole texts; null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        own = offsets[i : j + 1]
        starts = own - own[0] + np.arange(j - i + 1)
        out = np.full(int(starts[-1]), 10, dtype=np.uint8)
        for k in range(j - i):
            out[starts[k] : starts[k + 1] - 1] = data[own[k] : own[k + 1]]
        yield Block(i, out, starts)
        i = j


def words(block: Block) -> Words:
    """Maximal runs without ASCII white space."""
    solid = ~SPACE[block.data]
    before = np.empty_like(solid)
    before[:1] = False
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & ~before)
    end = np.flatnonzero(~solid & before)
    cuts = np.searchsorted(start, block.starts)
    return Words(start, end, np.repeat(np.arange(block.n), np.diff(cuts)), cuts)


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of ``values`` from each start to the next (the last: to the end); starts may repeat."""
    total = np.zeros(len(values) + 1, dtype=values.dtype if values.dtype == U64 else np.int64)
    with np.errstate(over="ignore"):
        np.cumsum(values, out=total[1:])
        return total[starts[1:]] - total[starts[:-1]]


def word_hashes(block: Block, w: Words, lower: bool = False) -> np.ndarray:
    """64-bit hash of each word's bytes; with ``lower``, A-Z count as a-z."""
    if not len(w.start):
        return np.zeros(0, dtype=U64)
    with np.errstate(over="ignore"):
        values = (_BYTES_LOWER if lower else _BYTES)[block.data] * _powers(len(block.data), _RADIX)
        own = np.add.reduceat(values, w.start) * _powers(len(block.data), _RADIX_INV)[w.start]
        # the length tells apart words whose byte values sum alike
        return mix(own + (w.end - w.start).astype(U64))


def line_hashes(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of each line, its document and the hash of its bytes, white space included."""
    ends = np.flatnonzero(block.data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    table = stream(256, 11)
    table[10] = 0
    with np.errstate(over="ignore"):
        values = table[block.data] * _powers(len(block.data), _RADIX)
        own = np.add.reduceat(values, starts) * _powers(len(block.data), _RADIX_INV)[starts]
        own = mix(own + (ends - starts).astype(U64))
    return starts, np.searchsorted(block.starts, starts, side="right") - 1, own


def shingles(h: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every run of ``size`` words inside one document."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    salt = stream(size, 23) | U64(1)
    with np.errstate(over="ignore"):
        out = np.zeros(len(at), dtype=U64)
        for k in range(size):
            out += h[at + k] * salt[k]
    return mix(out), at


def distinct_per_doc(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes document by document, and n + 1 cuts."""
    cuts = np.searchsorted(doc, np.arange(n + 1))
    own = [np.unique(h[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    sizes = np.array([len(x) for x in own], dtype=np.int64)
    return (np.concatenate(own) if own else h), np.concatenate(([0], np.cumsum(sizes)))
