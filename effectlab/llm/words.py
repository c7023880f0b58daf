"""NumPy kernels over the text buffers of Arrow batches, shared by the operators here.

A word is a run of bytes other than ASCII white space (``\\x20``, ``\\x09``-``\\x0D``); for
UTF-8 that equals the runs of characters ``[^\\x20\\x09-\\x0D]+``. Words are told apart by a
64-bit hash: a polynomial in per-byte random values, finalised by two multiply-xor rounds.
Blocks bound the memory: a batch is worked through in runs of rows of ``BLOCK`` bytes (a
longer text is a block of its own), so no kernel holds more than some tens of bytes per
byte of a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one kernel call works on.
BLOCK = 400_000

_PRIME = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_PRIME, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_PRIME))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i mod 2**64 for i below n, by doubling; kept between blocks."""
    out = _POWERS.get(base, np.ones(1, np.uint64))
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
        _POWERS[base] = out
    return out[:n]


@dataclass
class Block:
    """Rows ``first`` to ``last`` of a batch: their bytes, and where each row begins."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return self.last - self.first


@dataclass
class Words:
    """Words of a block in order: byte ranges, hashes, and the first word of each row."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row_start: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row_start) - 1), np.diff(self.row_start))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK) -> Iterator[Block]:
    """The rows of a string column in runs of about ``size`` bytes."""
    if len(column) == 0:
        return
    raw, offsets = text_buffer(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(rows, max(first + 1, last))
        low, high = int(offsets[first]), int(offsets[last])
        yield Block(first, last, raw[low:high], offsets[first : last + 1] - low)
        first = last


def words_of(block: Block, lower: bool = False, hashes: bool = True) -> Words:
    """The words of a block. ``lower`` folds A-Z; without ``hashes`` only the ranges are made."""
    data, offsets = block.data, block.offsets
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if hashes and n:
        values = (_BYTE_VALUES[_LOWER] if lower else _BYTE_VALUES)[data]
        values *= _powers(_PRIME, n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values, out=total[1:])
        code = mix((total[end] - total[start]) * _powers(_INVERSE, n)[start] + np.uint64(_PRIME))
    else:
        code = np.zeros(len(start), np.uint64)
    return Words(start, end, code, np.searchsorted(start, offsets))


def windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words inside a row, and the window's first word."""
    n = len(words.hash) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code = np.zeros(n, np.uint64)
    for i in range(width):
        code = code * np.uint64(_PRIME) + words.hash[i : i + n]
    row = words.row
    at = np.flatnonzero(row[:n] == row[width - 1 :])
    return mix(code[at]), at


def signed(code: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's bigint."""
    return code.view(np.int64)
