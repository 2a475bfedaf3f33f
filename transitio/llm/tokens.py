"""Vectorised tokenisation of Arrow text columns.

Texts are handled as one byte buffer per piece: word bounds come from a separator table and
word hashes from a prefix sum of byte * P^position (mod 2^64), so no Python object is made
per word. Pieces hold whole rows and about PIECE_BYTES bytes, whatever the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 19
_P = 0x9E3779B97F4A7C15
_U = np.uint64


def _bytes_table(members: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(members)] = True
    return t


#: ASCII white space parts words; everything else belongs to a word.
SPACE = _bytes_table(b"\t\n\f\r ")
#: Every ASCII character but letters and digits parts words (bytes of other scripts are letters).
PUNCT = _bytes_table(bytes(b for b in range(128) if not chr(b).isalnum()))

_pow = np.ones(1, dtype=_U)
_inv = np.ones(1, dtype=_U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, PIECE_BYTES + (1 << 16))
        _pow = np.full(size, _P, dtype=_U)
        _inv = np.full(size, pow(_P, -1, 1 << 64), dtype=_U)
        _pow[0] = _inv[0] = 1
        np.multiply.accumulate(_pow, out=_pow)
        np.multiply.accumulate(_inv, out=_inv)
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every input bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Doubles in (0, 1] from 64-bit hashes."""
    return ((x >> _U(11)).astype(np.float64) + 1.0) * 2.0 ** -53


@dataclass
class Words:
    """Words of a piece: row (within the piece), byte bounds and hash, in reading order."""
    rows: int
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    sums: np.ndarray

    def hash_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inv = _powers(len(self.sums))[1]
        return mix((self.sums[end] - self.sums[start]) * inv[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))

    def hashes(self) -> np.ndarray:
        return self.hash_of(self.start, self.end)

    def per_row(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)


def pieces(text: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of whole rows, about PIECE_BYTES at a time; null is empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text.cast(pa.large_string()), "")
    if lower:
        text = pc.utf8_lower(text)
    n = len(text)
    if not n:
        return
    _, where, body = text.buffers()
    offs = np.frombuffer(where, dtype=np.int64)[text.offset:text.offset + n + 1]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + PIECE_BYTES, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to, data[offs[at]:offs[to]], offs[at:to + 1] - offs[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> Words:
    n = len(data)
    inside = ~separators[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    power = _powers(n + 1)[0]
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum((data.astype(_U) + _U(1)) * power[:n], out=sums[1:])
    return Words(len(offsets) - 1, row, start, end, data, offsets, sums)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``size`` words; a row of fewer words has one run of them all."""
    h, row, n = w.hashes(), w.row, len(w.row)
    mult = mix(np.arange(1, size + 1, dtype=_U)) | _U(1)
    out_row, out_hash = [], []
    if n >= size:
        full = np.flatnonzero(row[size - 1:] == row[:n - size + 1])
        acc = np.zeros(len(full), dtype=_U)
        for j in range(size):
            acc += h[full + j] * mult[j]
        out_row.append(row[full])
        out_hash.append(mix(acc))
    count = w.per_row()
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        at = np.searchsorted(row, short)
        acc = count[short].astype(_U)
        for j in range(size - 1):
            has = count[short] > j
            acc[has] += h[at[has] + j] * mult[j]
        out_row.append(short)
        out_hash.append(mix(acc))
    if not out_row:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=_U)
    rows, hashes = np.concatenate(out_row), np.concatenate(out_hash)
    return rows, hashes


def bags(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multisets: (row, element, count), ordered by row and element."""
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    if not len(r):
        return r, h, np.zeros(0, dtype=np.int64)
    new = np.ones(len(r), dtype=bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return r[at], h[at], np.diff(np.append(at, len(r)))
