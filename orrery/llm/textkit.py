"""Vectorised text primitives shared by the operators of this subpackage.

Texts arrive as Arrow string columns. Words are cut and hashed on the UTF-8 bytes with numpy, in blocks of half a
megabyte, so that memory is bounded by the longest single text. Hashes are 64-bit and the same on every machine: all
tables below come from a fixed seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
_LONG = 1 << 12

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(0, 1 << 63, _LONG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GRAM = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every bit of x over the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def spaced(lower: bool) -> np.ndarray:
    """Byte table for words ``[^\\x20\\x09-\\x0D]+``: 0 separates, any other value stands for the byte."""
    t = np.arange(256, dtype=np.uint16) + 256
    t[[9, 10, 11, 12, 13, 32]] = 0
    if lower:
        t[65:91] += 32
    return t


def alnum(lower: bool) -> np.ndarray:
    """Byte table for words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of texts in which A-Z are lower-cased."""
    t = np.arange(256, dtype=np.uint16) + 256
    upper = t[65:91].copy()
    t[0:0x30] = 0
    t[0x3A:0x61] = 0
    t[0x7B:0x80] = 0
    if lower:
        t[65:91] = upper + 32
    return t


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, n + 1 offsets and validity of a string column; a null has no bytes."""
    col = batch.column(batch.schema.get_field_index(name))
    n = len(col)
    if n == 0 or pa.types.is_null(col.type):
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), np.zeros(n, bool)
    valid = np.asarray(col.is_valid().to_numpy(zero_copy_only=False), dtype=bool)
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    kind = np.dtype(np.int64 if wide else np.int32)
    offsets = np.frombuffer(offs, kind, n + 1, col.offset * kind.itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not valid.all():
        lens = np.where(valid, np.diff(offsets), 0)
        if int(lens.sum()) != int(offsets[-1] - offsets[0]):  # bytes under a null: leave them out
            return column(pa.record_batch([pa.array(col.to_pylist(), col.type)], [name]), name)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0], valid


def chunks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes each; a longer text is a range of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def _block(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of one block of mapped bytes."""
    inside = codes != 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    lens = ends - starts
    letters = (codes[inside] & 255).astype(np.intp)
    first = np.concatenate(([0], np.cumsum(lens)[:-1]))
    place = np.arange(len(letters)) - np.repeat(first, lens)
    if int(lens.max()) <= _LONG:
        weight = _PLACE[place]
    else:
        weight = _PLACE[place & (_LONG - 1)] * (mix((place // _LONG).astype(np.uint64)) | np.uint64(1))
    hashes = np.add.reduceat(_BYTE[letters] * weight, first)
    return starts, ends, mix(hashes + lens.astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, end (byte places in data) and hash of each word, in order. Words don't cross rows."""
    n = len(offsets) - 1
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    base, stop = int(offsets[0]), int(offsets[-1])
    bounds = np.unique(offsets)
    at = base
    while at < stop:
        end = min(stop, at + BLOCK_BYTES)
        if end < stop:  # end the block where no word is open
            row_end = bounds[np.searchsorted(bounds, end)]
            gap = end
            while gap < row_end:
                hole = np.flatnonzero(table[data[gap : min(row_end, gap + 65536)]] == 0)
                if len(hole):
                    gap += int(hole[0])
                    break
                gap = min(int(row_end), gap + 65536)
            end = int(gap)
        codes = table[data[at:end]]
        inner = bounds[(bounds > at) & (bounds < end)] - at
        if len(inner):  # a separator between rows, so that words don't join
            s, e, h = _block(np.insert(codes, inner, 0))
            put = inner + np.arange(len(inner))
            s, e = s - np.searchsorted(put, s), e - np.searchsorted(put, e)
        else:
            s, e, h = _block(codes)
        parts.append((s + at, e + at, h))
        at = end
    if parts:
        s, e, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    else:
        s, e, h = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row = np.searchsorted(offsets, s, "right") - 1
    return np.minimum(row, n - 1), s, e, h


def grams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n words of one row, and the place of its first word."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = hashes[:m] * _GRAM[0]
    for k in range(1, n):
        out += hashes[k : k + m] * _GRAM[k]
    place = np.flatnonzero(rows[:m] == rows[n - 1 :])
    return mix(out[place] + np.uint64(n)), place


def in_sorted(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Place of each value in a sorted array, or -1."""
    if not len(among):
        return np.full(len(values), -1, np.int64)
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return np.where(among[at] == values, at, -1)


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
