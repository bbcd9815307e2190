"""Quality rules: repetition coverage.

Rolling hashes of word n-grams are compared inside each text with numpy. For each n-gram length the share of the words'
characters that lie inside n-grams seen earlier in the text is measured, and so is the share inside lines seen earlier.
A text fails if a share is above the limit of its length (LIMITS) or of lines (LINE_LIMIT).

Null and empty texts have no words and fail the base rules. Repeated rows are judged alike. Whole texts are used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textkit as K
from .frames import append

LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
BASE_N = 5
FIELDS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_line_chars")]
    + [T.StructField("n_gram_chars", T.ArrayType(T.LongType())), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LINES = np.arange(256, dtype=np.uint16) + 256
_LINES[10] = 0


def twins(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks: equal to another of the same row; equal to an earlier one of the same row."""
    n = len(hashes)
    if not n:
        return np.zeros(0, bool), np.zeros(0, bool)
    key = K.mix(hashes ^ K.mix(rows.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    s = key[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    both, later = np.zeros(n, bool), np.zeros(n, bool)
    if len(start) < n:
        many = np.repeat(size > 1, size)
        both[order[many]] = True
        least = np.minimum.reduceat(order, start)
        later[order[many]] = (order > np.repeat(least, size))[many]
    return both, later


def covered(n: int, places: np.ndarray, width: int) -> np.ndarray:
    """Which of n words lie in a window of ``width`` words that starts at one of places."""
    edge = np.bincount(places, minlength=n + 1) - np.bincount(places + width, minlength=n + 1)[: n + 1]
    return np.cumsum(edge[:n]) > 0


def _sum(rows: np.ndarray, n: int, of: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, of, n).astype(np.int64) if len(rows) else np.zeros(n, np.int64)


def measure(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_line_chars and, for each length, characters covered."""
    n = len(offsets) - 1
    base = int(offsets[0])
    data, offsets = data[base : int(offsets[-1])], offsets - base
    rows, s, e, h = K.words(data, offsets, K.spaced(False))
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)))
    size = points[e] - points[s]
    lr, ls, le, lh = K.words(data, offsets, _LINES)
    first_word, past_word = np.searchsorted(s, ls), np.searchsorted(s, le)
    text = past_word > first_word
    _, again = twins(lh[text], lr[text])
    lines = np.flatnonzero(text)[again]
    in_line = np.zeros(len(s) + 1, np.int64)
    np.add.at(in_line, first_word[lines], 1)
    np.add.at(in_line, past_word[lines], -1)
    in_line = np.cumsum(in_line[:-1]) > 0
    out = []
    repeat = np.zeros(n, np.int64)
    for k in LIMITS:
        g, place = K.grams(h, rows, k)
        both, later = twins(g, rows[place])
        if k == BASE_N:
            repeat = _sum(rows[covered(len(h), place[both], k)], n)
        c = covered(len(h), place[later], k)
        out.append(_sum(rows[c], n, size[c]))
    symbols = np.flatnonzero(_SYMBOL[data])
    return [_sum(rows, n), _sum(rows, n, size), _sum(np.searchsorted(offsets, symbols, "right") - 1, n), _sum(lr[lines], n), repeat, _sum(rows[in_line], n, size[in_line]), *out]


def repetition(docs: DataFrame, *, text: str = "text", min_words: int = 10, keep: list[str] | None = None) -> DataFrame:
    """docs with the counts, n_gram_chars (one for each length in LIMITS), base_failed and kept."""

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        data, offsets, _ = K.column(batch, text)
        parts = [measure(data, offsets[a : b + 1]) for a, b in K.chunks(offsets)]
        m = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * (6 + len(LIMITS))
        words, chars = m[0], np.maximum(m[1], 1)
        failed = (words < min_words) | (100 * m[4] > 20 * words)
        kept = ~failed & (m[5] <= LINE_LIMIT * chars)
        for c, limit in zip(m[6:], LIMITS.values(), strict=True):
            kept &= c <= limit * chars
        grams = pa.FixedSizeListArray.from_arrays(pa.array(np.stack(m[6:], 1).ravel(), pa.int64()), len(LIMITS)).cast(pa.list_(pa.int64()))
        return [*(pa.array(x, pa.int64()) for x in m[:6]), grams, pa.array(failed), pa.array(kept)]

    return append(docs, FIELDS, compute, keep)
