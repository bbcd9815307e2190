"""Benchmark decontamination by winnowing.

Both sides are cut into k-grams of words; of each run of ``window - k + 1`` k-grams the one with the least hash is kept
as a fingerprint (the last of equal ones). Two texts that share ``window`` words keep the same k-gram there, so no shared
window is missed. Documents' fingerprints are joined with the benchmark's, and every hit is extended to the full windows
around it, which must be equal under two 64-bit hashes. Items shorter than a window are looked up as a whole.

The benchmark's index is broadcast in blocks of about ``block_words`` words, at most ``at_once`` of them at a time. Up to so
many are looked up in one map stage without a shuffle. A larger benchmark takes a map stage over the documents for each
``at_once`` blocks; then only rows with hits are shuffled, and what the stages found is put together.

Nulls and empty texts have no words; items with a null text or without words are no windows. An item whose id is null has
windows like any other, which count as hits, but no id to be told. Repeated documents are each judged alone; repeated items
count once for each item_id. Item ids may be of any type and are compared as strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .frames import append, written

FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("spans", T.ArrayType(T.LongType())),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
])


def winnow(hashes: np.ndarray, rows: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (hash and place of the first word) of texts given as word hashes.

    A row with at least k words but fewer than w k-grams keeps the least of those it has.
    """
    g, place = K.grams(hashes, rows, k)
    n = len(g)
    if not n:
        return g, place
    r = rows[place]
    first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
    count = np.diff(np.append(first, n))
    keep = np.zeros(n, bool)
    m = n - w + 1
    if m > 0:
        best = np.arange(m)
        for j in range(1, w):
            here = np.arange(j, j + m)
            best = np.where(g[here] <= g[best], here, best)
        keep[best[r[:m] == r[w - 1 :]]] = True
    for a, c in zip(first[count < w].tolist(), count[count < w].tolist(), strict=True):
        keep[a + c - 1 - int(np.argmin(g[a : a + c][::-1]))] = True
    at = np.flatnonzero(keep)
    return g[at], place[at]


class Index:
    """Fingerprints and windows of one block of the benchmark."""

    def __init__(self, ids: list[str | None], texts: list[str], window: int):
        self.window, self.k = window, max(1, window // 2)
        self.w = window - self.k + 1
        col = pa.record_batch([pa.array(texts, pa.string())], ["t"])
        data, offsets, _ = K.column(col, "t")
        rows, _, _, h = K.words(data, offsets, K.alnum(True))
        self.prints = np.unique(winnow(h, rows, self.k, self.w)[0])
        self.ids = ids
        sizes = np.bincount(rows, minlength=len(ids))
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self._add(h, rows, window, np.ones(len(rows), bool))
        for n in np.unique(sizes[(sizes > 0) & (sizes < window)]).tolist():
            self._add(h, rows, n, sizes[rows] == n)

    def _add(self, h: np.ndarray, rows: np.ndarray, n: int, of: np.ndarray) -> None:
        """Windows of n words: sorted distinct hashes, their second hashes, and the items that hold each."""
        h, rows = h[of], rows[of]
        g, place = K.grams(h, rows, n)
        if not len(g):
            return
        pairs = np.unique(np.rec.fromarrays([g, second(h, place, n), rows[place]], names="g,s,r"))
        uniq, first = np.unique(pairs.g, return_index=True)
        self.tables[n] = (uniq, pairs.s[first].copy(), np.append(first, len(pairs)), pairs.r.astype(np.int64))


def second(h: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Another hash of the n words from each place on."""
    out = np.zeros(len(place), np.uint64)
    for j in range(n):
        out = K.mix(out ^ h[place + j]) + np.uint64(j)
    return out


def hits(h: np.ndarray, rows: np.ndarray, index: Index) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """For each window length: places of hit windows, that length, and the rows and items of the pairs found."""
    for n, (uniq, twin, first, items) in index.tables.items():
        if n == index.window:
            f, at = winnow(h, rows, index.k, index.w)
            at = at[K.in_sorted(f, index.prints) >= 0]
            if not len(at):
                continue
            start = np.unique((at[:, None] - np.arange(n - index.k + 1)).ravel())
            start = start[(start >= 0) & (start + n <= len(h))]
            start = start[rows[start] == rows[start + n - 1]]
            g = np.zeros(len(start), np.uint64)
            for j in range(n):
                g += h[start + j] * K._GRAM[j]
            g = K.mix(g + np.uint64(n))
        else:
            g, start = K.grams(h, rows, n)
        slot = K.in_sorted(g, uniq)
        start, slot = start[slot >= 0], slot[slot >= 0]
        same = second(h, start, n) == twin[slot]
        start, slot = start[same], slot[same]
        if not len(start):
            continue
        pair = np.unique(np.stack((rows[start], slot)), axis=1)
        count = first[pair[1] + 1] - first[pair[1]]
        flat = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[pair[1]], count)
        yield start, n, np.repeat(pair[0], count), items[flat]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int, window: int) -> Iterator[Index]:
    ids: list[str | None] = []
    texts: list[str] = []
    size = 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    for r in rows.toLocalIterator():
        ids.append(r.i)
        texts.append(r.t)
        size += len(r.t) // 2 + 1  # at least as many as it has words
        if size >= block_words:
            yield Index(ids, texts, window)
            ids, texts, size = [], [], 0
    if ids:
        yield Index(ids, texts, window)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_words: int = 2_000_000, at_once: int = 4, keep: list[str] | None = None) -> DataFrame:
    """docs with n_words, n_hit, spans and item_ids.

    spans: word places [from, to, from, to, ...) that are hit, merged and in order. item_ids: distinct ids of the items
    with a window in the document, sorted as strings. ``keep``: the columns of docs to return, all of them if None.
    """
    blocks = _blocks(benchmark, item_id, item_text, block_words, window)
    now, after = list(islice(blocks, at_once)), list(islice(blocks, at_once))
    if not after:
        return _looked_up(docs, now, text, keep)[0]
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()))
    found: list[DataFrame] = []
    while now:
        out, shared = _looked_up(rows, now, text, ["__row"])
        found.append(written(out.where("n_hit > 0").select("__row", "spans", "item_ids")))
        for x in shared:
            x.destroy()
        now, after = after, list(islice(blocks, at_once))
    all_found = found[0]
    for x in found[1:]:
        all_found = all_found.unionByName(x)
    flat = lambda c: F.flatten(F.collect_list(c))  # noqa: E731  a row has one entry a stage
    together = all_found.groupBy("__row").agg(flat("spans").alias("__spans"), F.array_sort(F.array_distinct(flat("item_ids"))).alias("__ids"))

    def joined(batch: pa.RecordBatch) -> list[pa.Array]:
        data, offsets, _ = K.column(batch, text)
        n_words = [np.bincount(K.words(data, offsets[a : b + 1], K.alnum(True))[0], minlength=b - a) for a, b in K.chunks(offsets)]
        spans = [_merged(x or []) for x in batch.column(batch.schema.get_field_index("__spans")).to_pylist()]
        ids = [x or [] for x in batch.column(batch.schema.get_field_index("__ids")).to_pylist()]
        hit = [sum(x[1::2]) - sum(x[::2]) for x in spans]
        return [pa.array(np.concatenate(n_words) if n_words else [], pa.int64()), pa.array(hit, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.string()))]

    columns = [c for c in docs.columns if keep is None or c in keep]
    return append(rows.join(together, "__row", "left"), FIELDS, joined, columns)


def _merged(spans: list[int]) -> list[int]:
    """Spans [from, to, from, to, ...] of several stages in order, without overlaps."""
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _looked_up(docs: DataFrame, blocks: list[Index], text: str, keep: list[str] | None) -> tuple[DataFrame, list]:
    """docs with what is found in some blocks, and the broadcasts behind it."""
    shared = [docs.sparkSession.sparkContext.broadcast(i) for i in blocks]

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        data, offsets, _ = K.column(batch, text)
        n_words, n_hit, spans, found = [], [], [], []
        for a, b in K.chunks(offsets):
            part = offsets[a : b + 1]
            rows, _, _, h = K.words(data, part, K.alnum(True))
            n = b - a
            total = np.bincount(rows, minlength=n)
            edge = np.zeros(len(h) + 1, np.int64)
            items: list[set[str]] = [set() for _ in range(n)]
            for block in shared:
                for start, width, r, i in hits(h, rows, block.value):
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + width, -1)
                    ids = block.value.ids
                    for x, y in zip(r.tolist(), i.tolist(), strict=True):
                        if ids[y] is not None:
                            items[x].add(ids[y])
            hit = np.cumsum(edge[:-1]) > 0
            n_words.append(total)
            n_hit.append(np.bincount(rows[hit], minlength=n))
            any_hit = n_hit[-1] > 0
            first = np.concatenate(([0], np.cumsum(total)))
            for x in range(n):
                if any_hit[x]:
                    change = np.flatnonzero(np.diff(np.concatenate(([False], hit[first[x] : first[x + 1]], [False])).view(np.int8)))
                    spans.append(change.tolist())
                else:
                    spans.append([])
                found.append(sorted(items[x]))
        whole = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return [whole(n_words), whole(n_hit), pa.array(spans, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))]

    return append(docs, FIELDS, compute, keep), shared
