"""Packing of tokenised documents into fixed-length sequences by large-item matching.

Pieces are grouped by a hash of their row into groups of about GROUP pieces, whatever their sizes or ids are, and each
group is packed in one task. Of the pieces above a third of the capacity at most two fit in a sequence: from the largest
on, each is matched with the largest other one that still fits. The smaller pieces then go, largest first, to the sequence
whose gap they fill best. A group leaves about one part-filled sequence, so that GROUP costs next to nothing.

Null and empty texts are documents of one closing id. Documents are never dropped; only those longer than the capacity are
cut. Repeated rows are packed like any others.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import written
from .wordbpe import encoder

CAPACITY = 2048
GROUP = 32_768
END_ID = 0
#: Characters that are encoded at once; a longer text is encoded by itself.
BLOCK_CHARS = 1 << 19
PIECES = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]


def cut_pieces(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32 and, if asked for, its ids."""
    key = docs.schema[doc_id]
    schema = T.StructType([T.StructField("doc_id", key.dataType)] + [T.StructField(n, t) for n, t in PIECES] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            size = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
            total = np.concatenate(([0], np.cumsum(size)))
            a = 0
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(total, total[a] + BLOCK_CHARS, "right")) - 1)
                yield pieces(keys.slice(a, b - a), [t or "" for t in texts[a:b]], code)
                a = b

    def pieces(keys: pa.Array, texts: list[str], code) -> pa.RecordBatch:
        ids, offsets = code.encode(texts)
        n = len(texts)
        stream = np.full(len(ids) + n, END_ID, "<u4")
        stream[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(offsets))] = ids
        first = offsets + np.arange(n + 1)
        count = -(-np.diff(first) // capacity)
        row = np.repeat(np.arange(n), count)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = piece * capacity
        length = np.minimum(capacity, np.diff(first)[row] - start)
        at = first[row] + start
        raw = memoryview(stream.tobytes())
        crc = [zlib.crc32(raw[4 * x : 4 * (x + y)]) for x, y in zip(at.tolist(), length.tolist(), strict=True)]
        out = [keys.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        if with_ids:
            out.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(stream)) if len(at) else [0], pa.int32()), pa.array(stream.astype(np.int32))))
        return pa.RecordBatch.from_arrays(out, names=[f.name for f in schema])

    return docs.select(doc_id, F.col(text).cast("string")).mapInArrow(run, schema)


def match(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece. Pieces of equal length keep their order."""
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    large = order[lengths[order] * 3 > capacity]
    gaps: list[list[int]] = [[] for _ in range(capacity + 1)]  # open sequences by what they still take
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # large pieces not placed, by length
    for i in large[::-1].tolist():
        free[int(lengths[i])].append(i)
    open_lengths = sum(1 << x for x in range(capacity + 1) if free[x])  # bit x: free[x] isn't empty
    made = 0
    for i in large.tolist():
        if sequence[i] >= 0:
            continue
        size = int(lengths[i])
        free[size].pop()  # i is the first left of its length
        if not free[size]:
            open_lengths ^= 1 << size
        sequence[i], left = made, capacity - size
        other = (open_lengths & ((2 << left) - 1)).bit_length() - 1
        if other > 0:
            j = free[other].pop()
            if not free[other]:
                open_lengths ^= 1 << other
            sequence[j], offset[j] = made, size
            left -= other
        gaps[left].append(made)
        made += 1
    fill = [0] * made
    for g, seqs in enumerate(gaps):
        for q in seqs:
            fill[q] = capacity - g
    # smaller pieces: the tightest gap that takes them, else a new sequence
    open_gaps = sum(1 << x for x in range(capacity + 1) if gaps[x])
    for i in order[len(large) :].tolist():
        size = int(lengths[i])
        fits = open_gaps >> size
        if not fits:
            q, g = made, capacity
            made += 1
            fill.append(0)
        else:
            g = size + (fits & -fits).bit_length() - 1
            q = gaps[g].pop()
            if not gaps[g]:
                open_gaps ^= 1 << g
        sequence[i], offset[i] = q, fill[q]
        fill[q] += size
        gaps[g - size].append(q)
        open_gaps |= 1 << (g - size)
    return sequence, offset


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """pieces (read from files: its rows keep their places) with sequence_id and offset."""
    total = pieces.count()
    groups = max(1, math.ceil(total / group))
    schema = T.StructType([*pieces.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "ids_crc32", "piece"], ascending=False, kind="stable").drop(columns="__group")
        seq, off = match(part["length"].to_numpy(), capacity)
        return part.assign(sequence_id=seq + (int(key[0]) << 32), offset=off)

    tagged = pieces.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    return tagged.repartition(groups, "__group").groupBy("__group").applyInPandas(one, schema)


def pack_documents(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents with their sequences. Tokenised once: the pieces are written to the shared folder."""
    return pack(written(cut_pieces(docs, tokenizer, doc_id=doc_id, text=text, capacity=capacity)), capacity=capacity)
