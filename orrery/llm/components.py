"""Connected components of an edge table: union-find in blocks, then alternating stars. No graph reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import dropped, gathered

#: A block of edges that one task joins by union-find.
BLOCK_EDGES = 500_000


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b) and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = list(range(len(nodes)))
    half = len(a)
    for x, y in zip(at[:half].tolist(), at[half:].tolist(), strict=True):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x < y:
            root[y] = x
        elif y < x:
            root[x] = y
    for x in range(len(root)):  # a root is smaller than what hangs on it
        root[x] = root[root[x]]
    return nodes, nodes[root]


def _blocks(edges: DataFrame, blocks: int) -> DataFrame:
    """Edges (u, v), v < u, of a star forest with the components that the edges have within each block."""
    kind = edges.schema["u"].dataType
    schema = T.StructType([T.StructField("u", kind), T.StructField("v", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)  # at most a few times BLOCK_EDGES pairs of ids
        if not parts:
            return
        u, v = (pa.chunked_array([p.column(c) for p in parts]).to_numpy() for c in ("u", "v"))
        nodes, least = joined(u, v)
        apart = nodes != least
        yield pa.RecordBatch.from_arrays([pa.array(nodes[apart], parts[0].schema.types[0]), pa.array(least[apart], parts[0].schema.types[0])], names=["u", "v"])

    dealt = edges.repartition(blocks, "u") if blocks > 1 else edges.repartition(1)
    return dealt.mapInArrow(run, schema)


def components(edges: DataFrame, *, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """(node, component) for each node of edges (a, b): the component is its smallest node.

    Edges are dealt by their larger node to blocks of about ``block_edges``; each block becomes a star forest. If there is
    more than one, each round hangs every node's larger neighbours on its smallest one and then its smaller neighbours too;
    the edges form stars after a number of rounds that grows with the logarithm of the longest path. Nulls and loops are
    left out. A node with very many edges to smaller ones makes its block larger; it meets each neighbour once.
    """
    now = gathered(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    blocks = max(1, -(-now.count() // block_edges))
    forest = gathered(_blocks(now, blocks))
    dropped(now)
    now = forest
    state = _state(now) if blocks > 1 else None
    while blocks > 1:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        after = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = gathered(after)
        dropped(now)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
