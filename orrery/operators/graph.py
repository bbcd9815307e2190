"""Graph analytics over edges (s, o): PageRank, centralities, components, hierarchies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import algebra as A
from .lineage import written
from .paths import transitive


def edges_of(quads: DataFrame, predicates: list[str] | None = None, direction: str = "forward") -> DataFrame:
    """Distinct (s, o) with an IRI object, forward, reverse or both."""
    e = quads.where("o.kind = 0")
    e = e.where(F.col("p").isin(predicates)) if predicates else e
    e = e.select("s", "o")
    back = e.select(F.col("o").alias("s"), F.col("s").alias("o"))
    return {"forward": e, "reverse": back, "both": e.unionByName(back)}[direction].distinct()


def pagerank(edges: DataFrame, *, damping: float = 0.85, max_rounds: int = 100, tolerance: float = 1e-6, weight: str | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """(node, score): (1 - d) / N + d (sum of neighbours' shares + dangling / N), from 1 / N until no score moves by more.

    weight: an edge column; seeds (node): teleport goes to these only. Scores of one round are added up before the shuffle.
    """
    e = edges.select("s", "o", (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w")).groupBy("s", "o").agg(F.max("w").alias("w"))
    out = e.groupBy("s").agg(F.sum("w").alias("out"))
    e = written(e.join(out, "s").select("s", "o", (F.col("w") / F.col("out")).alias("w")))
    nodes = written(edges.select(F.explode(F.array("s", "o")).alias("node")).distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("score", F.lit(0.0))
    if seeds is None:
        base = nodes.withColumn("base", F.lit(1.0 / n))
    else:
        k = seeds.join(nodes, "node", "left_semi").distinct().count()
        base = nodes.join(seeds.distinct().withColumn("base", F.lit(1.0 / max(k, 1))), "node", "left").fillna(0.0, ["base"])
    base = written(base)
    score = nodes.withColumn("score", F.lit(1.0 / n))
    sources = written(e.select(F.col("s").alias("node")).distinct())
    for i in range(max_rounds):
        if i == 0:
            dangling = (n - sources.count()) / n
        got = e.join(score.withColumnRenamed("node", "s"), "s").groupBy("o").agg(F.sum(F.col("w") * F.col("score")).alias("got"))
        new = base.join(got.withColumnRenamed("o", "node"), "node", "left").join(score.withColumnRenamed("score", "old"), "node")
        value = (1 - damping) * F.col("base") + damping * (F.coalesce("got", F.lit(0.0)) + F.lit(dangling / n) if seeds is None else F.coalesce("got", F.lit(0.0)) + F.lit(dangling) * F.col("base"))
        score = written(new.select("node", value.alias("score"), F.abs(value - F.col("old")).alias("moved")))
        stats = score.join(sources.withColumn("src", F.lit(True)), "node", "left").agg(F.max("moved").alias("m"), F.sum(F.when(F.col("src").isNull(), F.col("score")).otherwise(0.0)).alias("d")).first()
        score, dangling = score.select("node", "score"), stats.d or 0.0
        if stats.m <= tolerance:
            break
    return score


def centrality(edges: DataFrame, metric: str) -> DataFrame:
    """(node, score) by degrees: in, out, degree, share (degree over all degrees), relative (degree / (N - 1))."""
    e = edges.select("s", "o").distinct()
    ends = {"in": e.select(F.col("o").alias("node")), "out": e.select(F.col("s").alias("node"))}.get(metric, e.select(F.explode(F.array("s", "o")).alias("node")))
    d = ends.groupBy("node").agg(F.count("*").alias("d"))
    if metric in ("in", "out", "degree"):
        return d.select("node", F.col("d").cast("double").alias("score"))
    total = d.agg(F.sum("d").alias("t"), F.count("*").alias("n")).first()
    return d.select("node", (F.col("d") / F.lit(float(total.t if metric == "share" else max(total.n - 1, 1)))).alias("score"))


def contributors(edges: DataFrame, scores: DataFrame, node, top: int = 10) -> DataFrame:
    """The neighbours that give a node most of its PageRank."""
    e = edges.select("s", "o").distinct()
    out = e.groupBy("s").agg(F.count("*").alias("out"))
    near = e.where(F.col("o") == node).join(out, "s").join(scores.withColumnRenamed("node", "s"), "s")
    return near.select("s", (F.col("score") / F.col("out")).alias("share")).orderBy(F.desc("share"), "s").limit(top)


#: Edges that one task joins by itself.
BLOCK_EDGES = 1_000_000


def _least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b) and the smallest node of each one's component: roots hang on smaller ones, then paths are halved."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            return nodes, nodes[root]
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def _forest(edges: DataFrame, blocks: int) -> DataFrame:
    """Stars (u, v), v < u, that join what the edges (u, v) of each block join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if parts:
            nodes, least = _least(*(np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("u", "v")))
            apart = nodes != least
            yield pa.RecordBatch.from_arrays([pa.array(nodes[apart]), pa.array(least[apart])], names=["u", "v"])

    return edges.repartition(blocks, "u").mapInArrow(run, "u bigint, v bigint")


def components(edges: DataFrame, *, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """(node, component): the smallest node that is reached without regard to direction.

    Nodes are numbered in their order. Blocks of edges become stars by union-find; while there is more than one block, each round
    hangs every node's larger neighbours on its smallest one, and then its smaller ones. Rounds grow with the logarithm of the
    longest path, whatever the order of nodes along it.
    """
    ends = written(edges.select("s", "o").where("s is not null and o is not null").distinct())
    nodes = written(ends.select(F.explode(F.array("s", "o")).alias("node")).distinct())
    nodes = written(nodes.sort("node").withColumn("id", F.monotonically_increasing_id()))
    for c, n in (("s", "u"), ("o", "v")):
        ends = ends.hint("merge").join(nodes.select(F.col("node").alias(c), F.col("id").alias(n)), c)
    now = written(ends.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    blocks = max(1, -(-now.count() // block_edges))
    now = written(_forest(now, blocks))
    state = _state(now) if blocks > 1 else None
    while blocks > 1:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.hint("merge").join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.hint("merge").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(now)
        if state == before:
            break
    found = nodes.hint("merge").join(now.withColumnRenamed("u", "id"), "id", "left").select("node", F.coalesce("v", "id").alias("id"))
    return found.hint("merge").join(nodes.select(F.col("node").alias("component"), "id"), "id").select("node", "component")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def ancestors(broader: DataFrame, node, max_depth: int = 50) -> DataFrame:
    """(node, depth) of all that lies above along broader edges (s, o)."""
    return transitive(broader, start=node, max_depth=max_depth, depths=True).select(F.col("o").alias("node"), "depth")


def descendants(broader: DataFrame, node, max_depth: int = 50) -> DataFrame:
    return transitive(broader, end=node, max_depth=max_depth, depths=True).select(F.col("s").alias("node"), "depth")


def siblings(broader: DataFrame, node) -> DataFrame:
    """Others with a common parent."""
    up = broader.where(F.col("s") == node).select("o").distinct()
    return broader.join(up, "o", "left_semi").where(F.col("s") != node).select(F.col("s").alias("node")).distinct()


def triangles(edges: DataFrame) -> DataFrame:
    """Distinct triangles (a, b, c), a < b < c, of undirected edges: each edge is kept at its end of lower degree, which bounds the pairs at a hub."""
    e = edges.select(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).where("a <> b").distinct()
    deg = e.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count("*").alias("d"))
    d = e.join(deg.select(F.col("n").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("n").alias("b"), F.col("d").alias("db")), "b")
    first = F.struct("da", "a") < F.struct("db", "b")
    out = d.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("y"))
    wedge = out.join(out.withColumnRenamed("y", "z"), "x").where("y < z")
    closed = wedge.join(e, (wedge["y"] == e["a"]) & (wedge["z"] == e["b"]), "left_semi")
    t = F.array_sort(F.array("x", "y", "z"))
    return closed.select(t[0].alias("a"), t[1].alias("b"), t[2].alias("c"))


def related(quads: DataFrame, node) -> DataFrame:
    """Concepts that are related to a node in either direction (skos:related)."""
    e = quads.where(F.col("p") == A.SKOS + "related").select("s", "o")
    both = e.where(F.col("s") == node).select(F.col("o").alias("node")).unionByName(e.where(F.col("o") == node).select(F.col("s").alias("node")))
    return both.distinct()


def labels(quads: DataFrame, lang: str = "en") -> DataFrame:
    """(node, label): the preferred label of each concept, in the language if there is one, else without language, else any."""
    p = quads.where(F.col("p") == A.SKOS + "prefLabel")
    rank = F.when(F.col("o.lang") == lang, 0).when(F.col("o.lang") == "", 1).otherwise(2)
    return p.groupBy(F.col("s.lex").alias("node")).agg(F.min(F.struct(rank.alias("r"), F.col("o.lang").alias("l"), F.col("o.lex").alias("x"))).alias("b")).select("node", F.col("b.x").alias("label"))
