"""Search, vectors, entity resolution, uncertainty and privacy-preserving linkage."""

from __future__ import annotations

import hashlib
import hmac
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .lineage import written

#: Rows of a block that meet in one task, and of a block of vectors.
CELL = 512

_STOP = "a an and are as at be by for from has he in is it its of on that the to was were will with".split()


def terms(text: Column) -> Column:
    """Lower-cased words without stop words, with plural and verb endings cut and a consonant that the ending doubled."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(_STOP))
    words = F.transform(words, lambda w: F.regexp_replace(w, r"(?<=\w{2})([bdfgmnprt])\1(?:ing|ed)$", "$1"))
    return F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(w, "(?<=\\w{3})(?:ies)$", "y"), "(?<=\\w{3})(?:ing|ed|es|s)$", ""))


def full_text(rows: DataFrame, text: str, query: str, *, any_term: bool = False) -> DataFrame:
    """Rows whose text has all (or any) of the query's terms, with the number of them as rank. ``-word`` excludes."""
    wanted = [w for w in query.split() if not w.startswith("-")]
    banned = [w[1:] for w in query.split() if w.startswith("-") and len(w) > 1]
    have = terms(F.col(text))
    stem = lambda ws: F.array_distinct(terms(F.lit(" ".join(ws))))
    hits = F.size(F.array_intersect(have, stem(wanted)))
    ok = hits > 0 if any_term else hits == F.size(stem(wanted))
    if banned:
        ok = ok & (F.size(F.array_intersect(have, stem(banned))) == 0)
    return rows.where(ok).withColumn("rank", hits.cast("bigint"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; null if one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(rows: DataFrame, vector: str, query: list[float], k: int, id_col: str) -> DataFrame:
    """The k rows whose vectors are most similar to one query vector, by an exact scan and a top-k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("similarity", cosine(F.col(vector), q)).orderBy(F.desc("similarity"), id_col).limit(k)


def nearest_of_each(rows: DataFrame, vector: str, queries: DataFrame, k: int, id_col: str) -> DataFrame:
    """(query, id, similarity): for each of queries the k rows whose vectors are most similar, by an exact scan.

    Blocks of about CELL queries meet blocks of about 8 * CELL rows; each meeting keeps k rows of each query, then these are
    merged. Similarities are compared to 12 digits, equal ones by id; null ones (zero or no vector) come last.
    """
    from pyspark.sql import Window

    def dealt(df: DataFrame, size: int) -> tuple[DataFrame, int]:
        n = max(1, -(-df.count() // size))
        return df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int").alias("own")), n

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    (q, nq), (r, nr) = dealt(queries, CELL), dealt(rows, 8 * CELL)
    q, r = q.select("id", "v", F.col("own").alias("i"), every(nr).alias("j")), r.select("id", "v", every(nq).alias("i"), F.col("own").alias("j"))

    def unit(vs: pd.Series) -> np.ndarray:
        dims = max((len(v) for v in vs if v is not None), default=0)
        m = np.array([v if v is not None and len(v) == dims else np.full(dims, np.nan) for v in vs], dtype="float64").reshape(len(vs), dims)
        norm = np.sqrt((m**2).sum(1, keepdims=True))
        return np.divide(m, norm, out=np.full_like(m, np.nan), where=norm > 0)

    def met(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "id": [], "similarity": []}
        if len(x) and len(y):
            y = y.sort_values("id")
            s = np.round(unit(x["v"]) @ unit(y["v"]).T, 12)
            ids = y["id"].to_numpy()
            for name, line in zip(x["id"], s, strict=True):
                best = np.argsort(np.where(np.isnan(line), np.inf, -line), kind="stable")[:k]
                out["query"] += [name] * len(best)
                out["id"] += ids[best].tolist()
                out["similarity"] += [None if np.isnan(z) else z for z in line[best]]
        return pd.DataFrame(out)

    kind = rows.schema[id_col].dataType.simpleString()
    found = q.groupBy("i", "j").cogroup(r.groupBy("i", "j")).applyInPandas(met, f"query {kind}, id {kind}, similarity double")
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc_nulls_last("similarity"), "id")))
    return best.where(F.col("n") <= k).drop("n")


def fused(rankings: list[tuple[DataFrame, float]], id_col: str, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of rankings (id, rank from 1), each with a weight."""
    parts = [r.select(id_col, (F.lit(w) / (k + F.col("rank"))).alias("part")) for r, w in rankings]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(id_col).agg(F.sum("part").alias("score"))


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """A deterministic vector of a text: signed counts of hashed terms."""
    t = terms(text)
    slot = lambda w: F.pmod(F.xxhash64(w), F.lit(dims))
    sign = lambda w: F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.aggregate(F.transform(t, lambda w: F.when(slot(w) == i, sign(w)).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v))


def blocked_pairs(rows: DataFrame, id_col: str, block: Column, *, window: int | None = None) -> DataFrame:
    """Candidate pairs (a, b): all of one block, or with ``window`` only those at most so many places apart in the order of ids.

    Blocks are salted, so that a large block is spread over tasks. All pairs grow with the square of a block's size: where
    blocks are large and the score is a similarity of tokens, ``similar_links`` proposes far fewer and loses none.
    """
    from pyspark.sql import Window

    keyed = rows.select(F.col(id_col).alias("id"), block.alias("k")).where("k is not null").distinct()
    if window is None:
        cells = F.ceil(F.col("m") / CELL)
        n = keyed.join(keyed.groupBy("k").agg(F.count("*").alias("m")), "k")
        a = n.select(F.col("id").alias("a"), "k", F.explode(F.sequence(F.lit(0).cast("bigint"), cells - 1)).alias("c"))
        b = n.select(F.col("id").alias("b"), "k", F.pmod(F.xxhash64("id"), cells).alias("c"))
        return a.join(b, ["k", "c"]).where("a < b").select("a", "b")
    n = keyed.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("id")))
    cell = F.floor(F.col("n") / window)
    a = n.select(F.col("id").alias("a"), "k", F.col("n").alias("na"), F.explode(F.array(cell, cell + 1)).alias("c"))
    b = n.select(F.col("id").alias("b"), "k", F.col("n").alias("nb"), cell.alias("c"))
    return a.join(b, ["k", "c"]).where(f"na < nb and nb - na <= {window}").select("a", "b").distinct()


def block_links(rows: DataFrame, id_col: str, block: Column) -> DataFrame:
    """(a, b): each row of a block linked to the block's least id, for rows that agree by being in one block.

    Components are those of all pairs of each block, from one link a row.
    """
    keyed = rows.select(F.col(id_col).alias("id"), block.alias("k")).where("k is not null and id is not null").distinct()
    least = keyed.groupBy("k").agg(F.min("id").alias("a"))
    return keyed.hint("merge").join(least, "k").where("a <> id").select("a", F.col("id").alias("b"))


def similar_links(rows: DataFrame, id_col: str, block: Column, tokens: Column, percent: int) -> DataFrame:
    """(a, b, score): pairs of a block whose token sets have a Jaccard similarity of at least ``percent`` hundredths.

    Rows with equal sets are linked to the least id of them, which alone is compared with other sets; so components are those
    of all pairs. Two sets that are similar enough share one of their rarest tokens (prefix filter), hence none is lost. Empty
    sets are similar to nothing.
    """
    keyed = rows.select(F.col(id_col).alias("id"), block.alias("k"), F.array_sort(F.array_distinct(F.array_compact(tokens))).alias("t")).where("k is not null and size(t) > 0").distinct()
    sets = written(keyed.groupBy("k", "t").agg(F.min("id").alias("id")))
    equal = keyed.join(sets.withColumnRenamed("id", "a"), ["k", "t"]).where("a <> id").select("a", F.col("id").alias("b"), F.lit(1.0).alias("score"))
    each = sets.select("k", "id", F.explode("t").alias("w"))
    ranked = each.join(each.groupBy("k", "w").agg(F.count("*").alias("f")), ["k", "w"])
    ordered = ranked.groupBy("k", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "w"))), lambda x: x["w"]).alias("t"))
    n = F.size("t")
    # n - ceil(n * percent / 100) + 1 in whole numbers
    ordered = written(ordered.withColumn("head", F.slice("t", 1, n - F.floor((n * percent + 99) / F.lit(100)).cast("int") + 1)))
    heads = ordered.select("k", "id", F.explode("head").alias("w"), F.size("t").alias("n"))
    a, b = (heads.select("k", "w", F.col("id").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    pairs = a.join(b, ["k", "w"]).where(f"a < b and 100 * least(na, nb) >= {percent} * greatest(na, nb)").select("k", "a", "b").distinct()
    for x in "ab":
        pairs = pairs.join(ordered.select("k", F.col("id").alias(x), F.col("t").alias(f"t{x}")), ["k", x])
    both, either = F.size(F.array_intersect("ta", "tb")), F.size(F.array_union("ta", "tb"))
    return equal.unionByName(pairs.where(both * 100 >= either * percent).select("a", "b", (both / either).alias("score")))


def resolve(pairs: DataFrame, score: Column, threshold: float) -> DataFrame:
    """(node, component) of the pairs (a, b, ...) that reach the threshold."""
    return components(pairs.where(score >= threshold).select(F.col("a").alias("s"), F.col("b").alias("o")))


def evaluated(found: DataFrame, gold: DataFrame, candidates: DataFrame | None = None, total_pairs: int | None = None) -> DataFrame:
    """Pairwise and B-cubed precision, recall and F1 of clusters (node, component) against gold, over the nodes of both.

    Counted from the sizes of clusters and of what two have in common, without any pairs. Of candidates (a, b), if given, also
    how many of the gold pairs they hold and by how much they reduce the total.
    """
    cells = found.withColumnRenamed("component", "f").join(gold.withColumnRenamed("component", "g"), "node").groupBy("f", "g").agg(F.count("*").alias("n"))
    of = lambda c: cells.groupBy(c).agg(F.sum("n").alias("size_" + c))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    nf, ng = of("f").agg(pairs("size_f")).first()[0] or 0.0, of("g").agg(pairs("size_g")).first()[0] or 0.0
    n2 = F.col("n") * F.col("n")
    row = cells.join(of("f"), "f").join(of("g"), "g").agg(pairs("n").alias("tp"), F.sum("n").alias("n"), F.sum(n2 / F.col("size_f")).alias("bp"), F.sum(n2 / F.col("size_g")).alias("br")).first()
    score = lambda name, p, r: {name + "precision": p, name + "recall": r, name + "f1": 2 * p * r / (p + r) if p + r else 0.0}
    tp = row.tp or 0.0
    out = score("", tp / nf if nf else 0.0, tp / ng if ng else 0.0)
    out |= score("b3_", row.bp / row.n if row.n else 0.0, row.br / row.n if row.n else 0.0)
    if candidates is not None:
        side = lambda c: gold.select(F.col("node").alias(c), F.col("component").alias("__" + c))
        held = candidates.select("a", "b").join(side("a"), "a").join(side("b"), "b").where("__a = __b").count()
        out["pair_completeness"] = held / ng if ng else 0.0
        out["reduction"] = 1 - candidates.count() / total_pairs if total_pairs else 0.0
    return found.sparkSession.createDataFrame([out])


@lru_cache(maxsize=1 << 16)
def _gram_bits(gram: str, key: bytes, hashes: int, bits: int) -> int:
    """The bits of one bigram, as a number whose bytes are the filter's in little-endian order."""
    d = hmac.new(key, gram.encode(), hashlib.sha256).digest()
    a, b = int.from_bytes(d[:8], "big"), int.from_bytes(d[8:16], "big") | 1
    out = 0
    for i in range(hashes):
        out |= 1 << ((a + i * b) % bits)
    return out


def bloom(value: str, key: bytes, hashes: int = 20, bits: int = 1024) -> str:
    """A cryptographic long-term key: the bigrams of a value in a keyed Bloom filter, in hexadecimal."""
    out = 0
    padded = f"_{value.lower()}_"
    for g in {padded[i : i + 2] for i in range(len(padded) - 1)}:
        out |= _gram_bits(g, key, hashes, bits)
    return out.to_bytes(bits // 8, "little").hex()


def bloom_encoded(column: Column, key: bytes, hashes: int = 20, bits: int = 1024) -> Column:
    @F.pandas_udf("string")
    def f(v: pd.Series) -> pd.Series:
        seen: dict[str, str] = {}  # of one batch
        return v.map(lambda x: None if x is None else seen.get(x) or seen.setdefault(x, bloom(x, key, hashes, bits)))

    return f(column)


def bayes(prior: Column, ratio: Column) -> Column:
    """Posterior probability after evidence with a likelihood ratio."""
    odds = prior / (1 - prior) * ratio
    return F.when(prior >= 1, 1.0).otherwise(odds / (1 + odds))


def noisy_count(rows: DataFrame, epsilon: float, by: list[str] | None = None, seed: int | None = None) -> DataFrame:
    """Counts with Laplace noise of scale 1 / epsilon, not below 0."""
    n = rows.groupBy(*(by or [])).agg(F.count("*").alias("n"))
    u = (F.rand(seed) if seed is not None else F.rand()) - 0.5
    return n.withColumn("n", F.greatest(F.lit(0.0), F.col("n") - F.signum(u) * F.log(1 - 2 * F.abs(u) + 1e-300) / epsilon))


def transe(triples: pd.DataFrame, dims: int = 32, epochs: int = 50, rate: float = 0.05, margin: float = 1.0, seed: int = 0) -> tuple[dict, dict]:
    """Entity and relation vectors (h + r close to t) by margin SGD in numpy over one bounded batch of triples (h, r, t)."""
    rng = np.random.default_rng(seed)
    ents = {x: i for i, x in enumerate(pd.unique(pd.concat([triples["h"], triples["t"]])))}
    rels = {x: i for i, x in enumerate(pd.unique(triples["r"]))}
    e, r = rng.uniform(-0.5, 0.5, (len(ents), dims)), rng.uniform(-0.5, 0.5, (len(rels), dims))
    h, q, t = triples["h"].map(ents).to_numpy(), triples["r"].map(rels).to_numpy(), triples["t"].map(ents).to_numpy()
    for _ in range(epochs):
        e /= np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-9)
        bad = rng.integers(0, len(ents), len(t))
        good, wrong = e[h] + r[q] - e[t], e[h] + r[q] - e[bad]
        act = (margin + (good**2).sum(1) - (wrong**2).sum(1) > 0)[:, None]
        g, w = 2 * rate * good * act, 2 * rate * wrong * act
        np.add.at(e, h, w - g)
        np.add.at(r, q, w - g)
        np.add.at(e, t, g)
        np.add.at(e, bad, -w)
    return {k: e[i] for k, i in ents.items()}, {k: r[i] for k, i in rels.items()}


def mined_rules(quads: DataFrame, min_support: int = 10, min_confidence: float = 0.5) -> DataFrame:
    """(body, head, support, confidence): predicates that go with others on the same subject and object."""
    e = quads.select("s", "p", "o").distinct()
    size = e.groupBy("p").agg(F.count("*").alias("n"))
    both = e.withColumnRenamed("p", "body").join(e.withColumnRenamed("p", "head"), ["s", "o"]).where("body <> head")
    n = both.groupBy("body", "head").agg(F.count("*").alias("support"))
    out = n.join(size.withColumnRenamed("p", "body"), "body").withColumn("confidence", F.col("support") / F.col("n"))
    return out.where((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence)).select("body", "head", "support", "confidence")
