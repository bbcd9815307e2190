"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

A document's features are the distinct words it holds. One weight for each word is shared by all thresholds:
``P(grade >= k) = sigmoid(w . x - t_k)`` with ordered thresholds ``t_1 < t_2 < ...``; the expected severity is the sum of
these probabilities over k. Words are kept if enough labelled documents hold them and if they tell grades apart.

Words are learned from a bounded sample: up to ``per_grade`` labelled documents of each grade, chosen by a hash of their
ids; rows are weighted by what their grade has in the whole label table. Scoring reads whole texts.

Null and empty texts have no features and get the severity that the thresholds alone give. Labels with null grades and ids
are left out; if nothing is labelled, severity is 0. Repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .frames import append

MIN_DOCS, WORDS, GRADES = 5, 2000, 64
FIELDS = T.StructType([T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())])


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct words of each row."""
    rows, _, _, h = K.words(data, offsets, K.alnum(True))
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (rows[1:] != rows[:-1]))) if len(h) else np.zeros(0, bool)
    return rows[new], h[new]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def train(docs: list[np.ndarray], grades: np.ndarray, mass: np.ndarray, *, steps: int = 400, rate: float = 0.05, decay: float = 2e-4) -> Model:
    """Maximum likelihood with an L2 penalty, by Adam over the full sample. mass: weight of each document."""
    top = int(grades.max()) if len(grades) else 0
    if top == 0:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.full(1, 30.0))
    flat = np.concatenate(docs) if docs else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    vocab, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    high = np.bincount(inverse, (grades[row] > 0).astype(float), len(vocab))
    n, nh = len(docs), int((grades > 0).sum())
    expect = count * nh / n
    gain = (high - expect) ** 2 / np.maximum(expect * (1 - nh / n), 1e-9)
    gain[count < min(MIN_DOCS, max(2, nh // 4))] = 0
    chosen = np.sort(np.argsort(-gain, kind="stable")[:WORDS])
    chosen = chosen[gain[chosen] > 6.6]
    slot = np.full(len(vocab), -1)
    slot[chosen] = np.arange(len(chosen))
    s = slot[inverse]
    x = np.zeros((n, len(chosen)), np.float32)
    x[row[s >= 0], s[s >= 0]] = 1
    w = np.zeros(len(chosen), np.float64)
    # thresholds: the first one and the logarithms of the steps between them
    t = np.zeros(top)
    t[0] = 1.0
    moment = [np.zeros(len(w)), np.zeros(top), np.zeros(len(w)), np.zeros(top)]
    mass = mass / mass.sum()
    lower, upper = grades - 1, grades  # thresholds below and above the grade
    for step in range(1, steps + 1):
        cut = t[0] + np.concatenate(([0], np.cumsum(np.exp(t[1:]))))
        f = (x @ w.astype(np.float32)).astype(float)
        a = np.where(grades > 0, _sigmoid(f - cut[np.maximum(lower, 0)]), 1.0)  # P(y >= grade)
        b = np.where(grades < top, _sigmoid(f - cut[np.minimum(upper, top - 1)]), 0.0)  # P(y > grade)
        p = np.maximum(a - b, 1e-9)
        da, db = -mass / p * a * (1 - a), mass / p * b * (1 - b)
        gw = x.T @ (da + db).astype(np.float32) + decay * w
        gc = -np.bincount(np.maximum(lower, 0), np.where(grades > 0, da, 0), top) - np.bincount(np.minimum(upper, top - 1), np.where(grades < top, db, 0), top)
        gt = np.concatenate(([gc.sum()], np.cumsum(gc[::-1])[::-1][1:] * np.exp(t[1:])))
        for k, (v, g) in enumerate(((w, gw), (t, gt))):
            moment[k] += 0.1 * (g - moment[k])
            moment[k + 2] += 0.01 * (g * g - moment[k + 2])
            v -= rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(moment[k + 2] / (1 - 0.99**step)) + 1e-9)
    cut = t[0] + np.concatenate(([0], np.cumsum(np.exp(t[1:]))))
    return Model(vocab[chosen], w, cut)


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", grade: str = "grade", per_grade: int = 3000) -> Model:
    """Learns from the documents that labels (label_id, grade: 0, 1, ...) names; a label that is null or negative is none.

    The sample has about ``per_grade`` documents of each grade. A grade of GRADES or above is an error: its thresholds would
    have hardly any documents each.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(label_id).alias("k"), F.col(grade).cast("int").alias("g")).where("k is not null and g >= 0")
    sizes = {r.g: r["count"] for r in known.groupBy("g").count().limit(GRADES + 1).collect()}
    if max(sizes, default=0) >= GRADES:
        raise ValueError(f"a grade of {GRADES} or more")
    if not sizes:
        return train([], np.zeros(0, int), np.zeros(0))
    share = F.create_map(*[F.lit(v) for g, n in sizes.items() for v in (g, min(1.0, per_grade / n))])
    dice = F.pmod(F.xxhash64("k", F.lit("grade")), F.lit(1 << 30)) / (1 << 30)
    taken = known.where(dice < share[F.col("g")]).orderBy(dice).limit(2 * per_grade * len(sizes))
    schema = T.StructType([T.StructField("g", T.IntegerType()), T.StructField("w", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = K.column(batch, batch.schema.names[1])
            r, h = features(data, offsets)
            cut = np.searchsorted(r, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(h.view(np.int64)))], names=["g", "w"])

    rows = docs.join(F.broadcast(taken), F.col(doc_id) == F.col("k")).select("g", F.col(text).cast("string")).mapInArrow(run, schema).toArrow()
    grades = rows.column("g").to_numpy().astype(int)
    words = [np.asarray(x.values).view(np.uint64) for x in rows.column("w")]
    got = np.bincount(grades, minlength=GRADES)
    mass = np.asarray([sizes[g] / got[g] for g in grades.tolist()])
    return train(words, grades, mass)


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with severity (expected grade), grade (the most probable number of thresholds passed) and toxic (grade > 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        m = shared.value
        data, offsets, _ = K.column(batch, text)
        f = np.zeros(len(offsets) - 1)
        for a, b in K.chunks(offsets):
            rows, _, _, h = K.words(data, offsets[a : b + 1], K.alnum(True))
            at = K.in_sorted(h, m.words)
            pairs = np.unique(np.stack((rows[at >= 0], at[at >= 0])), axis=1)
            f[a:b] = np.bincount(pairs[0], m.weights[pairs[1]], b - a) if pairs.size else 0
        p = _sigmoid(f[:, None] - m.thresholds[None, :])
        grade = (p >= 0.5).sum(1)
        return [pa.array(p.sum(1)), pa.array(grade.astype(np.int32)), pa.array(grade > 0)]

    return append(docs, FIELDS, compute, keep)
