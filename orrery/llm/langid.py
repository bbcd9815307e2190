"""Language identification with a bidirectional gated recurrent network over bytes.

The network (two GRUs of HIDDEN units, one for each direction, over a learned row of gate inputs for each byte) is trained
here in numpy by backpropagation through time on windows of WIDTH bytes: every position of a window is labelled with its
document's language. Whole texts are read as consecutive windows; each position gets label probabilities from both
directions, and a document's probabilities are their mean over its letter bytes.

The training sample is bounded: up to ``per_language`` documents of each of at most ``languages`` languages (more are an
error, none is left out), chosen by a hash of their ids, and up to WINDOWS windows of each, at hashed places. Its size doesn't grow with the corpus.

A text that is null or has no letter is ``und`` with score 0. Null ids and labels are never learned from. Repeated rows
get equal predictions. If no row can be learned from, every text is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .frames import append

HIDDEN, WIDTH = 8, 64
WINDOWS = 4
FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True


@dataclass
class Model:
    """x: byte to gate inputs [2][3H, 256]; u, b: recurrent weights [2][3H, H] and biases [2][3H, 1]; o, c: output [L, 2H], [L, 1]."""

    languages: list[str]
    x: np.ndarray
    u: np.ndarray
    b: np.ndarray
    o: np.ndarray
    c: np.ndarray


def _run(m: Model, d: int, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States [T, H, N] of direction d (1: from the end) over codes [T, N]."""
    h = np.zeros((HIDDEN, codes.shape[1]), np.float32)
    out = np.empty((codes.shape[0], HIDDEN, codes.shape[1]), np.float32)
    table, u, b = m.x[d], m.u[d], m.b[d]
    two = 2 * HIDDEN
    for t in range(codes.shape[0])[:: -1 if d else 1]:
        a = table.take(codes[t], axis=1)
        g = u @ h
        g += b
        zr = a[:two]
        zr += g[:two]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        z, r = zr[:HIDDEN], zr[HIDDEN:]
        n = g[two:] * r
        n += a[two:]
        np.tanh(n, out=n)
        if keep is not None:
            keep.append((t, h, z, r, n, g[two:]))
        h = n + z * (h - n)
        out[t] = h
    return out


def _softmax(y: np.ndarray) -> np.ndarray:
    y -= y.max(-2, keepdims=True)
    np.exp(y, out=y)
    y /= y.sum(-2, keepdims=True)
    return y


def positions(m: Model, codes: np.ndarray) -> np.ndarray:
    """Label probabilities [T, L, N] of every position of the windows codes [T, N]."""
    h = np.concatenate((_run(m, 0, codes), _run(m, 1, codes)), 1)
    return _softmax(np.matmul(m.o, h) + m.c)


def _gradients(m: Model, codes: np.ndarray, mask: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean cross entropy over the masked positions, in the order x, u, b, o, c."""
    kept: list[list] = [[], []]
    h = np.concatenate([_run(m, d, codes, kept[d]) for d in (0, 1)], 1)
    dy = _softmax(np.matmul(m.o, h) + m.c)
    dy[:, label, np.arange(codes.shape[1])] -= 1
    dy *= mask[:, None, :] / max(1, mask.sum())
    do = np.einsum("tln,thn->lh", dy, h, optimize=True)
    dh_all = np.matmul(m.o.T, dy)
    dx, du, db = np.zeros_like(m.x), np.zeros_like(m.u), np.zeros_like(m.b)
    for d in (0, 1):
        back = np.zeros((HIDDEN, codes.shape[1]), np.float32)
        inputs = np.empty((codes.shape[0], 3 * HIDDEN, codes.shape[1]), np.float32)
        for t, prev, z, r, n, gn in reversed(kept[d]):
            dh = dh_all[t, d * HIDDEN : (d + 1) * HIDDEN] + back
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (prev - n) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            dg = np.concatenate((dz, dr, dn * r))
            inputs[t] = np.concatenate((dz, dr, dn))
            du[d] += dg @ prev.T
            db[d] += dg.sum(1, keepdims=True)
            back = dh * z + m.u[d].T @ dg
        flat = codes.ravel()
        for k in range(3 * HIDDEN):
            dx[d, k] = np.bincount(flat, inputs[:, k].ravel(), 256)
    return [dx, du, db, do.astype(np.float32), dy.sum((0, 2))[:, None]]


def train(windows: list[bytes], labels: list[str], *, epochs: int = 14, batch: int = 128, rate: float = 0.02, seed: int = 5) -> Model:
    """Fits the network to windows of at most WIDTH bytes. Languages weigh equally."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    draw = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
    m = Model(languages, draw(2, 3 * HIDDEN, 256), draw(2, 3 * HIDDEN, HIDDEN), np.zeros((2, 3 * HIDDEN, 1), np.float32), draw(len(languages), 2 * HIDDEN), np.zeros((len(languages), 1), np.float32))
    codes, mask = np.zeros((WIDTH, len(windows)), np.uint8), np.zeros((WIDTH, len(windows)), np.float32)
    for i, w in enumerate(windows):
        raw = np.frombuffer(w[:WIDTH], np.uint8)
        codes[: len(raw), i], mask[: len(raw), i] = raw, 1
    label = np.asarray([languages.index(x) for x in labels])
    share = np.bincount(label, minlength=len(languages))
    mask *= (len(label) / (len(languages) * share[label])).astype(np.float32)
    weights = [m.x, m.u, m.b, m.o, m.c]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    rounds = epochs * -(-len(windows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for a in range(0, len(order), batch):
            at = order[a : a + batch]
            step += 1
            now = rate * (1 - 0.9 * step / rounds)
            for w, g, p, q in zip(weights, _gradients(m, codes[:, at], mask[:, at], label[at]), first, second, strict=True):
                p += 0.1 * (g - p)
                q += 0.01 * (g * g - q)
                w -= now * (p / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-8)
    return m


def pooled(m: Model, data: np.ndarray, offsets: np.ndarray, block: int = 2048) -> np.ndarray:
    """Mean label probabilities [rows, L] over the letter bytes of each text; zero without any."""
    n, size = len(offsets) - 1, np.diff(offsets)
    count = -(-size // WIDTH)
    row = np.repeat(np.arange(n), count)
    start = offsets[row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * WIDTH
    total, letters = np.zeros((n, len(m.languages))), np.zeros(n)
    base = int(offsets[0])
    padded = np.concatenate((data[base : int(offsets[-1])], np.zeros(WIDTH, np.uint8)))
    for a in range(0, len(row), block):
        s, r = start[a : a + block], row[a : a + block]
        at = s[None, :] + np.arange(WIDTH)[:, None]
        inside = at < offsets[r + 1][None, :]
        codes = padded[at - base]
        codes[~inside] = 0
        mask = _LETTER[codes]
        p = np.einsum("tln,tn->ln", positions(m, codes), mask.astype(np.float32))
        first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        total[r[first]] += np.add.reduceat(p, first, axis=1).T
        letters[r[first]] += np.add.reduceat(mask.sum(0), first)
    return total / np.maximum(letters, 1)[:, None]


def _sample(docs: DataFrame, usable: Column, doc_id: str, text: str, lang: str, per_language: int, languages: int) -> tuple[list[bytes], list[str]]:
    known = docs.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = known.groupBy(F.col(lang).alias("l")).count().orderBy(F.desc("count"), "l").limit(languages + 1).collect()
    if len(sizes) > languages:
        raise ValueError(f"more than {languages} languages")
    if not sizes:
        return [], []
    share = F.create_map(*[F.lit(v) for r in sizes for v in (r.l, min(1.0, 2.0 * per_language / r["count"]))])
    dice = F.pmod(F.xxhash64(F.col(doc_id), F.lit("sample")), F.lit(1 << 30)) / (1 << 30)
    place = lambda k: F.pmod(F.xxhash64(F.col(doc_id), F.lit(k)), F.greatest(F.length(text) - WIDTH, F.lit(1))) + 1
    cut = F.array(*[F.col(text).substr(place(k).cast("int"), F.lit(WIDTH)) for k in range(WINDOWS)])
    rows = known.where(dice < share[F.col(lang)]).select(F.col(lang).alias("l"), dice.alias("d"), cut.alias("w")).orderBy("d").limit(4 * per_language * len(sizes)).collect()
    taken: dict[str, int] = {}
    windows, labels = [], []
    for r in rows:
        if taken.setdefault(r.l, 0) < per_language:
            taken[r.l] += 1
            for w in dict.fromkeys(r.w):  # the order of a set differs from run to run
                raw = w.encode()
                if raw and _LETTER[np.frombuffer(raw, np.uint8)].any():
                    windows.append(raw)
                    labels.append(r.l)
    return windows, labels


def fit(docs: DataFrame, usable: Column, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 250, languages: int = 64) -> Model | None:
    """A model learned from a bounded sample of the rows of docs for which ``usable`` holds; None if there are none."""
    windows, labels = _sample(docs, usable, doc_id, text, lang, per_language, languages)
    return train(windows, labels) if windows else None


def identify(docs: DataFrame, model: Model | None, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        m = shared.value
        data, offsets, _ = K.column(batch, text)
        n = len(offsets) - 1
        lettered = np.zeros(n, bool)
        for a, b in K.chunks(offsets):  # counts take eight times the bytes that they are made from
            part = data[offsets[a] : offsets[b]]
            points = np.concatenate(([0], np.cumsum(_LETTER[part] & (part < 128), dtype=np.int64)))
            lettered[a:b] = np.diff(points[offsets[a : b + 1] - offsets[a]]) > 0
        col = batch.column(batch.schema.get_field_index(text))
        for i in np.flatnonzero(~lettered & (np.diff(offsets) > 0)).tolist():
            lettered[i] = any(c.isalpha() for c in col[i].as_py())
        if m is None:
            lettered[:] = False
        names, score = np.full(n, "und", object), np.zeros(n)
        if lettered.any():
            for a, b in K.chunks(offsets, 1 << 22):
                p = pooled(m, data, offsets[a : b + 1])
                best = p.argmax(1)
                top = np.clip(p[np.arange(b - a), best], 0, 1)
                here = lettered[a:b]
                score[a:b][here] = top[here]
                names[a:b][here] = np.asarray(m.languages, object)[best][here]
        return [pa.array(names, pa.string()), pa.array(score)]

    return append(docs, FIELDS, compute, keep)
