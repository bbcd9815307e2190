"""Near-duplicate groups: SetSketch registers propose pairs, full shingle sets decide.

A document is its set of distinct word shingles (the whole text as one where it has fewer words). Documents with equal
sets form one class. Each class has a sketch of REGISTERS truncated, exponentially spaced minima: register i holds
``floor(1 - log_BASE(x))``, x the least of exponential variables drawn for the shingles by hash i, cut to [0, TOP]. Such
sketches merge by the maximum. Bands of ROWS registers put classes into groups; two classes at similarity s miss all
bands with probability (1 - s^6)^32: 6e-5 at 0.8 and 3e-7 at 0.85.

What a group proposes grows with its size, not with the square of it. A proposed pair is dropped before its sets are
compared if the two sizes rule a link out or if the joint maximum-likelihood estimate from the two sketches lies MARGIN
(over four standard errors) below the threshold.

* A group of up to ``small`` classes proposes all its pairs: at most ``small / 2`` for each member.
* A larger one compares each class with a centre: the class that most of its members meet in their largest groups. Groups
  with one centre are looked at as one. Links so far give components, and pairs within one component need no test.
* Where members are still apart, each is told by its difference from the centre: r of the centre's c shingles are gone and
  a are added. Two members are linked exactly if ``(100 + percent) * |common part of their differences|`` reaches
  ``w + w' - (100 - percent) * c`` with ``w = 100 r + percent * a``. So members whose edits have little in common need no
  comparison: an exact prefix filter on the differences, rarest first, gives the pairs left. A pair that meets in several
  centres' groups is tested in that of its home, if it has one home.

Only verified links are kept; components are found by union-find in blocks and alternating stars. Nothing of the documents is
collected: the driver gets counts, a filter of at most FILTER_BITS bits that keeps shingle sets of documents without partner
off the shuffle, and a table of COUNTERS counters that only puts shingles in order. If these fill up, more rows are shuffled
and the result is the same. Joins on a hot group have one row a key on their other side, so that AQE can split them.

Texts that are null or have no word are linked with nothing and are kept. A null id takes part in no group, has a null
component and is kept. Rows that repeat
an id are one document: what their different texts are linked with is one group. Whole texts are used, however long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .components import components
from .frames import dropped, gathered, written

REGISTERS, ROWS = 192, 6
BASE, TOP = 1.02, 65534
SMALL = 16
MARGIN = 0.12
FILTER_BITS = 1 << 28
COUNTERS = 1 << 20

_rng = np.random.default_rng(41)
_XOR = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_ODD = _rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BAND = _rng.integers(0, 1 << 63, (REGISTERS // ROWS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Rule:
    """Link two documents if 100 * |intersection| >= percent * |union| of their sets of ``words``-word shingles."""

    words: int = 5
    percent: int = 80


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles, rows in order."""
    rows, _, _, h = K.words(data, offsets, K.spaced(True))
    g, place = K.grams(h, rows, k)
    r = rows[place]
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    for n in range(1, k):
        short = np.flatnonzero(counts == n)
        if len(short):
            first = np.searchsorted(rows, short)
            whole = np.zeros(len(short), np.uint64)
            for j in range(n):
                whole += h[first + j] * K._GRAM[j]
            g, r = np.concatenate((g, K.mix(whole + np.uint64(n)))), np.concatenate((r, short))
    if len(g):
        order = np.lexsort((g, r))
        g, r = g[order], r[order]
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (r[1:] != r[:-1])))
        g, r = g[new], r[new]
    return r, g


def sketch(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Registers (uint16) of the non-empty sets that start at ``first`` in g."""
    out = np.empty((len(first), REGISTERS), np.uint32)
    low = (g & np.uint64(0xFFFFFFFF)).astype(np.uint32) ^ (g >> np.uint64(32)).astype(np.uint32)
    for i in range(REGISTERS):
        v = (low ^ _XOR[i]) * _ODD[i]
        out[:, i] = np.minimum.reduceat(v ^ (v >> np.uint32(15)), first)
    x = -np.log1p(-(out + 0.5) / 4294967296.0)
    return np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, TOP).astype("<u2")


def bands(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each sketch."""
    parts = registers.reshape(len(registers), -1, ROWS).astype(np.uint64)
    key = np.zeros(parts.shape[:2], np.uint64)
    for j in range(ROWS):
        key = K.mix(key ^ ((parts[:, :, j] + np.uint64(1)) * _BAND[:, j]))
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarity of pairs of sketches that maximises the joint likelihood of their registers' order, sizes given."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    j = np.minimum(u / v, v / u) * np.linspace(0, 1, 101)[None, :]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    like = more * log(up) + less * log(down) + same * log(1 - up - down)
    return np.take_along_axis(j, like.argmax(1)[:, None], 1)[:, 0]



def digests(rows: np.ndarray, g: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two 64-bit digests of the set of each of n rows."""
    size = np.bincount(rows, minlength=n)
    full = np.flatnonzero(size)
    h = np.zeros((2, n), np.uint64)
    if len(full):
        first = np.concatenate(([0], np.cumsum(size[full])[:-1]))
        h[0, full] = np.add.reduceat(K.mix(g), first)
        h[1, full] = np.add.reduceat(K.mix(g ^ np.uint64(0x9E3779B97F4A7C15)), first)
    return size, h[0].view(np.int64), h[1].view(np.int64)


def signatures(docs: DataFrame, rule: Rule, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n, h1, h2 (of the set), sketch and bands of each row; the last two are null for an empty set."""
    fields = [T.StructField("id", docs.schema[doc_id].dataType), T.StructField("n", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("sketch", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            data, offsets, _ = K.column(batch, batch.schema.names[1])
            for a, b in K.chunks(offsets):
                r, g = shingles(data, offsets[a : b + 1], rule.words)
                n, h1, h2 = digests(r, g, b - a)
                full = np.flatnonzero(n)
                sk: list = [None] * (b - a)
                ba: list = [None] * (b - a)
                if len(full):
                    regs = sketch(g, np.concatenate(([0], np.cumsum(n[full])[:-1])))
                    keys = bands(regs)
                    for i, x in enumerate(full.tolist()):
                        sk[x], ba[x] = regs[i].tobytes(), keys[i]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n, pa.int64()), pa.array(h1), pa.array(h2), pa.array(sk, pa.binary()), pa.array(ba, pa.list_(pa.int64()))], names=names)

    return docs.select(F.col(doc_id), F.col(text).cast("string")).mapInArrow(run, T.StructType(fields))


def _sets(docs: DataFrame, members: DataFrame, rule: Rule, doc_id: str, text: str) -> DataFrame:
    """cid and sorted shingle hashes of the classes in members (cid, id, h1, h2, n), each from a row of its document id."""
    spark = docs.sparkSession
    total = members.count()
    bits = min(FILTER_BITS, 1 << max(16, (16 * total).bit_length()))
    bucket = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(bits))
    rows = members.select(F.floor(bucket / 32768).alias("k"), (bucket % 32768).alias("x")).groupBy("k").agg(F.expr("bitmap_construct_agg(x)").alias("m")).collect()
    mask = np.zeros(bits // 8, np.uint8)
    for r in rows:
        mask[r.k * 4096 : (r.k + 1) * 4096] = np.frombuffer(bytes(r.m), np.uint8)
    shared = spark.sparkContext.broadcast(mask)
    names = ["id", "h1", "h2", "n", "items"]
    schema = T.StructType([T.StructField("id", docs.schema[doc_id].dataType), *[T.StructField(x, T.LongType()) for x in names[1:4]], T.StructField("items", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = shared.value
        for batch in batches:
            at = np.asarray(batch.column(2))
            want = np.flatnonzero((have[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            if not len(want):
                continue
            batch = batch.take(pa.array(want))
            data, offsets, _ = K.column(batch, batch.schema.names[1])
            for a, b in K.chunks(offsets):
                r, g = shingles(data, offsets[a : b + 1], rule.words)
                n, h1, h2 = digests(r, g, b - a)
                cut = np.concatenate(([0], np.cumsum(n)))
                raw = memoryview(g.astype("<u8").tobytes())
                sets = pa.array([raw[8 * x : 8 * y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(h1), pa.array(h2), pa.array(n, pa.int64()), sets], names=names)

    at = F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(bits))
    found = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id), F.col(text).cast("string"), at).mapInArrow(run, schema)
    once = found.groupBy("id", "h1", "h2", "n").agg(F.min("items").alias("items"))  # rows may repeat
    return once.join(members, ["id", "h1", "h2", "n"]).select("cid", "items")


def _likely(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Proposed pairs (a, b) whose sketches don't rule a link out."""
    left = classes.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = classes.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    schema = pairs.schema
    floor = rule.percent / 100 - MARGIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("sa", "sb")]
            near = estimate(*regs, *(np.asarray(batch.column(c)).astype(float) for c in ("na", "nb"))) >= floor
            yield batch.select([f.name for f in schema]).filter(pa.array(near))

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, schema)


def _linked(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that are linked."""
    schema = pairs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("xa"), batch.column("xb"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                shared = int((K.in_sorted(p, q) >= 0).sum())
                linked.append(100 * shared >= rule.percent * (len(p) + len(q) - shared))
            yield batch.select([f.name for f in schema]).filter(pa.array(linked, pa.bool_()))

    left = sets.select(F.col("cid").alias("a"), F.col("items").alias("xa"))
    right = sets.select(F.col("cid").alias("b"), F.col("items").alias("xb"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, schema)


def _fits(rule: Rule, a: str, b: str) -> str:
    return f"100 * least({a}, {b}) >= {rule.percent} * greatest({a}, {b})"


def _within(groups: DataFrame, rule: Rule) -> DataFrame:
    """All pairs (a, b) within groups (gid, cid, n) of few members."""
    few = groups.groupBy("gid").agg(F.collect_list(F.struct("cid", "n")).alias("m"))
    first = few.select(F.explode("m").alias("x"), "m").select("x", F.explode("m").alias("y"))
    return first.where(f"x.cid < y.cid and {_fits(rule, 'x.n', 'y.n')}").select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))


def _stars(large: DataFrame) -> DataFrame:
    """The distinct (centre, cid, size) of large groups (gid, cid, size); size is that of all the groups of the centre.

    First the centre of a group is its member that meets most others over all groups. Then each member has as its home the
    one of these that meets most, and the home of most members becomes the group's centre, be it a member or not.
    """
    met = large.groupBy("cid").agg(F.sum("size").alias("met"))
    first = large.join(met, "cid").groupBy("gid").agg(F.max(F.struct("met", "cid")).alias("top"))
    home = large.join(first, "gid").groupBy("cid").agg(F.max("top").alias("home"))
    most = large.join(home, "cid").groupBy("gid", "home").agg(F.count("*").alias("k")).groupBy("gid").agg(F.max(F.struct("k", "home")).alias("x"))
    of = large.join(most.select("gid", F.col("x.home.cid").alias("centre")), "gid").select("centre", "cid").distinct()
    size = of.groupBy("centre").agg(F.count("*").alias("size"))
    return of.where("cid <> centre").join(size, "centre")


def _differences(star: DataFrame, sets: DataFrame, found: DataFrame, rule: Rule) -> DataFrame:
    """What distinguishes members from their centre, for centres with members apart from it.

    centre, cid, c (component), out (whether it is apart from the centre), w, room (what two linked members' w may exceed
    their common part by), size, and the sorted shingles added and gone.
    """
    comp = found.select(F.col("node").alias("cid"), F.col("component").alias("c"))
    main = found.select(F.col("node").alias("centre"), F.col("component").alias("main"))
    named = star.join(comp, "cid", "left").join(main, "centre", "left").select("centre", "cid", "size", F.coalesce("c", "cid").alias("c"), F.coalesce("main", "centre").alias("main"))
    apart = named.groupBy("centre").agg(F.count("*").alias("k"), F.max(F.col("c") != F.col("main")).alias("any")).where("any and k > 1").select("centre")
    long = T.LongType()
    schema = T.StructType([T.StructField(x, long) for x in ("centre", "cid", "size", "c", "w", "room")] + [T.StructField("out", T.BooleanType())] + [T.StructField(x, T.BinaryType()) for x in ("added", "gone")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, room, added, gone = [], [], [], []
            for x, y in zip(batch.column("xa"), batch.column("xb"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                at = K.in_sorted(p, q)
                left = np.ones(len(q), bool)
                left[at[at >= 0]] = False
                more, less = p[at < 0], q[left]
                w.append(100 * len(less) + rule.percent * len(more))
                room.append((100 - rule.percent) * len(q))
                added.append(more.tobytes())
                gone.append(less.tobytes())
            w, room = np.asarray(w, np.int64), np.asarray(room, np.int64)
            main = np.asarray(batch.column("main"))
            c = np.where(w <= room, main, np.asarray(batch.column("c")))  # within reach of the centre, whatever the sketches said
            whole = [batch.column(x) for x in ("centre", "cid", "size")]
            yield pa.RecordBatch.from_arrays([*whole, pa.array(c), pa.array(w), pa.array(room), pa.array(c != main), pa.array(added, pa.binary()), pa.array(gone, pa.binary())], names=schema.names)

    left = sets.select("cid", F.col("items").alias("xa"))
    right = sets.select(F.col("cid").alias("centre"), F.col("items").alias("xb"))
    return named.join(apart, "centre", "left_semi").join(left, "cid").join(right, "centre").mapInArrow(run, schema)


def _places(centre: int, items: np.ndarray) -> np.ndarray:
    """The counter of each shingle of a centre."""
    return (K.mix(items ^ K.mix(np.asarray([centre], np.int64).view(np.uint64) + np.uint64(1))) & np.uint64(COUNTERS - 1)).astype(np.int64)


def _counters(diffs: DataFrame) -> np.ndarray:
    """How many members' differences have a shingle, by counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for centre, *both in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                for x in both:
                    np.add.at(total, _places(centre, np.frombuffer(x.as_buffer(), "<u8")), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["place", "k"])

    counted = diffs.select("centre", "added", "gone").mapInArrow(run, "place long, k long").groupBy("place").agg(F.sum("k").alias("k"))
    out = np.zeros(COUNTERS, np.int32)
    got = counted.toArrow()
    out[np.asarray(got.column("place"))] = np.minimum(np.asarray(got.column("k")), (1 << 31) - 1)
    return out


def _prefixes(diffs: DataFrame, rule: Rule) -> DataFrame:
    """Rows (key, centre, cid, c, out, both, w, room, home, a, r): linked members have a key in common.

    both: the key is for pairs of two members that are apart from their centre; else one is and the other is not.
    """
    counts = diffs.sparkSession.sparkContext.broadcast(_counters(diffs))
    home = diffs.groupBy("cid").agg(F.min(F.struct(F.floor(F.col("w") / (3 * F.greatest("room", F.lit(1)))).alias("far"), (-F.col("size")).alias("size"), "centre")).alias("x")).select("cid", F.col("x.centre").alias("home"))
    low = diffs.groupBy("centre").agg(F.min(F.when(F.col("out"), F.col("w"))).alias("low_out"), F.min(F.when(~F.col("out"), F.col("w"))).alias("low_in"))
    per = 100 + rule.percent
    keep = ["centre", "cid", "c", "w", "room", "home"]
    schema = T.StructType([T.StructField(x, T.LongType()) for x in ("key", *keep, "a", "r")] + [T.StructField(x, T.BooleanType()) for x in ("out", "both")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = counts.value
        for batch in batches:
            rows, keys, both, sizes = [], [], [], []
            cols = {x: batch.column(x).to_pylist() for x in ("centre", "w", "room", "out", "low_out", "low_in")}
            for i, (centre, w, room, out, low_out, low_in) in enumerate(zip(*cols.values(), strict=True)):
                added, gone = (np.frombuffer(batch.column(x)[i].as_buffer(), "<u8") for x in ("added", "gone"))
                sizes.append((len(added), len(gone)))
                items = np.concatenate((added, gone))
                often = have[_places(centre, items)]
                order = np.lexsort((items, often))
                for pair, low in ((True, low_out if out else None), (False, low_in if out else low_out)):
                    if low is None:
                        continue
                    need = max(1, -(-(w + low - room) // per))
                    first = order[: max(0, len(items) - need + 1)]
                    first = first[often[first] > 1]
                    if len(first):
                        rows.append(np.full(len(first), i))
                        keys.append(K.mix(items[first] + np.uint64(pair)))
                        both.append(np.full(len(first), pair))
            if not rows:
                continue
            at, sizes = np.concatenate(rows), np.asarray(sizes, np.int64)
            whole = batch.select(keep).take(pa.array(at)).columns
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *whole, pa.array(sizes[at, 0]), pa.array(sizes[at, 1]), batch.column("out").take(pa.array(at)), pa.array(np.concatenate(both))], names=schema.names)

    ready = diffs.join(home, "cid").join(low, "centre")
    # one home for all, elsewhere: nothing to do here
    here = ready.groupBy("centre").agg(F.min("home").alias("h1"), F.max("home").alias("h2")).where("h1 <> h2 or h1 = centre").select("centre")
    return ready.join(here, "centre", "left_semi").mapInArrow(run, schema)


def _meeting(listed: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (centre, a, b) of members that share a key and may be linked."""
    used = listed.groupBy("centre", "key").agg(F.max("both").alias("both"), F.sum(F.col("out").cast("int")).alias("o"), F.count("*").alias("k"), F.min("c").alias("c1"), F.max("c").alias("c2"))
    used = used.where("o > 0 and k > 1 and c1 <> c2 and (both or o < k)").select("centre", "key")
    rows = listed.join(used, ["centre", "key"], "left_semi")
    x = rows.where("out").select("centre", "key", *[F.col(c).alias("x_" + c) for c in ("cid", "c", "w", "home", "a", "r")])
    y = rows.select("centre", "key", "both", "out", "room", *[F.col(c).alias("y_" + c) for c in ("cid", "c", "w", "home", "a", "r")])
    enough = f"{100 + rule.percent} * (least(x_a, y_a) + least(x_r, y_r)) >= x_w + y_w - room"
    pairs = x.join(y, ["centre", "key"]).where(f"x_c <> y_c and ((both and x_cid < y_cid) or (not both and not out)) and (x_home <> y_home or x_home = centre) and {enough}")
    return pairs.select("centre", F.col("x_cid").alias("a"), F.col("y_cid").alias("b")).distinct()


def _close(pairs: DataFrame, diffs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose differences from their centre have enough in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            need = np.asarray(batch.column("wa")) + np.asarray(batch.column("wb")) - np.asarray(batch.column("room"))
            linked = []
            for p, q, r, s in zip(*(batch.column(x) for x in ("added_a", "added_b", "gone_a", "gone_b")), strict=True):
                p, q, r, s = (np.frombuffer(x.as_buffer(), "<u8") for x in (p, q, r, s))
                linked.append(int((K.in_sorted(p, q) >= 0).sum() + (K.in_sorted(r, s) >= 0).sum()))
            yield batch.select(["a", "b"]).filter(pa.array((100 + rule.percent) * np.asarray(linked, np.int64) >= need))

    left = diffs.select("centre", F.col("cid").alias("a"), F.col("w").alias("wa"), "room", F.col("added").alias("added_a"), F.col("gone").alias("gone_a"))
    right = diffs.select("centre", F.col("cid").alias("b"), F.col("w").alias("wb"), F.col("added").alias("added_b"), F.col("gone").alias("gone_b"))
    return pairs.join(left, ["centre", "a"]).join(right, ["centre", "b"]).mapInArrow(run, "a long, b long")


def _with_size(members: DataFrame) -> DataFrame:
    size = members.groupBy("gid").agg(F.count("*").alias("size")).where("size > 1")
    return members.join(size, "gid")


def _repeated(signed: DataFrame, cls: DataFrame) -> DataFrame:
    """(id, cid) of the ids whose rows have different sets; rows without words are left out, their ids are not."""
    ids = signed.where("id is not null").groupBy("id").agg(*[f(c).alias(f.__name__ + c) for c in ("h1", "h2", "n") for f in (F.min, F.max)])
    several = ids.where("minh1 <> maxh1 or minh2 <> maxh2 or minn <> maxn").select("id")
    rows = signed.where("n > 0").select("id", "h1", "h2", "n").join(several, "id", "left_semi")
    return rows.join(cls.select("h1", "h2", "n", "cid"), ["h1", "h2", "n"]).select("id", "cid").distinct()


def groups_of(docs: DataFrame, rule: Rule = Rule(), *, doc_id: str = "doc_id", text: str = "text", small: int = SMALL) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs. small: groups of up to so many classes propose all pairs."""
    signed = written(signatures(docs, rule, doc_id, text))
    least = signed.where("n > 0 and id is not null").groupBy("h1", "h2", "n").agg(F.min(F.struct("id", "sketch", "bands")).alias("x"))
    cls = gathered(least.select(F.monotonically_increasing_id().alias("cid"), "h1", "h2", "n", "x.*"))
    classes = cls.select("cid", "n", "sketch")
    groups = gathered(_with_size(cls.select("cid", "n", F.explode("bands").alias("gid")).distinct()))
    members = cls.select("cid", "id", "h1", "h2", "n").join(groups.select("cid").distinct(), "cid", "left_semi")
    sets = gathered(_sets(docs, members, rule, doc_id, text))
    repeated = gathered(_repeated(signed, cls))
    star = gathered(_stars(groups.where(f"size > {small}").select("gid", "cid", "size")))
    sizes = classes.select(F.col("cid"), "n")
    fitting = star.join(sizes, "cid").join(sizes.select(F.col("cid").alias("centre"), F.col("n").alias("nb")), "centre").where(_fits(rule, "n", "nb"))
    proposed = _within(groups.where(f"size <= {small}"), rule).unionByName(fitting.select(F.least("cid", "centre").alias("a"), F.greatest("cid", "centre").alias("b"))).distinct()
    likely = gathered(_likely(proposed, classes, rule))
    same = repeated.groupBy("id").agg(F.min("cid").alias("a")).join(repeated, "id").select("a", F.col("cid").alias("b"))
    found = gathered(components(_linked(likely, sets, rule).unionByName(same)))
    diffs = gathered(_differences(star, sets, found, rule))
    done = [groups, sets, star, likely, found, diffs]
    if not diffs.isEmpty():
        listed = gathered(_prefixes(diffs, rule))
        meeting = gathered(_meeting(listed, rule))
        done += [listed, meeting]
        more = _close(meeting, diffs, rule).unionByName(diffs.where("w <= room").select(F.col("centre").alias("a"), F.col("cid").alias("b")))
        found = gathered(components(more.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))))
        done.append(found)
    linked = found.withColumnRenamed("node", "cid").join(cls.select("cid", "h1", "h2", "n", "id"), "cid")
    first = linked.groupBy("component").agg(F.min("id").alias("least"))
    grouped = linked.join(first, "component").select("h1", "h2", "n", "cid", "least")
    alone = cls.select("cid", "h1", "h2", "n", F.col("id").alias("least")).join(found.select(F.col("node").alias("cid")), "cid", "left_anti")
    named = gathered(grouped.unionByName(alone))
    for x in done:
        dropped(x)
    out = signed.select("id", "n", "h1", "h2").join(named.select("h1", "h2", "n", "least"), ["h1", "h2", "n"], "left")
    if not repeated.isEmpty():
        by_id = repeated.join(named.select("cid", "least"), "cid").groupBy("id").agg(F.min("least").alias("joint"))
        out = out.join(by_id, "id", "left").withColumn("least", F.coalesce("least", "joint"))
    own = F.when(F.col("id").isNotNull(), F.coalesce("least", "id"))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(own == F.col("id"), F.lit(True)).alias("kept"))
