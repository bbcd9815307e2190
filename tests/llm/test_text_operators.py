"""Small tables against brute force, with the odd cases that each operator defines."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orrery.llm import decontamination, html, langid, neardup, packing, pii, quality, textkit, tokens, toxicity, urls
from orrery.llm.components import components
from orrery.llm.wordbpe import encoder

ODD = [None, "", " ", "\n\n", "a", "A b", "é ü 漢字 b", "x" * 9000, "word " * 3000, "Same line\nSame line\nother", "the quick brown fox jumps over the lazy dog again and again " * 3]
PATH = public_tokenizers.path("word_bpe_49k.json")


def docs_of(spark, texts, **more):
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


def spaced(t: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def alnum(t: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 5000, n))


# -- words
@pytest.mark.parametrize("block", [7, 64, 1 << 21])
def test_words_are_those_of_the_pattern(monkeypatch, block):
    monkeypatch.setattr(textkit, "BLOCK_BYTES", block)
    data, offsets, valid = textkit.column(pa.record_batch([pa.array(ODD)], ["t"]), "t")
    for table, brute in ((textkit.spaced(False), spaced), (textkit.alnum(True), alnum)):
        rows, s, e, h = textkit.words(data, offsets, table)
        raw = data.tobytes()
        got = [[] for _ in ODD]
        for r, a, b in zip(rows, s, e):
            got[r].append(raw[a:b].decode())
        want = [brute(t) for t in ODD]
        assert [[lower(w) if brute is alnum else w for w in g] for g in got] == want
        by_word = collections.defaultdict(set)
        for r, x in zip((w for g in want for w in g), h):
            by_word[r].add(int(x))
        assert all(len(v) == 1 for v in by_word.values()) and len({min(v) for v in by_word.values()}) == len(by_word)
    assert valid.tolist() == [t is not None for t in ODD]


# -- op 10
def brute_contamination(texts, items, n=10):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = alnum(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[k : k + n])].update([] if i is None else [str(i)])
    out = []
    for t in texts:
        w, hit, ids = alnum(t), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if (found := windows.get(tuple(w[k : k + m]))) is not None:
                    hit.update(range(k, k + m))
                    ids |= found
        out.append((len(w), len(hit), sorted(ids)))
    return out


@pytest.mark.parametrize("block_words,at_once", [(1, 100), (1, 2), (10**6, 4)])
def test_decontamination(spark, block_words, at_once):
    items = [(None, prose(11, 12)), (1, prose(1, 30)), (2, prose(2, 10)), (3, "tiny item"), (4, None), (5, "..."), (6, prose(1, 30)), (10, prose(4, 200))]
    texts = [*ODD, prose(11, 12), prose(1, 30), prose(1, 30), "x " + prose(1, 12) + " y", prose(2, 10).upper().replace(" ", " - "), prose(2, 9), "a Tiny, item!", prose(9, 500), prose(9, 40) + " " + prose(4, 60) + " " + prose(8, 50) + " " + prose(1, 30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(docs_of(spark, texts), bench, block_words=block_words, at_once=at_once).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.item_ids) for r in got] == brute_contamination(texts, items)
    assert all(r.n_hit == sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2])) for r in got)


def test_decontamination_of_nothing(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = docs_of(spark, ["a b", None]).withColumn("n_hit", F.lit("clash"))
    assert [r.n_hit for r in decontamination.decontaminate(docs, bench).collect()] == [0, 0]
    assert decontamination.decontaminate(docs.limit(0), bench).count() == 0


# -- op 9
def test_quality_base(spark):
    texts = [*ODD, prose(3, 60), prose(3, 20) + " " + prose(3, 20), "# * $ % & | < > " * 5, "a b\n\n c\na b\n \n \na b"]
    got = quality.repetition(docs_of(spark, texts)).orderBy("doc_id").collect()
    for t, r in zip(texts, got):
        w = spaced(t)
        count = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {j for k in range(len(w) - 4) if count[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if spaced(line):
                dup += line in seen
                seen.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(cover))
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and not (r.kept and r.base_failed)
        for n, chars in zip(quality.LIMITS, r.n_gram_chars):
            first, late = set(), set()
            for k in range(len(w) - n + 1):
                g = tuple(w[k : k + n])
                if g in first:
                    late.update(range(k, k + n))
                first.add(g)
            assert chars == sum(len(w[j]) for j in late)
    assert got[len(ODD)].kept


def test_quality_rejects_by_characters_what_the_base_keeps(spark):
    """Ten of 60 words are in repeated windows, which the base rule keeps, but they hold half of the characters."""
    long = " ".join(f"{c * 40}" for c in "abcde")
    short = prose(5, 50).replace("w", "")
    got = quality.repetition(docs_of(spark, [f"{long} {short} {long}", f"{short} end"])).orderBy("doc_id").collect()
    assert [(r.base_failed, r.kept) for r in got] == [(False, False), (False, True)]


# -- op 8
def test_encoding_is_the_library_s(spark):
    rng = np.random.default_rng(0)
    letters = list("abcdefghijklmnopqrstuvwxyzAEIOUéöüßñ' '  \n\t.,!?0123456789-_'—“\x85İ²ªሴ中")
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(3000)]
    texts += ["it's we'll 'surprise ''s .'s they've'd x'RE", "a<|endoftext|>b", "'", "''", "'s", "\x00 nul", *(t or "" for t in ODD)]
    texts += [f"a{chr(c)}b1{chr(c)}. {chr(c)}" for c in [*range(0x250), *range(0x2000, 0x2070)]]
    code, library = encoder(PATH), Tokenizer.from_file(PATH)
    ids, at = code.encode(texts)
    for i, e in enumerate(library.encode_batch_fast(texts, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == e.ids


def test_packing_keeps_every_token(spark):
    texts = [*ODD, prose(5, 900), prose(6, 3000), prose(7, 400), prose(7, 400), *(prose(50 + i, 30 * i) for i in range(30))]
    docs = docs_of(spark, texts)
    got = packing.pack_documents(docs, PATH).collect()
    library = Tokenizer.from_file(PATH)
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            part = ids[k * 2048 : (k + 1) * 2048]
            assert (r.piece, r.start, r.length, r.ids_crc32) == (k, k * 2048, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes()))
        assert len(by_doc[i]) == -(-len(ids) // 2048)
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_large_item_matching():
    rng = np.random.default_rng(3)
    sizes = np.concatenate((rng.integers(1, 2049, 4000), np.full(500, 2048), np.full(300, 683), np.ones(200, int)))
    seq, off = packing.match(sizes)
    fill = np.bincount(seq, sizes)
    assert fill.max() <= 2048 and len(fill) <= 1.02 * sizes.sum() / 2048 + 1 or len(fill) <= 1.01 * max(sizes.sum() / 2048, (sizes > 1024).sum())
    large = np.bincount(seq[sizes * 3 > 2048], minlength=len(fill))
    assert large.max() <= 2
    for s in range(0, len(fill), 97):
        at = np.flatnonzero(seq == s)
        at = at[np.argsort(off[at])]
        assert (off[at] == np.concatenate(([0], np.cumsum(sizes[at])[:-1]))).all()
    exact, _ = packing.match(np.asarray([1200, 848, 1000, 1048, 2048, 1500, 500, 48]))
    assert exact.max() + 1 == 4


# -- op 4
def brute_groups(texts, k, percent):
    sets = []
    for t in texts:
        w = spaced(lower(t or ""))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    comp = list(range(len(texts)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def edited(text: str, rng, share: float) -> str:
    return " ".join(f"e{rng.integers(1 << 40)}" if rng.random() < share else w for w in text.split())


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, words, percent):
    rng = np.random.default_rng(words)
    base, other = prose(21, 300), prose(22, 200)
    texts = [*ODD, base, other, base.upper(), other + " tail", "A b", "a"]
    texts += [edited(base, rng, s) for s in np.linspace(0, 0.12, 60)]  # a graded group
    variant = " ".join(base.split()[:240]) + " " + prose(23, 60)
    texts += [edited(variant, rng, 0.004) for _ in range(30)] + [base] * 5 + [edited(other, rng, 0.01) for _ in range(20)]
    texts += [prose(100 + i, 80) for i in range(40)]
    got = neardup.groups_of(docs_of(spark, texts).withColumn("n", F.lit(1)), neardup.Rule(words, percent)).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in got] == brute_groups(texts, words, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_in_large_groups(spark):
    """Groups that no centre holds together: a chain of versions, two families and texts that share a passage only."""
    rng = np.random.default_rng(77)
    chain = [prose(31, 150).split()]
    for i in range(40):
        chain.append(list(chain[-1]))
        for at in rng.integers(0, 150, 3):
            chain[-1][at] = f"c{i}x{at}"
    passage = prose(32, 100)
    texts = [" ".join(c) for c in chain] + [passage + " " + prose(200 + i, 60) for i in range(25)]
    for f in range(2):
        family = passage + " " + prose(33 + f, 22 + f)
        texts += [edited(family, rng, s) for s in np.linspace(0, 0.05, 12)]
    rng.shuffle(texts)
    want = brute_groups(texts, 3, 85)
    assert 20 < len({c for _, c in want}) < len(texts) - 20
    got = neardup.groups_of(docs_of(spark, texts), neardup.Rule(3, 85), small=3).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in got] == want


@pytest.mark.parametrize("block", [10, 500_000])
def test_components(spark, block):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (230, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000), (None, 1)]
    comp = {x: x for p in pairs for x in p}
    for _ in comp:
        for a, b in pairs:
            if a is not None:
                comp[a] = comp[b] = min(comp[a], comp[b])
    linked = {x for a, b in pairs if a is not None and a != b for x in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long"), block_edges=block).collect()}
    assert got == {x: comp[x] for x in linked}
    words = spark.createDataFrame([("b", "a"), ("c", "b"), ("é", "z")], "a string, b string")
    assert {tuple(r) for r in components(words, block_edges=block).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("z", "z"), ("é", "z")}


@pytest.mark.parametrize("kind", ["deleted", "cut", "shared"])
def test_near_duplicates_by_kinds_of_edits(spark, kind):
    """Large groups of words left out, of ends cut off and of edits that several texts share."""
    rng = np.random.default_rng(len(kind))
    base = prose(61, 160).split()
    texts = [" ".join(base)]
    for i in range(70):
        if kind == "deleted":
            texts.append(" ".join(w for w in base if rng.random() > 0.002 * i))
        elif kind == "cut":
            texts.append(" ".join(base[: 160 - 2 * i]))
        else:
            words = list(base)
            for at in rng.integers(0, 20, rng.integers(0, 12)):
                words[at * 7] = f"s{at}"
            texts.append(" ".join(words))
    got = neardup.groups_of(docs_of(spark, texts), neardup.Rule(3, 85), small=2).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in got] == brute_groups(texts, 3, 85)


def test_near_duplicates_with_repeated_ids(spark):
    """Rows of one id are one document, whose groups are joined; null ids are in no group."""
    a, b, c = prose(71, 60), prose(72, 60), prose(73, 60)
    rows = [(5, a), (5, b), (3, a), (7, b), (9, b + " tail"), (5, None), (5, a), (11, c), (11, ""), (12, c + " x"), (None, a), (None, None), (20, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.groups_of(docs, neardup.Rule(3, 85)).collect()
    assert len(got) == len(rows)
    want = {3: 3, 5: 3, 7: 3, 9: 3, 11: 11, 12: 11, 20: 20}
    assert all(r.component_id == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id]) for r in got if r.doc_id is not None)
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)


def test_near_duplicates_of_nothing(spark):
    assert neardup.groups_of(docs_of(spark, ["a"]).limit(0)).count() == 0
    rows = neardup.groups_of(docs_of(spark, [None, "", "  "])).collect()
    assert all(r.kept and r.n_shingles == 0 for r in rows)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(8)
    g = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)
    a, b = g[:3000], g[1000:]
    sk = [neardup.sketch(x, np.asarray([0]))[0] for x in (a, b, g)]
    assert (np.maximum(sk[0], sk[1]) == sk[2]).all()
    got = neardup.estimate(sk[0][None], sk[1][None], np.asarray([3000.0]), np.asarray([3000.0]))[0]
    assert abs(got - 0.5) < 0.15


# -- op 6
def test_language_id(spark):
    def say(alphabet, seed):
        rng = np.random.default_rng(seed)
        return " ".join("".join(rng.choice(list(alphabet), rng.integers(2, 8))) for _ in range(60))

    rows = [(i, say("aeiouklmnptz", i) if i % 2 else say("äöüßschngr", i), "xx" if i % 2 else "yy") for i in range(200)]
    odd = [(900, None, "xx"), (901, "", "yy"), (902, "123 456 !!", None), (903, "漢字", None), (None, "aeiou", "xx")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = langid.fit(docs, F.col("doc_id").isNotNull() & ~held, per_language=60)
    got = {r.doc_id: r for r in langid.identify(docs.withColumn("score", F.lit("x")), model).collect()}
    right = [got[i].lang_pred == lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean(right) > 0.95
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(docs.limit(0), F.lit(True))).collect()} == {"und"}


def test_gradients_are_right():
    rng = np.random.default_rng(1)
    m = langid.train([b"abc def", b"xyz"], ["p", "q"], epochs=1)
    for w in (m.x, m.u, m.b, m.o, m.c):
        w += rng.standard_normal(w.shape).astype(np.float32) * 0.1
    codes = rng.integers(97, 120, (6, 3)).astype(np.uint8)
    mask, label = np.ones((6, 3), np.float32), np.asarray([0, 1, 1])

    def loss():
        p = langid.positions(m, codes)
        return -np.mean(np.log(p[:, label, np.arange(3)]))

    grads = langid._gradients(m, codes, mask, label)
    for w, g in zip((m.u, m.b, m.o, m.c), (grads[1], grads[2], grads[3], grads[4])):
        at = np.unravel_index(int(np.abs(g).argmax()), g.shape)
        w[at] += 1e-2
        up = loss()
        w[at] -= 2e-2
        down = loss()
        w[at] += 1e-2
        assert abs((up - down) / 2e-2 - g[at]) < 0.05 * abs(g[at]) + 1e-3


# -- op 7
def test_toxicity(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(300):
        grade = i % 3
        words = [f"w{x}" for x in rng.integers(0, 400, 40)] + ["mild"] * (grade >= 1) + ["awful"] * (grade == 2)
        rows.append((i, " ".join(rng.permutation(words))))
        labels.append((i, grade))
    docs = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels + [(None, 1), (5000, None)], "doc_id long, grade int"))
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert np.mean([got[i].grade == g for i, g in labels]) > 0.95
    assert got[900].severity == got[901].severity < 0.5 and not got[900].toxic
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, grade int"))
    assert {r.toxic for r in toxicity.score(docs, none).collect()} == {False}


def test_nothing_is_left_out_silently(spark):
    docs = docs_of(spark, ["some text", "more text"]).withColumn("lang", F.col("doc_id").cast("string"))
    with pytest.raises(ValueError):
        langid.fit(docs, F.lit(True), languages=1)
    with pytest.raises(ValueError):
        toxicity.fit(docs, spark.createDataFrame([(0, 1), (1, toxicity.GRADES)], "doc_id long, grade int"))
    assert len(toxicity.fit(docs, spark.createDataFrame([(0, 0), (1, 9), (1, -1)], "doc_id long, grade int")).thresholds) == 9


# -- op 3
def test_surrogates(spark):
    key = b"k" * 16
    text = "Mail the.72@mail3.example.com or THE.72@mail3.example.com, ip 152.143.123.131### card 4111 1111 1111 1111, +1 (555) 123-4567%%% token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" Frau Anna Weber"
    docs = docs_of(spark, [text, "again the.72@mail3.example.com", None, "", "no data here 12 3.4"])
    got = pii.surrogates(docs, key).orderBy("doc_id").collect()
    kinds = [e.type for e in got[0].entities]
    assert kinds == ["EMAIL", "EMAIL", "IP", "CARD", "PHONE", "SECRET", "NAME"]
    assert all(e.value not in got[0].text and len(e.surrogate) >= 1 for e in got[0].entities)
    assert got[1].entities[0].surrogate == got[0].entities[0].surrogate == got[0].entities[1].surrogate
    assert got[2].text is None and got[3].text == "" and got[4].text == "no data here 12 3.4"
    card = next(e for e in got[0].entities if e.type == "CARD").surrogate
    assert pii.luhn(card.replace(" ", "")) and re.fullmatch(r"4\d{3} \d{4} \d{4} \d{4}", card)
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", next(e for e in got[0].entities if e.type == "PHONE").surrogate)
    assert next(e for e in got[0].entities if e.type == "NAME").surrogate.split()[0] in pii.FEMALE
    assert pii.audit(pii.surrogates(docs, key)).count() == 0
    assert pii.surrogates(docs, b"other" * 4).orderBy("doc_id").first().text != got[0].text


def test_surrogates_are_distinct():
    key = b"z" * 16
    for kind, values in {"IP": [f"10.0.{i % 256}.{i // 256}" for i in range(1500)], "PHONE": [f"555-01{i:02d}" for i in range(100)], "SECRET": [f"ab{i:04d}xy" for i in range(500)], "NAME:Herr": [f"{a} {b}" for a in pii.MALE for b in [*pii.LAST[:5], "Quux", "Zorn"]]}.items():
        new = [pii.surrogate(kind, v, key) for v in values]
        assert len(set(new)) == len(set(values)) and not any(a == b for a, b in zip(values, new))


def test_entities_and_their_spellings():
    key = b"q" * 16
    text, told = pii.redact("Mrs. Weber and Mrs. Anna Weber met Herr Zelda Quux und Dr. Quux", key)
    names = {v: s for k, _, v, s in told}
    assert list(names) == ["Weber", "Anna Weber", "Zelda Quux", "Quux"] and " and Mrs. " in text and " und Dr. " in text
    assert names["Anna Weber"].split()[1] == names["Weber"] and names["Zelda Quux"].split()[1] == names["Quux"]
    assert names["Zelda Quux"].split()[0][-1] == "a" and re.fullmatch("[A-Z][a-z]+", names["Quux"])
    local = lambda v: "".join(re.findall(r"\d", pii.surrogate("PHONE", v, key)))
    assert local("+351912345678") == local("+351 912345678") and local("0049 221 123456")[2:] == local("+49 221123456") and local("+1 (555) 123-4567") == local("+15551234567")
    v6 = "2001:db8:85a3::8a2e:370:7334"
    text, told = pii.redact(f"from {v6} at 12:34:56, std::vector and aa:bb:cc:dd:ee:ff", key)
    assert [(k, v) for k, _, v, _ in told] == [("IP6", v6)] and v6 not in text and len(told[0][3]) == len(v6) and "12:34:56" in text
    many = [f"2001:db8::{i:x}:1a{i % 16:x}" for i in range(1, 400)] + ["2001:0db8:0000:0000:0000:0000:0000:0001", "::1234:0", "fe80::1"]
    new = [pii.surrogate("IP6", v, key) for v in many]
    assert len(set(new)) == len(set(many)) and not set(zip(many, new)) & set(zip(many, many))
    words = [a + b for a in ("Qua", "Zor", "Bel") for b in ("xa", "nix", "lt", "mo", "e")]
    assert len({pii.surrogate("NAME:Frau", w, key) for w in words}) == len(words)


def test_entities_in_very_long_texts():
    run = "a" * 1_000_000
    for text in (run, run + "@", "@" * 100_000, "1" * 300_000, "a.b@" * 50_000, ":" * 100_000, "Mrs. " * 50_000):
        assert len(pii.redact(text, b"k" * 16)[0]) == len(text)
    assert [e[0] for e in pii.redact("g" * 1_000_000 + " x.y@host.org " + "g" * 1_000_000, b"k" * 16)[1]] == ["EMAIL"]


def test_surrogates_of_odd_tables(spark):
    docs = docs_of(spark, [None, "a@b.org", "a@b.org"]).withColumn("entities", F.lit("clash"))
    got = pii.surrogates(docs, b"k" * 16).orderBy("doc_id").collect()
    assert got[0].text is None and got[0].entities == [] and got[1].text == got[2].text != "a@b.org"
    assert pii.surrogates(docs.limit(0), b"k" * 16).count() == 0


# -- op 5
def test_gates_hide_no_entity(monkeypatch):
    phones = ["+33 6 12 34 56 78", "+45 12 34 56 78", "+47 22 85 50 50"]
    keys = ["skA1b2C3d4E5f6G7", "pkabcdefghijklmn", "ghp_ABcdEFghIJkl", "ab" * 16, "F" * 31 + "0"]
    bare = ["GB82 WEST 12AB 98CD 65", "10.0.0.1", "123-45-6789", "(0221) 1234 5678", "4111 1111 1111 1111", "a@b.org", "Mrs. Anna Weber", "ſecret=abc123", "paſsword: abc123", "2023", "sk", ""]
    texts = [f"{a}{x}{b}" for x in phones + keys + bare for a, b in (("", ""), ("call ", " now"), ("in 2023 ", "; token"))]
    gated = [pii.detect(t) for t in texts]
    for name in ("_NUMBER", "_KEY", "_LONG_HEX"):
        monkeypatch.setattr(pii, name, re.compile(""))
    monkeypatch.setattr(pii, "_TITLES", ("",))
    assert gated == [pii.detect(t) for t in texts]
    monkeypatch.undo()
    assert all([k for _, _, k in pii.detect(p)] == ["PHONE"] for p in phones)
    assert all([k for _, _, k in pii.detect(k)] == ["SECRET"] for k in keys)


def test_rollups(spark, tmp_path):
    rows = spark.createDataFrame([("a", "en", "v1", 10, 40), ("a", "en", "v1", 5, 20), (None, None, "v1", 1, 1)], "source string, lang string, tokenizer string, n_tokens long, n_chars long")
    store = tokens.Rollups(spark, f"file://{tmp_path}/store")
    assert store.totals().count() == 0
    assert store.commit("one", tokens.deltas(inserted=rows)) and not store.commit("one", tokens.deltas(inserted=rows))
    old = rows.where("n_tokens = 5")
    new = old.withColumn("n_tokens", F.lit(7)).withColumn("tokenizer", F.lit("v2"))
    store.commit("two", tokens.deltas(revised=(old, new), deleted=rows.where("source is null")))
    want = {("a", "en", "v1", 1, 10, 40), ("a", "en", "v2", 1, 7, 20)}
    assert {tuple(r) for r in store.totals().collect()} == want
    store.compact()
    assert not store.commit("two", tokens.deltas(inserted=rows))
    store.commit("three", tokens.deltas(inserted=old))
    store.compact()
    assert {tuple(r) for r in store.totals().collect()} == {("a", "en", "v1", 2, 15, 60), ("a", "en", "v2", 1, 7, 20)}


def test_token_counts(spark):
    library = Tokenizer.from_file(PATH)
    got = tokens.counted(docs_of(spark, ODD), PATH).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [len(library.encode(t or "", add_special_tokens=False).ids) for t in ODD]


# -- op 2
RULES = [urls.Rule("allow", "com", "/"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"), urls.Rule("block", "net", "/es/")]


def test_url_rules(spark):
    links = ["http://a.com", "http://A.COM/x?y#z", "https://b.example.com/en/1", "https://www.example.com/en/1", "http://x.www.example.com:80/en/", "http://x.net/es/", "http://x.net/ES/", "http://notcom/", "nonsense", None, "a://b://c/d", "http://com/", "http://example.com/en", "s://u\n/p\nq?r"]
    got = urls.judge(spark.createDataFrame(list(enumerate(links)), "page_id long, url string"), RULES).orderBy("page_id").collect()

    def brute(u):
        m = re.search(r"://", u or "")
        if not m:
            return "", "", None
        rest = u[m.end() :]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = lower(host)
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return host, path, max(fits, key=lambda r: len(r.name)).name if fits else None

    assert [(r.host, r.path, r.rule) for r in got] == [brute(u) for u in links]
    assert all(r.verdict == {x.name: x.verdict for x in RULES}.get(r.rule, "allow") for r in got)


def test_url_templates(spark):
    rows = [(f"http://h.org/spam/{i}", True if i % 2 else None) for i in range(40)] + [(f"http://h.org/good/{i}", False if i % 2 else None) for i in range(40)]
    rows += [(f"http://u.org/user/name{chr(97 + i % 26)}{i}x/home", None) for i in range(60)]
    got = urls.judge(spark.createDataFrame(rows, "url string, bad boolean"), [], bad=F.col("bad")).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r.template].add(r.verdict)
    assert by["/spam/*"] == {"block"} and by["/good/*"] == {"allow"} and by["/user/*/home"] == {"allow"}
    assert urls.judge(spark.createDataFrame([], "url string"), RULES).count() == 0


def test_url_labels_and_variables_with_extensions(spark, tmp_path):
    from orrery.llm.queries import bad_pages

    links = [f"http://h.org/x/{i}{end}" for i, end in enumerate(["", ".html", "/", ".html/", ".mp4", "-a.html"])]
    spark.createDataFrame(list(enumerate(links)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.page_id: r.bad for r in bad_pages(spark, str(tmp_path)).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: True, 5: None}
    found = {r.url: r.template for r in urls.judge(spark.createDataFrame([(x,) for x in links], "url string"), []).collect()}
    assert [found[x] for x in links] == ["/x/*"] * 5 + ["/x/5-a.html"]


def test_url_templates_of_deep_paths(spark):
    head = "http://h.org/a/b/c/d/e/f"
    rows = [(f"{head}/{side}/g/p{i}.x", side == "bad") for side in ("bad", "good") for i in range(30)] + [(f"{head}/alone/12/" + "z/" * 200, None)]
    got = urls.judge(spark.createDataFrame(rows, "url string, bad boolean"), [], bad=F.col("bad")).collect()
    assert len(got) == 61
    by = collections.defaultdict(set)
    for r in got:
        by[r.template].add((r.bad, r.verdict))
    assert by == {"/a/b/c/d/e/f/bad/g/*": {(True, "block")}, "/a/b/c/d/e/f/good/g/*": {(False, "allow")}, "/a/b/c/d/e/f/alone/*" + "/z" * 200: {(None, "allow")}}


def test_url_sketches_tell_large_nodes_apart(spark):
    rows = [("h", [f"p{k}", f"c{k}_{i}"], 1, 0, 0) for k in range(3) for i in range(900)]
    got = urls.templates(spark.createDataFrame(rows, "host string, segs array<string>, n long, good long, bad long"))
    assert {r.template for r in got.collect()} == {f"/p{k}/*" for k in range(3)}


# -- op 1
@pytest.mark.parametrize(
    "page,text",
    [
        ("<p>One<p>Two &amp; three", "One\n\nTwo & three"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>after", "- a\n- b\n  - c\n\nafter"),
        ("<ol start=3><li>x</li><li value=9>y</li><li>z</ol>", "3. x\n9. y\n10. z"),
        ("<table><tr><th>Name<th>N<tr><td>Long name<td>1<tr><td>b<td>22</table>", "Name       N\nLong name  1\nb          22"),
        ("<head><title>no</title></head><body>yes<script>var t='</p>'</script><style>p{}</style>", "yes"),
        ("a<span style='display: none'>b</span><i hidden>c</i><b>d</b>", "ad"),
        ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b></div>", "b"),
        ("<pre>a\n  b</pre>x", "a\n  b\n\nx"),
        ("one<br>two<div>three</div>four", "one\ntwo\nthree\nfour"),
        ("<details><summary>s</summary>hidden</details><details open><summary>t</summary>shown</details>", "s\nt\nshown"),
        ("<!-- x --><img alt='pic'> 1 < 2 </div></p>", "pic 1 < 2"),
        ("", ""),
        ("<p>" * 2000 + "deep", "deep"),
        ("<div>" * 3000 + "deep", "deep"),
        ("unclosed <b attr='x", "unclosed"),
    ],
)
def test_html(page, text):
    assert html.render(page) == text


def test_html_keeps_every_visible_text():
    pages = [
        "<table><tbody><form><tr><td>t1<td>t2</tr></form></tbody></table>t3",
        "<table><tbody>t1<tr><td>t2</td></tr><div>t3</div></tbody><tfoot><p>t4</p></tfoot>t5</table>",
        "<table><caption>t1</caption><thead><b>t2</b><tr>t3<th>t4</thead><form><tbody><tr><td>t5<table><tr><td>t6</table></form></table>",
        "<p>t1 <svg><title>no</title><g><text>t2</text><text>t3</text></g><desc>no</desc></svg> <math><mi>t4</mi><annotation>no</annotation></math>",
        "<table><tr style='visibility:hidden'><td>no<td style='visibility:visible'><b>t1</b></tr><tbody hidden>no<tr><td>no</tbody><details><summary>t2</summary><tr><td>no</details></table>",
    ]
    for page in pages:
        got = html.render(page)
        assert sorted(re.findall(r"t\d", got)) == sorted(re.findall(r"t\d", re.sub("<[^>]*>", " ", page))) and "no" not in got, page
    assert html.render(pages[0]) == "t1  t2\n\nt3"
    assert html.render(pages[3]) == "t1 t2 t3 t4"


def test_html_frame(spark):
    rows = spark.createDataFrame([(1, "<p>x", "clash"), (2, None, ""), (3, "y" * 200000, "")], "page_id long, html string, text string")
    got = html.extract(rows).orderBy("page_id").collect()
    assert [r.text for r in got] == ["x", None, "y" * 200000]


def test_digest():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_html_beyond_the_deepest_level():
    deep = "<div>" * 3000
    page = deep + "seen <b>this</b><div hidden>not <i>this</i> nor <div>that</div></div><script>no</script><p style='display:none'>no</p> end" + "</div>" * 3000 + "<p>after</p>"
    assert " ".join(html.render(page).split()) == "seen this end after"
    assert html.render("") == ""


def test_html_of_odd_tables(spark):
    rows = spark.createDataFrame([(1, "<p>a"), (1, "<p>a"), (2, None)], "page_id long, html string")
    assert sorted((r.page_id, r.text) for r in html.extract(rows).collect() if r.text) == [(1, "a"), (1, "a")]
    assert html.extract(rows.limit(0)).count() == 0


def test_two_compactions_at_a_time(spark, tmp_path):
    rows = docs_of(spark, ["a b", "c"]).withColumn("n_tokens", F.lit(2)).withColumn("n_chars", F.lit(3)).withColumn("tokenizer", F.lit("v"))
    one, two = tokens.Rollups(spark, str(tmp_path / "store")), tokens.Rollups(spark, str(tmp_path / "store"))
    assert one.commit("a", tokens.deltas(inserted=rows)) and one.commit("b", tokens.deltas(inserted=rows)) and not two.commit("a", tokens.deltas(inserted=rows))
    before, names = sorted(map(str, one.totals().collect())), two._names()
    two._names = lambda: names  # starts from what it sees before the other ends
    one.compact()
    two.compact()
    del two._names
    assert sorted(map(str, two.totals().collect())) == before and len([n for n in two._names() if n.startswith("sum=")]) == 1
    two.commit("c", tokens.deltas(deleted=rows))
    two.compact()
    assert not one.commit("b", tokens.deltas(inserted=rows)) and sum(r.n_docs for r in one.totals().collect()) == 2
