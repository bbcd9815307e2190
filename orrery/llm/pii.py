"""Surrogates for personal data: detected entities get keyed replacements of the same type, gender, script and format.

Found are e-mail addresses, IPv4 and IPv6 addresses, payment card numbers, international and local phone numbers, US social security
numbers, IBANs, secrets (long hexadecimal or mixed keys, and values after words such as ``token =`` or ``password:``) and
names after a form of address (``Mrs. Anna Weber``).

A surrogate is the entity moved one place along a keyed cycle through all strings of its type and format (``permute``).
So equal entities get equal surrogates in every document, different ones different surrogates, and none keeps its value;
nothing needs to be shared between tasks. Collision checks keep this true at the seams between value ranges: values that
would be invalid (an octet above 255, a wrong check digit) or that belong to another range (a name of the list) are stepped
over, which leaves the mapping one-to-one. ``audit`` verifies distinctness and coreference over a whole corpus.

What is kept: letter case and script, separators, an e-mail's top-level domain, whether an IP address is private, a card's
first digit and whether its check digit is right, a phone number's country code, an IBAN's country, a name's gender: names of
the lists get one of the same gender, others keep their last vowel and change consonants for consonants.

Null texts stay null and have no entity; empty texts stay empty. Repeated rows get equal results. Whole texts are read.
"""

from __future__ import annotations

import ipaddress
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import append
from .permute import cycle, digits, number

FEMALE = "Anna Maria Emma Laura Sophie Julia Clara Lucia Elena Marta Carmen Alice Camille Chloe Manon Ingrid Helga Petra Sabine Ursula Mary Linda Susan Karen Nancy Betty Helen Sandra Donna Carol".split()
MALE = "Hans Peter Karl Jürgen Stefan Thomas Michael Andreas José Luis Carlos Miguel Pablo Diego Pierre Jean Luc Antoine Olivier Hugo John James Robert David William Richard Joseph Charles Daniel Paul".split()
LAST = "Müller Schmidt Weber Fischer Wagner Becker Hoffmann García López Martínez Sánchez Pérez Gómez Ruiz Dubois Laurent Moreau Lefebvre Girard Bonnet Smith Jones Brown Taylor Wilson Davies Evans Walker Wright Green".split()
_HER, _HIS = "Mrs|Ms|Miss|Frau|Mme|Madame|Mlle|Señora|Señorita|Sra|Srta", "Mr|Herr|Monsieur|Señor|Sr"
_TITLE = re.compile(rf"\b(?P<t>{_HER}|{_HIS}|Dr|Prof)\b\.?[ \u00a0](?P<n>[^\W\d_][^\W\d_'’-]+)(?:[ \u00a0](?P<m>[^\W\d_][^\W\d_'’-]+))?")
_DOMAIN = re.compile(r"[A-Za-z0-9][A-Za-z0-9\-]*(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,24}")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_V6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:.]*[\w:])")
#: Country calling codes of two digits, as the ITU assigns them; those of one digit are 1 and 7, all others have three.
_CODES2 = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_SECRET = re.compile(
    r"(?i:\b(?:api[_-]?key|access[_-]?key|secret|token|passwd|password|pwd|auth)\b[\"']?\s*[:=]\s*[\"']?)(?P<v>[A-Za-z0-9_\-+/.=]{6,})"
    r"|(?<![0-9A-Za-z])(?P<h>[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z])(?P<k>(?:sk|pk|ghp|gho|xox[abp]|AKIA|ASIA|AIza)[_-]?[0-9A-Za-z_\-]{12,})"
)
_DIGITS = re.compile(
    r"(?<![\d.])(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?!\.?\d)"
    r"|(?<![\d\-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\d\-])"
    r"|(?<![\d])(?P<phone>(?:\+\d{1,3}|00\d{1,3})[ .\-]?(?:\(\d{1,5}\)[ .\-]?)?\d{1,4}(?:[ .\-]?\d{2,4}){1,5}|\(\d{2,5}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?!\d)"
    r"|(?<![\d])(?P<card>\d{4}[ \-]?\d{4}[ \-]?\d{4}[ \-]?\d{1,7}|3[47]\d{2}[ \-]?\d{6}[ \-]?\d{5})(?!\d)"
)
# gates: each finds something in every text in which the patterns behind it do
_LONG_HEX = re.compile(r"[0-9a-fA-F]{32}")
_KEY = re.compile(r"(?:sk|pk|gh[po]|xox[abp]|AKIA|ASIA|AIza)[_-]?[0-9A-Za-z_\-]{12}")
_NUMBER = re.compile(r"\d{3}|\d[.\-]\d|\+\d|[A-Z]{2}\d\d")
_ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
_PLACE = {c: (k, i) for k, a in enumerate(_ALPHABETS) for i, c in enumerate(a)}
#: Entities of more characters are replaced part by part.
PART = 256
ENTITY = T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("value", T.StringType()), T.StructField("surrogate", T.StringType())])


def _scrambled(text: str, key: bytes, kind: str, valid=lambda _: True) -> str:
    """text with each character of a known alphabet replaced by one of the same alphabet; others stay."""
    if len(text) > PART:
        return "".join(_scrambled(text[i : i + PART], key, f"{kind}:{i}") for i in range(0, len(text), PART))
    at = [i for i, c in enumerate(text) if c in _PLACE]
    if not at:
        return text
    kinds = [_PLACE[text[i]][0] for i in at]
    mask = "".join(str(_PLACE[c][0]) if c in _PLACE else c for c in text)
    bases = [len(_ALPHABETS[k]) for k in kinds]
    c = cycle(_product(bases), key, f"{kind}:{mask}")

    def spelled(v: int) -> str:
        out = list(text)
        for i, k, d in zip(at, kinds, digits(v, bases), strict=True):
            out[i] = _ALPHABETS[k][d]
        return "".join(out)

    return spelled(c.step(number([_PLACE[text[i]][1] for i in at], bases), lambda v: valid(spelled(v))))


_VOWELS = frozenset("aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýAEIOUYÀÁÂÃÄÅÆÈÉÊËÌÍÎÏÒÓÔÕÖØÙÚÛÜÝ")
_SOUNDS = ["".join(c for c in a if (c in _VOWELS) == vowel) for a in _ALPHABETS if a[0] in "aAàÀ" for vowel in (True, False)]
_SOUND = {c: (k, i) for k, a in enumerate(_SOUNDS) for i, c in enumerate(a)}


def _sounded(word: str, key: bytes, kind: str, valid=lambda _: True) -> str:
    """As _scrambled, but vowels stay vowels and an ending that may tell a gender stays; for names in Latin script."""
    last = len(word) - (1 if len(word) > 3 and word[-1] in _VOWELS else 0)
    if not 3 <= len(word) <= PART or any(c not in _SOUND for c in word[:last]):
        return _scrambled(word, key, kind, valid)
    kinds = [_SOUND[c][0] for c in word[:last]]
    bases = [len(_SOUNDS[k]) for k in kinds]
    c = cycle(_product(bases), key, f"{kind}:sound:{kinds}:{word[last:]}")
    spelled = lambda v: "".join(_SOUNDS[k][d] for k, d in zip(kinds, digits(v, bases), strict=True)) + word[last:]
    return spelled(c.step(number([_SOUND[c][1] for c in word[:last]], bases), lambda v: valid(spelled(v))))


def _product(bases: list[int]) -> int:
    out = 1
    for b in bases:
        out *= b
    return out


def luhn(ds: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(ds)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _onto(template: str, ds: str) -> str:
    it = iter(ds)
    return "".join(next(it) if c.isdigit() else c for c in template)


def _private(v: int) -> int:
    a, b = v >> 24, (v >> 16) & 255
    return 1 if a == 10 or (a == 172 and 16 <= b < 32) or (a == 192 and b == 168) else 2 if a in (0, 127) or a >= 224 else 0


def _ip(value: str, key: bytes) -> str:
    parts = [int(x) for x in value.split(".")]
    v = number(parts, [256] * 4)
    kind = _private(v)
    return ".".join(map(str, digits(cycle(1 << 32, key, "ip").step(v, lambda y: _private(y) == kind), [256] * 4)))


def _card(value: str, key: bytes) -> str:
    ds = "".join(c for c in value if c.isdigit())
    right = luhn(ds)
    c = cycle(10 ** (len(ds) - 1), key, f"card:{len(ds)}:{ds[0]}")
    full = lambda v: ds[0] + str(v).zfill(len(ds) - 1)
    return _onto(value, full(c.step(int(ds[1:]), lambda v: luhn(full(v)) == right)))


def _code(value: str) -> tuple[str, str]:
    """How a phone number begins, up to its country's calling code, and that code; both empty for a number without one."""
    m = re.match(r"\+|00", value)
    if not m:
        return "", ""
    ds = re.match(r"\d{0,3}", value[m.end() :]).group()
    code = ds[:1] if ds[:1] in "17" else ds[:2] if ds[:2] in _CODES2 else ds[:3]
    return m.group() + code, code


def _phone(value: str, key: bytes) -> str:
    """The country stays, however it is written; so a number has one surrogate in all its spellings."""
    head, code = _code(value)
    ds = "".join(c for c in value[len(head) :] if c.isdigit())
    if not ds:
        return value
    c = cycle(10 ** len(ds), key, f"phone:{code}:{len(ds)}")
    lead = ds[0] in "01"
    return head + _onto(value[len(head) :], str(c.step(int(ds), lambda v: (str(v).zfill(len(ds))[0] in "01") == lead)).zfill(len(ds)))


def _ip6(value: str, key: bytes) -> str:
    """The first digit and the leading zeros of each part stay, and so does what is left out."""
    low = value.lower()
    fixed = {next(i for i, c in enumerate(low) if c != ":")}
    at, bases = [], []
    for m in re.finditer(r"[0-9a-f]+", low):
        zeros = len(m.group()) - len(m.group().lstrip("0"))
        for k, i in enumerate(range(m.start() + zeros, m.end())):
            if i not in fixed:
                at.append(i)
                bases.append(16 if k else 15)
    if not at:
        return value
    mask = "".join("x" if i in set(at) else c for i, c in enumerate(low))
    c = cycle(_product(bases), key, f"ip6:{mask}")
    out = list(low)
    for i, d, b in zip(at, digits(c.step(number([int(low[i], 16) - (b == 15) for i, b in zip(at, bases, strict=True)], bases)), bases), bases, strict=True):
        out[i] = f"{d + (b == 15):x}"
    return "".join(out).upper() if value == value.upper() and value != low else "".join(out)


def _email(value: str, key: bytes) -> str:
    name, _, tld = value.rpartition(".")
    return _scrambled(name.lower(), key, f"email:{tld.lower()}") + "." + tld.lower()


def _iban(value: str, key: bytes) -> str:
    bare = value.replace(" ", "")
    body = _scrambled(bare[4:], key, f"iban:{bare[:2]}")
    rest = "".join(str(int(c, 36)) for c in body + bare[:2] + "00")
    out = iter(bare[:2] + f"{98 - int(rest) % 97:02d}" + body)
    return "".join(" " if c == " " else next(out) for c in value)


def _cased(like: str, word: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word.lower() if like.islower() else word


def _listed(word: str, names: list[str], tweak: str, key: bytes) -> str | None:
    low = {n.lower(): i for i, n in enumerate(names)}
    i = low.get(word.lower())
    return None if i is None else _cased(word, names[cycle(len(names), key, tweak).step(i)])


def _name(value: str, title: str, key: bytes) -> str:
    her = re.fullmatch(_HER, title) is not None
    words = value.split()
    gap = value[len(words[0])] if len(words) > 1 else " "
    out = []
    for i, w in enumerate(words):
        first = i == 0 and len(words) > 1
        lists = ([(FEMALE, "f"), (MALE, "m")] if her or title in ("Dr", "Prof") else [(MALE, "m"), (FEMALE, "f")]) if first else [(LAST, "l")]
        got = next((g for names, tag in lists if (g := _listed(w, names, tag, key))), None)
        if got is None:
            own = {n.lower() for names, _ in lists for n in names}
            got = _sounded(w, key, "first" if first else "last", lambda s, own=own: s.lower() not in own)
        out.append(got)
    return gap.join(out)


@lru_cache(maxsize=65536)
def surrogate(kind: str, value: str, key: bytes) -> str:
    """The replacement of one entity. kind: its type, for names with the form of address after a colon."""
    kind, _, title = kind.partition(":")
    if kind == "NAME":
        return _name(value, title, key)
    return {"IP": _ip, "IP6": _ip6, "SECRET": _secret, "CARD": _card, "PHONE": _phone, "EMAIL": _email, "IBAN": _iban}.get(kind, lambda v, k: _scrambled(v, k, kind))(value, key)


def detect(text: str) -> list[tuple[int, int, str]]:
    """Start, end and type of the entities of a text, in order and without overlaps; earlier patterns go first."""
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += _emails(text)
    if text.count(":") > 1:
        found += [(*m.span(), "IP6") for m in _V6.finditer(text) if _v6_valid(m.group())]
    for m in _SECRET.finditer(text) if _any(text.casefold(), _CUES) or _KEY.search(text) or _LONG_HEX.search(text) else ():
        for g in ("v", "h", "k"):
            if m[g]:
                if g != "v" or any(c.isdigit() for c in m[g]):
                    found.append((*m.span(g), "SECRET"))
    if _NUMBER.search(text):
        found += [(*m.span(), "IBAN") for m in _IBAN.finditer(text) if _iban_valid(m.group())]
        for m in _DIGITS.finditer(text):
            kind = m.lastgroup
            value = m.group()
            n = sum(c.isdigit() for c in value)
            if kind == "ip" and any(int(x) > 255 for x in value.split(".")):
                continue
            if kind == "card" and not 13 <= n <= 19 or kind == "phone" and not 7 <= n <= 15:
                continue
            found.append((*m.span(), kind.upper()))
    for m in _TITLE.finditer(text) if _any(text, _TITLES) else ():
        if m["n"][0].isupper():
            both = m["m"] is not None and m["m"][0].isupper()
            found.append((m.start("n"), m.end("m" if both else "n"), "NAME:" + m["t"]))
    if len(found) < 2:
        return found
    taken: list[tuple[int, int, str]] = []
    end = -1
    for s in sorted(enumerate(found), key=lambda x: (x[1][0], x[0])):
        a, b, kind = s[1]
        if a >= end:
            taken.append((a, b, kind))
            end = b
    return taken


def _emails(text: str) -> list[tuple[int, int, str]]:
    """E-mail addresses, each found from its @: what is before it is read once, however long."""
    out, from_ = [], 0
    at = text.find("@")
    while at >= 0:
        before = text[from_:at]
        name = before[len(before.rstrip(_LOCAL)) :].lstrip("._%+-")
        m = _DOMAIN.match(text, at + 1)
        if name and m:
            out.append((at - len(name), m.end(), "EMAIL"))
        from_ = m.end() if name and m else at + 1
        at = text.find("@", from_)
    return out


def _v6_valid(value: str) -> bool:
    """Whether it is an IPv6 address of more than a few digits."""
    try:
        return len(value.replace(":", "")) > 3 and ipaddress.IPv6Address(value).version == 6
    except ValueError:
        return False


_TITLES = tuple(f"{t}{c}" for t in f"{_HER}|{_HIS}|Dr|Prof".split("|") for c in (" ", ".", "\u00a0"))
_CUES = ("key", "secret", "token", "passw", "pwd", "auth")
_HEX = re.compile(r"[0-9a-f]{16,}|[0-9A-F]{16,}")


def _any(text: str, cues: tuple[str, ...]) -> bool:
    return any(c in text for c in cues)


def _secret(value: str, key: bytes) -> str:
    """Hexadecimal keys stay hexadecimal, and no other key becomes one."""
    if not _HEX.fullmatch(value):
        return _scrambled(value, key, "secret", lambda s: not _HEX.fullmatch(s))
    if len(value) > PART:
        return "".join(_hex(value[i : i + PART], key, f"{len(value)}:{i}") for i in range(0, len(value), PART))
    return _hex(value, key, str(len(value)))


def _hex(value: str, key: bytes, tweak: str) -> str:
    """A key of digits alone stays one; another keeps a letter, so that its case survives."""
    n = len(value)
    if value.isdigit():
        return str(cycle(10**n, key, f"hex:{tweak}:digits").step(int(value))).zfill(n)
    spelled = lambda v: f"{v:0{n}x}"
    upper = value.upper() == value
    new = spelled(cycle(16**n, key, f"hex:{tweak}:{upper}").step(int(value, 16), lambda v: not spelled(v).isdigit()))
    return new.upper() if upper else new


def _iban_valid(value: str) -> bool:
    bare = value.replace(" ", "")
    return 15 <= len(bare) <= 34 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def redact(text: str, key: bytes) -> tuple[str, list[tuple[str, int, str, str]]]:
    """The text with surrogates, and (type, place in the given text, value, surrogate) of each entity."""
    found = detect(text)
    if not found:
        return text, []
    out, at, told = [], 0, []
    for a, b, kind in found:
        value = text[a:b]
        new = surrogate(kind, value, key)
        out += [text[at:a], new]
        told.append((kind.partition(":")[0], a, value, new))
        at = b
    return "".join(out) + text[at:], told


def surrogates(docs: DataFrame, key: bytes, *, text: str = "text", entities: str | None = "entities", keep: list[str] | None = None) -> DataFrame:
    """docs with the text replaced and, unless ``entities`` is None, what was replaced (type, start, value, surrogate).

    The entities hold the personal data that the text no longer has: store them apart, or pass None.
    """
    fields = [T.StructField(text, T.StringType())] + ([T.StructField(entities, T.ArrayType(ENTITY))] if entities else [])

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        col = batch.column(batch.schema.get_field_index(text))
        texts, told = [], []
        for t in col.to_pylist():
            new, found = (None, []) if t is None else redact(t, key)
            texts.append(new)
            if entities:
                told.append([dict(zip(("type", "start", "value", "surrogate"), e, strict=True)) for e in found])
        kind = pa.struct([("type", pa.string()), ("start", pa.int32()), ("value", pa.string()), ("surrogate", pa.string())])
        return [pa.array(texts, pa.string())] + ([pa.array(told, pa.list_(kind))] if entities else [])

    return append(docs.withColumn(text, F.col(text).cast("string")), T.StructType(fields), compute, keep)


def audit(replaced: DataFrame, *, entities: str = "entities") -> DataFrame:
    """Rows (type, what, n_values) for each broken rule: values with two surrogates, surrogates of two values, values kept.

    Only distinct pairs are shuffled. E-mail addresses count as equal if they differ in case only.
    """
    e = replaced.select(F.explode(entities).alias("e")).select("e.type", F.when(F.col("e.type") == "EMAIL", F.lower("e.value")).otherwise(F.col("e.value")).alias("value"), "e.surrogate").distinct()
    split = e.groupBy("type", "value").agg(F.count("*").alias("n")).where("n > 1").groupBy("type").agg(F.count("*").alias("n_values")).withColumn("what", F.lit("two surrogates"))
    joint = e.groupBy("type", "surrogate").agg(F.count("*").alias("n")).where("n > 1 and type <> 'NAME'").groupBy("type").agg(F.count("*").alias("n_values")).withColumn("what", F.lit("shared surrogate"))
    kept = e.where("value = surrogate").groupBy("type").agg(F.count("*").alias("n_values")).withColumn("what", F.lit("kept"))
    cols = ["type", "what", "n_values"]
    return split.select(cols).unionByName(joint.select(cols)).unionByName(kept.select(cols))
