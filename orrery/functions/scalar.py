"""Scalar functions by name or IRI: ``FUNCTIONS[name](args) -> Val``; None where the arguments don't fit.

All are built from Spark's own functions but for the few the platform lacks (metaphone, Jaro-Winkler, geometry), which are
Arrow-batched pandas functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import similarity
from .values import BOOL, DATE, DBL, DEC, DT, INT, IRI, LANG_STRING, NUMBERS, NUMERIC, STR, STRING, TERM, XSD, Type, Val, instant, lexical, numeric, same_term, struct, text, to_term, truth

Function = Callable[[list[Val]], Val]
EXT = "http://orrery.example/fn/"
GEOF = "http://www.opengis.net/def/function/geosparql/"
FUNCTIONS: dict[str, Function] = {}


def function(*names: str) -> Callable[[Function], Function]:
    def put(f: Function) -> Function:
        for n in names:
            FUNCTIONS[n] = f
        return f

    return put


def register(iri: str, f: Function) -> None:
    """Adds a function of the user's own, called by its IRI in queries."""
    FUNCTIONS[iri] = f


def _tagged(like: Val, new: Column) -> Val:
    """A string with the language of another."""
    if like.kind != "term":
        return Val(STR, new)
    return Val(TERM, F.when(new.isNotNull(), struct(2, new, like.col["dt"], like.col["lang"])))


def _string(name: str, f: Callable[[Column], Column]) -> None:
    FUNCTIONS[name] = lambda a: _tagged(a[0], f(text(a[0])))


def _hash(name: str, f: Callable[[Column], Column]) -> None:
    FUNCTIONS[name] = lambda a: Val(STR, f(text(a[0])))


FUNCTIONS["str"] = lambda a: Val(STR, lexical(a[0]))
FUNCTIONS["strlen"] = lambda a: Val(INT, F.length(text(a[0])).cast("bigint"))
_string("ucase", F.upper)
_string("lcase", F.lower)
_hash("md5", F.md5)
_hash("sha1", F.sha1)
for _bits in (256, 384, 512):
    _hash(f"sha{_bits}", lambda c, b=_bits: F.sha2(c, b))
FUNCTIONS["contains"] = lambda a: Val(BOOL, F.contains(text(a[0]), text(a[1])))
FUNCTIONS["strstarts"] = lambda a: Val(BOOL, F.startswith(text(a[0]), text(a[1])))
FUNCTIONS["strends"] = lambda a: Val(BOOL, F.endswith(text(a[0]), text(a[1])))
FUNCTIONS["uuid"] = lambda a: Val(IRI, F.concat(F.lit("urn:uuid:"), F.uuid()))
FUNCTIONS["struuid"] = lambda a: Val(STR, F.uuid())
FUNCTIONS["rand"] = lambda a: Val(DBL, F.rand())
FUNCTIONS["now"] = lambda a: Val(DT, F.date_trunc("second", F.current_timestamp()).cast("timestamp_ntz"))
FUNCTIONS["sameterm"] = lambda a: Val(BOOL, same_term(a[0], a[1]))


@function("substr")
def _(a: list[Val]) -> Val:
    s, start = text(a[0]), a[1].col.cast("int") if a[1].kind in NUMERIC else numeric(a[1]).cast("int")
    if len(a) == 2:
        return _tagged(a[0], F.substring(s, start, F.length(s)))
    n = a[2].col.cast("int") if a[2].kind in NUMERIC else numeric(a[2]).cast("int")
    # characters at places start <= i < start + n, counted from 1
    return _tagged(a[0], F.substring(s, F.greatest(start, F.lit(1)), F.greatest(n + F.least(start - 1, F.lit(0)), F.lit(0))))


@function("concat")
def _(a: list[Val]) -> Val:
    out = F.concat(*[text(v) for v in a]) if a else F.lit("")
    if all(v.kind != "term" for v in a):
        return Val(STR, out)
    langs = [to_term(v)["lang"] for v in a]
    same = F.array_distinct(F.array(*langs))
    lang = F.when(F.size(same) == 1, same[0]).otherwise("")
    return Val(TERM, F.when(out.isNotNull(), struct(2, out, F.when(lang != "", LANG_STRING).otherwise(STRING), lang)))


def _pattern(v: Val, flags: list[Val]) -> Column:
    if not flags:
        return text(v)
    f = F.regexp_replace(text(flags[0]), "[^imsx]", "")
    return F.concat(F.when(f != "", F.concat(F.lit("(?"), f, F.lit(")"))).otherwise(""), F.when(F.contains(text(flags[0]), F.lit("q")), F.concat(F.lit("\\Q"), text(v), F.lit("\\E"))).otherwise(text(v)))


FUNCTIONS["regex"] = lambda a: Val(BOOL, F.rlike(text(a[0]), _pattern(a[1], a[2:])))
FUNCTIONS["replace"] = lambda a: _tagged(a[0], F.regexp_replace(text(a[0]), _pattern(a[1], a[3:]), text(a[2])))
FUNCTIONS["encode_for_uri"] = lambda a: Val(STR, F.replace(F.replace(F.replace(F.url_encode(text(a[0])), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")))


@function("strlang")
def _(a: list[Val]) -> Val:
    plain = a[0].col if a[0].kind == "str" else F.when(to_term(a[0])["dt"] == STRING, to_term(a[0])["lex"])
    return Val(TERM, F.when(plain.isNotNull() & text(a[1]).isNotNull(), struct(2, plain, LANG_STRING, F.lower(text(a[1])))))


@function("strdt")
def _(a: list[Val]) -> Val:
    plain = a[0].col if a[0].kind == "str" else F.when(to_term(a[0])["dt"] == STRING, to_term(a[0])["lex"])
    return Val(TERM, F.when(plain.isNotNull() & lexical(a[1]).isNotNull(), struct(2, plain, lexical(a[1]))))


@function("strbefore")
def _(a: list[Val]) -> Val:
    s, p = text(a[0]), text(a[1])
    at = F.instr(s, p)
    return _part(a[0], s, p, at, F.substring(s, F.lit(1), at - 1))


@function("strafter")
def _(a: list[Val]) -> Val:
    s, p = text(a[0]), text(a[1])
    at = F.instr(s, p)
    return _part(a[0], s, p, at, F.substring(s, at + F.length(p), F.length(s)))


def _part(like: Val, s: Column, p: Column, at: Column, found: Column) -> Val:
    hit = (at > 0) | (p == "")
    if like.kind != "term":
        return Val(STR, F.when(s.isNotNull() & p.isNotNull(), F.when(hit, found).otherwise("")))
    return Val(TERM, F.when(s.isNotNull() & p.isNotNull(), F.when(hit, struct(2, found, like.col["dt"], like.col["lang"])).otherwise(struct(2, F.lit(""), STRING))))


@function("langmatches")
def _(a: list[Val]) -> Val:
    tag, want = F.lower(text(a[0])), F.lower(text(a[1]))
    return Val(BOOL, F.when(want == "*", tag != "").otherwise((tag == want) | F.startswith(tag, F.concat(want, F.lit("-")))))


# -- numbers
def _number(name: str, native: Callable[[Column], Column]) -> None:
    def f(a: list[Val]) -> Val:
        v = a[0]
        if v.kind == "int":
            return v if name != "abs" else Val(INT, F.abs(v.col))
        if v.kind in NUMERIC:
            return Val(v.type, native(v.col).cast("decimal(38,18)" if v.kind == "dec" else "double"))
        return Val(DBL, native(numeric(v)).cast("double"))

    FUNCTIONS[name] = f


_number("abs", F.abs)
_number("ceil", F.ceil)
_number("floor", F.floor)
_number("round", lambda c: F.floor(c + F.lit(0.5).cast("decimal(2,1)")))


# -- times
def _field(name: str, f: Callable[[Column], Column], group: str) -> None:
    def get(a: list[Val]) -> Val:
        v = a[0]
        if v.kind in ("dt", "date"):
            return Val(INT, f(v.col).cast("bigint"))
        lex = F.when(to_term(v)["dt"].isin(XSD + "dateTime", XSD + "date"), to_term(v)["lex"])
        return Val(INT, F.regexp_extract(lex, r"^(-?\d{4,})-(\d\d)-(\d\d)(?:T(\d\d):(\d\d):(\d\d(?:\.\d+)?))?", int(group)).try_cast("bigint"))

    FUNCTIONS[name] = get


for _name, _f, _g in (("year", F.year, "1"), ("month", F.month, "2"), ("day", F.dayofmonth, "3"), ("hours", F.hour, "4"), ("minutes", F.minute, "5")):
    _field(_name, _f, _g)


@function("seconds")
def _(a: list[Val]) -> Val:
    v = a[0]
    if v.kind == "dt":
        return Val(DEC, F.date_part(F.lit("SECOND"), v.col).cast("decimal(38,18)"))
    return Val(DEC, F.regexp_extract(to_term(v)["lex"], r"T\d\d:\d\d:(\d\d(?:\.\d+)?)", 1).try_cast("decimal(38,18)"))


@function("tz")
def _(a: list[Val]) -> Val:
    if a[0].kind in ("dt", "date"):
        return Val(STR, F.when(a[0].col.isNotNull(), F.lit("")))
    return Val(STR, F.regexp_extract(to_term(a[0])["lex"], r"T[^Z+\-]*(Z|[+-]\d\d:\d\d)?$", 1))


@function("timezone")
def _(a: list[Val]) -> Val:
    z = FUNCTIONS["tz"](a).col
    hours, minutes = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
    tail = F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise("")
    iso = F.when(z == "Z", "PT0S").when(z != "", F.concat(F.when(F.startswith(z, F.lit("-")), "-").otherwise(""), F.lit("PT"), hours.cast("string"), F.lit("H"), tail))
    return Val(TERM, F.when(iso.isNotNull(), struct(2, iso, XSD + "dayTimeDuration")))


# -- terms
FUNCTIONS["iri"] = FUNCTIONS["uri"] = lambda a: Val(IRI, lexical(a[0]))
FUNCTIONS["bnode"] = lambda a: Val(TERM, struct(1, F.concat(F.lit("b"), F.replace(F.uuid(), F.lit("-"), F.lit("")) if not a else F.sha1(lexical(a[0])))))
FUNCTIONS["lang"] = lambda a: Val(STR, F.when(to_term(a[0])["kind"] == 2, to_term(a[0])["lang"]))
FUNCTIONS["datatype"] = lambda a: Val(IRI, F.when(to_term(a[0])["kind"] == 2, to_term(a[0])["dt"]))


def _is(name: str, native: tuple[str, ...], generic: Callable[[Column], Column]) -> None:
    FUNCTIONS[name] = lambda a: Val(BOOL, generic(a[0].col) if a[0].kind == "term" else F.when(a[0].col.isNotNull(), F.lit(a[0].kind in native)))


_is("isiri", ("iri", "ref"), lambda c: c["kind"] == 0)
FUNCTIONS["isuri"] = FUNCTIONS["isiri"]
_is("isblank", (), lambda c: c["kind"] == 1)
_is("isliteral", ("str", "int", "dec", "dbl", "bool", "dt", "date"), lambda c: c["kind"] == 2)
_is("isnumeric", NUMERIC, lambda c: (c["kind"] == 2) & c["dt"].isin(NUMBERS) & c["lex"].try_cast("double").isNotNull())
FUNCTIONS["istriple"] = lambda a: Val(BOOL, to_term(a[0])["kind"] == 5)


def _cast(to: Type, sql: str) -> Function:
    def f(a: list[Val]) -> Val:
        v = a[0]
        if v.kind == "bool" and to in (INT, DEC, DBL):
            return Val(to, v.col.cast("int").cast(sql))
        if v.kind in NUMERIC and to in (INT, DEC, DBL):
            return Val(to, v.col.try_cast(sql))
        if to == BOOL:
            if v.kind in NUMERIC:
                return Val(BOOL, truth(v))
            s = lexical(v)
            return Val(BOOL, F.when(s.isin("true", "1"), True).when(s.isin("false", "0"), False).otherwise(F.when(numeric(v).isNotNull(), numeric(v) != 0)))
        if to in (DT, DATE):
            return Val(to, v.col.cast(sql) if v.kind in ("dt", "date") else lexical(v).try_cast("timestamp").cast(sql))
        s = lexical(v)
        return Val(to, s.try_cast("decimal(38,18)").try_cast(sql) if to == INT else s.try_cast(sql))

    return f


FUNCTIONS[XSD + "integer"] = FUNCTIONS[XSD + "int"] = FUNCTIONS[XSD + "long"] = _cast(INT, "bigint")
FUNCTIONS[XSD + "decimal"] = _cast(DEC, "decimal(38,18)")
FUNCTIONS[XSD + "double"] = FUNCTIONS[XSD + "float"] = _cast(DBL, "double")
FUNCTIONS[XSD + "boolean"] = _cast(BOOL, "boolean")
FUNCTIONS[XSD + "dateTime"] = _cast(DT, "timestamp_ntz")
FUNCTIONS[XSD + "date"] = _cast(DATE, "date")
FUNCTIONS[XSD + "string"] = FUNCTIONS["str"]


# -- extensions: similarity, intervals, geometry
def _score(name: str, f: Callable[..., Column], out: Type = DBL) -> None:
    FUNCTIONS[EXT + name] = lambda a: Val(out, f(*[lexical(v) for v in a]))


_score("fuzzy_match", similarity.trigram)
_score("trigram_similarity", similarity.trigram)
_score("token_set_ratio", similarity.token_set)
_score("soundex", F.soundex, STR)
_score("metaphone", similarity.metaphone, STR)
_score("jaro_winkler", similarity.jaro_winkler)
_score("dice_similarity", similarity.dice)
FUNCTIONS[EXT + "levenshtein"] = lambda a: Val(INT, F.levenshtein(lexical(a[0]), lexical(a[1])).cast("bigint"))
FUNCTIONS[EXT + "levenshtein_less_equal"] = lambda a: Val(INT, similarity.levenshtein_within(lexical(a[0]), lexical(a[1]), numeric(a[2])))


def _interval(name: str, f: Callable[..., Column]) -> None:
    FUNCTIONS[EXT + name] = lambda a: Val(BOOL, f(*[instant(v) for v in a]))


ALLEN: dict[str, Callable[..., Column]] = {
    "before": lambda s, e, t, u: (s < t) & (e <= t),
    "meets": lambda s, e, t, u: e == t,
    "overlaps": lambda s, e, t, u: (s < t) & (e > t) & (e < u),
    "during": lambda s, e, t, u: (s > t) & (e < u),
    "finishes": lambda s, e, t, u: (e == u) & (s > t),
    "starts": lambda s, e, t, u: (s == t) & (e < u),
    "equals": lambda s, e, t, u: (s == t) & (e == u),
}
for _name, _f in ALLEN.items():
    _interval(_name, _f)
for _name in similarity.GEO_TESTS:
    FUNCTIONS[GEOF + _name] = lambda a, n=_name: Val(BOOL, similarity.geo_test(n)(lexical(a[0]), lexical(a[1])))
for _name in similarity.GEO_MEASURES:
    FUNCTIONS[GEOF + _name] = lambda a, n=_name: Val(DBL, similarity.geo_measure(n)(*[lexical(v) for v in a[:2]]))
for _name in similarity.GEO_SHAPES:
    FUNCTIONS[GEOF + _name] = lambda a, n=_name: Val(STR, similarity.geo_shape(n)(lexical(a[0])))
