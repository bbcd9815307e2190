"""String and geometry functions that Spark lacks, on columns."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _trigrams(c: Column) -> Column:
    """Distinct trigrams of the words of a text, each padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def _overlap(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union))


def trigram(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams."""
    return _overlap(_trigrams(a), _trigrams(b))


def token_set(a: Column, b: Column) -> Column:
    """Shared words over all words, without regard to case and order."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    return _overlap(words(a), words(b))


def levenshtein_within(a: Column, b: Column, most: Column) -> Column:
    """Edit distance, or most + 1 where it is larger."""
    d = F.levenshtein(a, b).cast("bigint")
    return F.least(d, most.cast("bigint") + 1)


#: Hexadecimal digits that fit in a bigint.
_DIGITS = 15


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two bit filters in hexadecimal; 1 if equal.

    Bits are counted by pieces of fifteen digits in one pass. What is no digit counts as 0, and so does what only one side has.
    """
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9A-Fa-f]", "0")
    piece = lambda c, i: F.conv(F.rpad(F.substring(c, i, F.lit(_DIGITS)), _DIGITS, "0"), 16, 10).cast("bigint")
    none = F.struct(F.lit(0).alias("both"), F.lit(0).alias("total"))

    def counted(x: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.length(x["a"]), F.length(x["b"]), F.lit(1)), F.lit(_DIGITS))
        pieces = F.transform(at, lambda i: F.struct(piece(x["a"], i).alias("p"), piece(x["b"], i).alias("q")))
        more = lambda s, v: F.struct((s["both"] + F.bit_count(v["p"].bitwiseAND(v["q"]))).alias("both"), (s["total"] + F.bit_count(v["p"]) + F.bit_count(v["q"])).alias("total"))
        return F.aggregate(pieces, none, more, lambda s: F.when(s["total"] > 0, 2.0 * s["both"] / s["total"]))

    # as the one item of an array, so that each side is cleaned once and not for each piece
    share = F.element_at(F.transform(F.array(F.struct(clean(a).alias("a"), clean(b).alias("b"))), counted), 1)
    return F.when(a == b, 1.0).otherwise(F.coalesce(share, F.when(a.isNotNull() & b.isNotNull(), 0.0)))


def _jw(s: str, t: str) -> float:
    if s == t:
        return 1.0
    n, m = len(s), len(t)
    if not n or not m:
        return 0.0
    reach = max(max(n, m) // 2 - 1, 0)
    used, mine = [False] * m, []
    for i, c in enumerate(s):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not used[j] and t[j] == c:
                used[j] = True
                mine.append(c)
                break
    k = len(mine)
    if not k:
        return 0.0
    swapped = sum(a != b for a, b in zip(mine, (t[j] for j in range(m) if used[j]), strict=True)) / 2
    jaro = (k / n + k / m + (k - swapped) / k) / 3
    same = 0
    for a, b in zip(s[:4], t[:4], strict=False):
        if a != b:
            break
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


@lru_cache(maxsize=None)
def _udf(name: str):
    if name == "jw":

        @F.pandas_udf("double")
        def f(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([None if x is None or y is None else _jw(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    else:

        @F.pandas_udf("string")
        def f(a: pd.Series) -> pd.Series:
            return a.map(lambda x: None if x is None else metaphone_code(x))

    return f


def jaro_winkler(a: Column, b: Column) -> Column:
    return _udf("jw")(a, b)


def metaphone(a: Column, *_: Column) -> Column:
    return _udf("mp")(a)


_MP = [(r"^(?:KN|GN|PN|AE|WR)", lambda m: m.group()[1]), (r"^X", "S"), (r"^WH", "W"), (r"MB$", "M"), (r"([^C])\1+", r"\1"), (r"SCH", "SK"), (r"C(?=IA)|CH", "X"), (r"C(?=[IEY])", "S"), (r"C|CK", "K"), (r"DG(?=[EIY])", "J"), (r"D", "T"), (r"GH(?![AEIOU])", ""), (r"GN(?:ED)?$", "N"), (r"G(?=[IEY])", "J"), (r"G", "K"), (r"(?<=[AEIOU])H(?![AEIOU])", ""), (r"PH", "F"), (r"Q", "K"), (r"S(?=I[OA])|SH", "X"), (r"T(?=I[OA])", "X"), (r"TH", "0"), (r"TCH", "X"), (r"V", "F"), (r"W(?![AEIOU])", ""), (r"X", "KS"), (r"Y(?![AEIOU])", ""), (r"Z", "S"), (r"KK+", "K")]
_MP_RE = [(re.compile(p), r) for p, r in _MP]


def metaphone_code(word: str, length: int = 16) -> str:
    w = re.sub(r"[^A-Z]", "", word.upper())
    for p, r in _MP_RE:
        w = p.sub(r, w)
    return (w[:1] + re.sub("[AEIOU]", "", w[1:]))[:length]


# -- geometry on WKT: points, line strings and polygons (outer ring)
GEO_TESTS = ("sfIntersects", "sfContains", "sfWithin", "sfDisjoint", "sfEquals", "sfTouches", "sfOverlaps", "sfCrosses", "ehCovers", "ehCoveredBy", "ehInside", "ehContains")
GEO_MEASURES = ("distance", "area", "length")
GEO_SHAPES = ("envelope", "convexHull", "boundary", "asWKT")


def shape(wkt: str) -> tuple[str, list[tuple[float, float]]]:
    m = re.match(r"\s*(?:<[^>]*>\s*)?(POINT|LINESTRING|POLYGON)\s*\(+([^()]*)\)", wkt or "", re.I)
    if not m:
        raise ValueError(f"not a supported geometry: {wkt!r}")
    return m[1].upper(), [tuple(float(x) for x in p.split()[:2]) for p in m[2].split(",")]


def _inside(p: tuple[float, float], ring: list[tuple[float, float]]) -> int:
    """1 inside, 0 on the boundary, -1 outside."""
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
        cross = (x2 - x1) * (p[1] - y1) - (y2 - y1) * (p[0] - x1)
        if cross == 0 and min(x1, x2) <= p[0] <= max(x1, x2) and min(y1, y2) <= p[1] <= max(y1, y2):
            return 0
        if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1:
            hit = not hit
    return 1 if hit else -1


def _cross(a, b, c, d) -> bool:
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0


def _segments(g) -> list:
    return list(zip(g[1], g[1][1:], strict=False))


def _relation(a, b) -> dict[str, bool]:
    """Where the points of each stand to the other, by vertices and crossing edges."""
    place = lambda p, g: _inside(p, g[1]) if g[0] == "POLYGON" else (0 if any(_inside(p, [s, e, s]) == 0 for s, e in _segments(g)) or p in g[1] else -1)
    ab, ba = [place(p, b) for p in a[1]], [place(p, a) for p in b[1]]
    cut = any(_cross(*s, *t) for s in _segments(a) for t in _segments(b))
    touch = cut or max(ab) >= 0 or max(ba) >= 0
    within = min(ab) >= 0 and not cut
    covers = min(ba) >= 0 and not cut
    inner = cut or max(ab) > 0 or max(ba) > 0 or (within and covers)
    return {"intersects": touch, "within": within, "contains": covers, "inner": inner, "strict_in": min(ab) > 0 and not cut, "strict_out": min(ba) > 0 and not cut, "cut": cut}


def _test(name: str, x: str, y: str) -> bool:
    a, b = shape(x), shape(y)
    r = _relation(a, b)
    return {
        "sfIntersects": r["intersects"], "sfDisjoint": not r["intersects"], "sfWithin": r["within"], "sfContains": r["contains"], "sfEquals": r["within"] and r["contains"],
        "sfTouches": r["intersects"] and not r["inner"], "sfOverlaps": r["inner"] and not r["within"] and not r["contains"], "sfCrosses": r["cut"],
        "ehCovers": r["contains"], "ehCoveredBy": r["within"], "ehInside": r["strict_in"], "ehContains": r["strict_out"],
    }[name]


def _measure(name: str, x: str, y: str | None) -> float:
    kind, pts = shape(x)
    if name == "area":
        return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:], strict=False))) / 2 if kind == "POLYGON" else 0.0
    if name == "length":
        return sum(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 for a, b in zip(pts, pts[1:], strict=False))
    a, b = shape(x), shape(y or "")
    if _relation(a, b)["intersects"]:
        return 0.0

    def off(p, s, e) -> float:
        dx, dy = e[0] - s[0], e[1] - s[1]
        n = dx * dx + dy * dy
        t = max(0.0, min(1.0, ((p[0] - s[0]) * dx + (p[1] - s[1]) * dy) / n)) if n else 0.0
        return ((p[0] - s[0] - t * dx) ** 2 + (p[1] - s[1] - t * dy) ** 2) ** 0.5

    sides = lambda g: _segments(g) or [(g[1][0], g[1][0])]
    return min([off(p, *s) for p in a[1] for s in sides(b)] + [off(p, *s) for p in b[1] for s in sides(a)])


def _wkt(kind: str, pts) -> str:
    body = ", ".join(f"{x:g} {y:g}" for x, y in pts)
    return f"POLYGON (({body}))" if kind == "POLYGON" else f"{kind} ({body})"


def _shaped(name: str, x: str) -> str:
    kind, pts = shape(x)
    if name == "asWKT":
        return _wkt(kind, pts)
    if name == "boundary":
        return _wkt("LINESTRING", pts)
    if name == "envelope":
        xs, ys = [p[0] for p in pts], [p[1] for p in pts]
        return _wkt("POLYGON", [(min(xs), min(ys)), (max(xs), min(ys)), (max(xs), max(ys)), (min(xs), max(ys)), (min(xs), min(ys))])
    ps = sorted(set(pts))
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def half(points):
        out: list = []
        for p in points:
            while len(out) > 1 and turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    hull = half(ps) + half(ps[::-1])
    return _wkt("POLYGON", [*hull, hull[0]]) if hull else _wkt(kind, pts)


def _safe(f, *args):
    try:
        return f(*args)
    except (ValueError, IndexError):
        return None


@lru_cache(maxsize=None)
def geo_test(name: str):
    @F.pandas_udf("boolean")
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_safe(_test, name, x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return f


@lru_cache(maxsize=None)
def geo_measure(name: str):
    @F.pandas_udf("double")
    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_safe(_measure, name, x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    @F.pandas_udf("double")
    def one(a: pd.Series) -> pd.Series:
        return pd.Series([_safe(_measure, name, x, None) for x in a], dtype="float64")

    return lambda *cols: two(*cols) if name == "distance" else one(cols[0])


@lru_cache(maxsize=None)
def geo_shape(name: str):
    @F.pandas_udf("string")
    def f(a: pd.Series) -> pd.Series:
        return pd.Series([_safe(_shaped, name, x) for x in a], dtype=object)

    return f
