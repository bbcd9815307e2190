"""URL filter: rules first, then a tree of path templates for each host.

Rules: ``(verdict, host, path)``. A rule fits its host and the host's subdomains if the path starts with the rule's; of
fitting rules the longest wins.

All other urls are judged by templates. A path is cut at ``/``. Segments that look variable (digits, hexadecimal ids,
dates, mixed codes) become wildcards at once. Then, level by level from the root, each node of a host's tree is looked at:

* generalise: a node with more than FANOUT different children, none of which holds more than SHARE of its urls, gets one
  wildcard child instead;
* merge: children of a node that have similar kinds of children below them (bottom-k sketches, of SKETCH hashes, of their
  next segments, that share at least ALIKE of their hashes with the largest such child's) and similar labelled purity,
  told by a two-proportion test, become one branch, again a wildcard. Children are compared if their least hashes are
  equal, as they are with a probability that is their similarity;

down to the last segment. From level DEEP on, a path with no other beside it is finished at once: nothing could change the
rest of it. A template is rejected if its labelled urls are bad often enough: the share
of bad ones, smoothed by the host's own share and that by the whole table's, must reach CUT, with at least MIN_BAD bad ones.

Only sums by host, template and child are shuffled, added up before the shuffle, so a host with a third of all urls costs
what its distinct templates do. Null urls and urls without ``://`` have an empty host and path, no rule and template ``''``,
and are allowed. Labels are optional: without them nothing is rejected by the method. Repeated rows are judged alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import written

FANOUT, SHARE = 20, 0.2
DEEP, SKETCH, ALIKE = 6, 64, 0.6
CUT, MIN_BAD, STRENGTH = 0.6, 3, 4.0
Z_MERGE = 1.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_VARIABLE = r"^(?:\d+(?:\.[A-Za-z][A-Za-z0-9]*)?|[0-9a-fA-F]{8,}|[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}|\d{4}-\d{2}-\d{2}|(?=[^/]*\d[^/]*\d[^/]*\d)[A-Za-z0-9_-]{10,})$"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the host's end to the next ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def _segments(path: Column) -> Column:
    """All segments, variable ones as ``*``."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike(_VARIABLE), "*").otherwise(s))


def _below(tree: DataFrame, level: int) -> DataFrame:
    """The bottom-k sketch of the next segments of each (host, template, child): the least hashes, in order."""
    at = ["host", "template", "child"]
    hashes = tree.where("child <> ''").select(*at, F.xxhash64(F.coalesce(F.get("segs", F.lit(level + 1)), F.lit(""))).alias("h")).distinct()
    least = hashes.withColumn("i", F.row_number().over(Window.partitionBy(*at).orderBy("h"))).where(F.col("i") <= SKETCH)
    return least.groupBy(*at).agg(F.array_sort(F.collect_list("h")).alias("below"))


def templates(urls: DataFrame) -> DataFrame:
    """host, segs, template of each distinct (host, segs) of urls (host, segs, n, good, bad)."""
    tree, done, level = urls.withColumn("template", F.lit("")), [], 0
    while True:
        child = F.coalesce(F.get("segs", F.lit(level)), F.lit(""))
        tree = tree.withColumn("child", child)
        kids = tree.where("child <> ''").groupBy("host", "template", "child").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad")).join(_below(tree, level), ["host", "template", "child"]).withColumn("first", F.get("below", F.lit(0)))
        # merge: siblings with the same kinds of children and no significant difference in purity
        alike = kids.where("child <> '*'").groupBy("host", "template", "first").agg(F.count("*").alias("k"), F.max_by("below", F.struct("n", "child")).alias("like"), F.sum("n").alias("n"), F.sum("good").alias("g"), F.sum("bad").alias("b"), F.max("n").alias("most"))
        spread = F.sqrt(F.greatest((F.col("b") + 1) * (F.col("g") + 1) / F.pow(F.col("b") + F.col("g") + 2, 2) / F.greatest(F.col("good") + F.col("bad"), F.lit(1)), F.lit(1e-9)))
        near = F.abs((F.col("bad") + 1) / (F.col("good") + F.col("bad") + 2) - (F.col("b") + 1) / (F.col("g") + F.col("b") + 2)) <= Z_MERGE * spread + 0.1
        kin = F.size(F.array_intersect("below", "like")) >= ALIKE * F.size(F.array_union("below", "like"))
        node = kids.groupBy("host", "template").agg(F.count("*").alias("kinds"), F.sum("n").alias("total"), F.max(F.when(F.col("child") != "*", F.col("n"))).alias("top"))
        general = node.where((F.col("kinds") > FANOUT) & (F.coalesce("top", F.lit(0)) <= SHARE * F.col("total"))).select("host", "template", F.lit(True).alias("general"))
        merged = kids.join(alike.where("k > 2").select("host", "template", "first", "like", "k", "g", "b"), ["host", "template", "first"]).where(near & kin & (F.col("child") != "*")).select("host", "template", "child", F.lit(True).alias("merged"))
        tree = tree.join(general, ["host", "template"], "left").join(merged, ["host", "template", "child"], "left")
        named = F.when(F.col("child") == "", F.lit("")).when(F.coalesce("general", "merged", F.lit(False)), F.lit("/*")).otherwise(F.concat(F.lit("/"), "child"))
        tree = written(tree.withColumn("template", F.concat("template", named)).select("host", "segs", "n", "good", "bad", "template"))
        level += 1
        if level >= DEEP:
            deeper = tree.where(F.size("segs") > level)
            alone = deeper.groupBy("host", "template").agg(F.count("*").alias("k")).where("k = 1").drop("k")
            rest = F.concat("template", F.lit("/"), F.array_join(F.slice("segs", level + 1, F.size("segs")), "/"))
            done += [tree.where(F.size("segs") <= level), deeper.join(alone, ["host", "template"]).withColumn("template", rest).select(tree.columns)]
            tree = written(deeper.join(alone, ["host", "template"], "left_anti").select(tree.columns))
        if tree.where(F.size("segs") > level).isEmpty():
            break
    for part in done:
        tree = tree.unionByName(part)
    return tree


def judge(pages: DataFrame, rules: list[Rule], *, url: str = "url", bad: Column | None = None) -> DataFrame:
    """pages with host, path, rule, template and verdict. bad: label of a page, true, false or null for not labelled."""
    clash = {"host", "path", "rule", "template", "verdict"}
    link = F.col(url).cast("string")
    label = F.lit(None).cast("boolean") if bad is None else bad
    given = pages.withColumns({"__host": host_of(link), "__path": path_of(link), "__bad": label})
    given = given.drop(*[c for c in given.columns if c.lower() in clash]).withColumnsRenamed({"__host": "host", "__path": "path"})
    given = given.withColumn("segs", F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(_segments(F.col("path"))))
    sums = [F.count("*").alias("n"), F.sum(F.when(F.col("__bad") == F.lit(False), 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("__bad"), 1).otherwise(0)).alias("bad")]
    found = templates(written(given.groupBy("host", "segs").agg(*sums)))
    by_template = found.groupBy("host", "template").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    by_host = by_template.groupBy("host").agg(F.sum("g").alias("hg"), F.sum("b").alias("hb"))
    everywhere = by_host.agg(F.coalesce(F.sum("hb") / F.greatest(F.sum("hb") + F.sum("hg"), F.lit(1)), F.lit(0.0)).alias("p")).first().p
    prior = (F.col("hb") + STRENGTH * F.lit(float(everywhere))) / (F.col("hb") + F.col("hg") + STRENGTH)
    purity = (F.col("b") + STRENGTH * prior) / (F.col("b") + F.col("g") + STRENGTH)
    rejected = by_template.join(by_host, "host").where((purity >= CUT) & (F.col("b") >= MIN_BAD) & (F.col("host") != "")).select("host", "template", F.lit(True).alias("rejected"))
    verdicts = found.join(rejected, ["host", "template"], "left").select("host", "segs", "template", "rejected")
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    method = F.when(F.coalesce("rejected", F.lit(False)), "block").otherwise("allow")
    return given.join(verdicts, ["host", "segs"], "left").withColumns({"rule": rule, "verdict": F.coalesce(verdict, method)}).drop("segs", "rejected", "__bad")
