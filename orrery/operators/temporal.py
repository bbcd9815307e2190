"""Facts with validity intervals (s, p, o, valid_from, valid_to), half open; valid_to null means still valid."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ALLEN


def duration(iso: str) -> timedelta:
    """An ISO 8601 duration of weeks, days and times; a year has 365 and a month 30 days."""
    m = re.fullmatch(r"(-)?P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?", iso)
    if not m or iso.endswith(("P", "T")):
        raise ValueError(f"not a duration: {iso!r}")
    y, mo, w, d, h, mi, s = (float(x or 0) for x in m.groups()[1:])
    out = timedelta(days=365 * y + 30 * mo + 7 * w + d, hours=h, minutes=mi, seconds=s)
    return -out if m[1] else out


def at(facts: DataFrame, when: Column) -> DataFrame:
    """Facts valid at a time."""
    return facts.where((F.col("valid_from") <= when) & (F.col("valid_to").isNull() | (F.col("valid_to") > when)))


def overlapping(facts: DataFrame, start: Column, end: Column) -> DataFrame:
    return facts.where((F.col("valid_from") < end) & (F.col("valid_to").isNull() | (F.col("valid_to") > start)))


def within(facts: DataFrame, now: Column, iso: str) -> DataFrame:
    return facts.where(F.col("valid_from") >= now - F.lit(duration(iso)))


def snapshots(facts: DataFrame) -> DataFrame:
    """Snapshot model: a new value of (s, p) closes the one before it."""
    w = Window.partitionBy("s", "p").orderBy("valid_from")
    return facts.withColumn("valid_to", F.lead("valid_from").over(w))


def retracted(facts: DataFrame, gone: DataFrame, when: Column) -> DataFrame:
    """The latest open fact of each (s, p) in gone is closed at a time."""
    w = Window.partitionBy("s", "p").orderBy(F.col("valid_from").desc())
    marked = facts.join(gone.select("s", "p").distinct().withColumn("__gone", F.lit(True)), ["s", "p"], "left").withColumn("__n", F.when(F.col("valid_to").isNull(), F.row_number().over(w)))
    return marked.withColumn("valid_to", F.when(F.col("__gone") & (F.col("__n") == 1), when).otherwise(F.col("valid_to"))).select(*facts.columns)


def difference(facts: DataFrame, start: Column, end: Column) -> DataFrame:
    """(s, p, o, change) of what was added and removed between two times."""
    a, b = at(facts, start).select("s", "p", "o"), at(facts, end).select("s", "p", "o")
    return b.subtract(a).withColumn("change", F.lit("added")).unionByName(a.subtract(b).withColumn("change", F.lit("removed")))


def sequences(first: DataFrame, then: DataFrame, iso: str, by: list[str], *, time: str = "valid_from") -> DataFrame:
    """Pairs (keys, t1, t2) of events with the same keys where the second is after the first by at most the duration.

    Time is cut into buckets as long as the duration: an event meets only those of its own and the next bucket.
    """
    width = int(duration(iso).total_seconds())
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / F.lit(1e6)
    a = first.select(*by, F.col(time).alias("t1")).withColumn("k", F.explode(F.array(F.floor(seconds(F.col("t1")) / width), F.floor(seconds(F.col("t1")) / width) + 1)))
    b = then.select(*by, F.col(time).alias("t2")).withColumn("k", F.floor(seconds(F.col("t2")) / width))
    return a.join(b, [*by, "k"]).where((F.col("t2") > F.col("t1")) & (F.col("t2") <= F.col("t1") + F.lit(duration(iso)))).drop("k")


def consecutive(events: DataFrame, n: int, iso: str, by: list[str], *, time: str = "valid_from", sliding: bool = True) -> DataFrame:
    """Distinct keys with n events in a row inside the duration. sliding: any n in a row, else counted from the first event."""
    w = Window.partitionBy(*by).orderBy(time)
    if sliding:
        return events.withColumn("__t", F.lag(time, n - 1).over(w)).where(F.col(time) <= F.col("__t") + F.lit(duration(iso))).select(*by).distinct()
    return events.withColumn("__n", F.row_number().over(w)).withColumn("__f", F.first(time).over(w)).where((F.col("__n") == n) & (F.col(time) <= F.col("__f") + F.lit(duration(iso)))).select(*by).distinct()


def longer_than(facts: DataFrame, iso: str) -> DataFrame:
    """Closed facts that were valid for longer than the duration."""
    return facts.where(F.col("valid_to") > F.col("valid_from") + F.lit(duration(iso)))


def allen(relation: str, a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """One of Allen's relations between two intervals: before, meets, overlaps, during, finishes, starts, equals."""
    return ALLEN[relation](*a, *b)


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str) -> DataFrame:
    """Each left row with the latest right row (struct ``match``) of the same keys that isn't later."""
    marked = left.withColumn("__l", F.lit(True)).withColumn("__t", F.col(left_time)).withColumn("__r", F.lit(None).cast(right.select(F.struct("*").alias("r")).schema["r"].dataType))
    other = right.select(*by, F.col(right_time).alias("__t"), F.struct("*").alias("__r"))
    both = marked.unionByName(other, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("__t", F.col("__l").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("match", F.last("__r", True).over(w)).where("__l").drop("__l", "__t", "__r")
