"""Views that are kept up to date, change capture, rules that write back, and windows over streams."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.datalog import Rule, infer
from ..operators.lineage import shared_folder, written
from ..plans.parser import parse_query
from ..sources.quads import KEY, QuadStore


class View:
    """A materialised result. ``refresh`` replaces it in one step; readers see the old or the new rows."""

    def __init__(self, name: str, make: Callable[[], DataFrame]):
        self.name, self.make = name, make
        self.rows: DataFrame | None = None

    def refresh(self) -> DataFrame:
        self.rows = written(self.make())
        self.rows.createOrReplaceTempView(self.name)
        return self.rows


def sparql_view(store: QuadStore, name: str, text: str) -> View:
    """A view of a SELECT, CONSTRUCT, DESCRIBE or ASK query."""
    form = parse_query(text, store.prefixes).form
    make = {"select": store.select, "construct": store.construct, "describe": store.describe, "ask": lambda t: store.spark.range(1).select(F.lit(store.ask(t)).alias("answer"))}[form]
    return View(name, lambda: make(text))


def datalog_view(store: QuadStore, name: str, rules: list[Rule]) -> View:
    return View(name, lambda: infer(store.quads, rules).derived)


def extvp(quads: DataFrame, p1: str, p2: str, kind: str = "ss") -> DataFrame:
    """Statements of p1 that join with some statement of p2 on subject-subject, object-subject or subject-object."""
    a, b = quads.where(F.col("p") == p1), quads.where(F.col("p") == p2)
    left, right = {"ss": ("s", "s"), "os": ("o", "s"), "so": ("s", "o")}[kind]
    keys = b.select(F.col(right).alias("__k")).distinct()
    return a.join(keys, a[left] == keys["__k"], "left_semi")


class WriteBack:
    """CONSTRUCT rules whose results are kept in a graph, with who made what; rules run in order of what they read."""

    def __init__(self, store: QuadStore):
        self.store = store
        self.rules: dict[str, tuple[str, str, tuple[str, ...]]] = {}
        self.made: DataFrame | None = None

    def create(self, name: str, text: str, target: str, reads: tuple[str, ...] = ()) -> None:
        self.rules[name] = (text, target, reads)
        self.order()

    def order(self) -> list[str]:
        """Rules after those that write a graph they read; a cycle is an error."""
        left, out = dict(self.rules), []
        while left:
            free = [n for n, (_, _, reads) in left.items() if not any(t in reads and m != n for m, (_, t, _) in left.items())]
            if not free:
                raise ValueError("the rules feed each other in a cycle")
            out += free
            for n in free:
                del left[n]
        return out

    def run(self) -> None:
        parts = []
        for n in self.order():
            text, target, _ = self.rules[n]
            rows = written(self.store.construct(text).withColumn("g", F.lit(target)))
            self.store.add(rows, source=1)
            parts.append(rows.select(*KEY).withColumn("rule", F.lit(n)))
        for p in parts:
            self.made = p if self.made is None else self.made.unionByName(p)
        if self.made is not None:
            self.made = written(self.made.distinct())

    def drop(self, name: str) -> None:
        """Removes the rule and what no other rule has made."""
        self.rules.pop(name)
        if self.made is None:
            return
        own = self.made.where(F.col("rule") == name).drop("rule")
        rest = self.made.where(F.col("rule") != name)
        self.store.remove(own.join(rest.drop("rule"), KEY, "left_anti"))
        self.made = written(rest)


def changes(store: QuadStore, p: str | None = None, since: int = 0) -> DataFrame:
    """(op, s, p, o, g) of captured changes from an entry of the log on."""
    parts = [df.select(F.lit(op).alias("op"), *KEY) for op, df in store.log[since:]]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out if p is None else out.where(F.col("p") == p)


class Subscription:
    """A query that is asked again after changes; gives the rows that came and went. Failing consumers' rows are kept aside."""

    def __init__(self, store: QuadStore, text: str, consumer: Callable[[DataFrame, DataFrame], Any]):
        self.store, self.text, self.consumer = store, text, consumer
        self.last = written(store.select(text))
        self.dead: list[tuple[DataFrame, DataFrame, str]] = []

    def notify(self) -> None:
        now = written(self.store.select(self.text))
        came, went = now.exceptAll(self.last), self.last.exceptAll(now)
        self.last = now
        self._give(came, went)

    def _give(self, came: DataFrame, went: DataFrame) -> None:
        try:
            self.consumer(came, went)
        except Exception as e:  # kept for requeue
            self.dead.append((came, went, str(e)))

    def requeue(self) -> None:
        todo, self.dead = self.dead, []
        for came, went, _ in todo:
            self._give(came, went)


def winners(quads: DataFrame, prefer: list[Column]) -> DataFrame:
    """One statement for each subject and predicate where sources disagree: the first by the given order (latest, source priority, ...)."""
    from pyspark.sql import Window

    return quads.withColumn("__n", F.row_number().over(Window.partitionBy("s", "p").orderBy(*prefer))).where("__n = 1").drop("__n")


# -- windows over event streams (batch frames work alike)
def tumbling(events: DataFrame, time: str, size: str, by: list[str], aggs: list[Column], late: str | None = None) -> DataFrame:
    df = events.withWatermark(time, late) if late and events.isStreaming else events
    return df.groupBy(F.window(time, size).alias("w"), *by).agg(*aggs).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, *[c for c in _names(df, aggs)])


def sliding(events: DataFrame, time: str, size: str, step: str, by: list[str], aggs: list[Column], late: str | None = None) -> DataFrame:
    df = events.withWatermark(time, late) if late and events.isStreaming else events
    return df.groupBy(F.window(time, size, step).alias("w"), *by).agg(*aggs).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, *[c for c in _names(df, aggs)])


def sessions(events: DataFrame, time: str, gap: str, by: list[str], aggs: list[Column], late: str | None = None) -> DataFrame:
    df = events.withWatermark(time, late) if late and events.isStreaming else events
    return df.groupBy(F.session_window(time, gap).alias("w"), *by).agg(*aggs).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, *[c for c in _names(df, aggs)])


def _names(df: DataFrame, aggs: list[Column]) -> list[str]:
    return df.groupBy().agg(*aggs).columns


def distinct_within(events: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """A stream without repeats of keys that arrive within the delay."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def streamed(spark: Any, path: str, schema: Any, transform: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """Runs a stream over the Parquet files of a folder to its present end and gives what it wrote.

    State, offsets and output are in the shared folder, so that the stream survives lost executors and restarts.
    """
    import uuid

    base = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    out: list[str] = []

    def sink(batch: DataFrame, n: int) -> None:
        where = f"{base}/out/{n:06d}"
        batch.write.mode("overwrite").parquet(where)
        out.append(where)

    rows = transform(spark.readStream.schema(schema).parquet(path))
    q = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    shown = sorted(set(out))
    if mode == "complete":
        shown = shown[-1:]
    return spark.read.schema(rows.schema).parquet(*shown) if shown else spark.createDataFrame([], rows.schema)
