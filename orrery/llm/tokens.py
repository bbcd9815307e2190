"""Token counts kept as rollups by source, language and tokenizer version, maintained by signed deltas.

A batch of changes becomes signed rows: an insert counts plus, a delete minus, a revision minus the old and plus the new
count. Signed rows are added up by key before anything is stored, so a batch costs its own size and never a rescan of the
corpus. A batch is committed under its id: its sums are written beside the store and moved into place in one rename, and an
id that is there already is left as it is. Totals are the sums over all committed batches, in any order; ``compact``
replaces batches by their sum and remembers their ids.

Texts that are null or empty have no tokens and count as documents. Null sources and languages are groups of their own.
Repeated rows count each. Keys whose totals are all zero are not reported.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .frames import append
from .wordbpe import encoder

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_chars"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"


def version(path: str, name: str) -> str:
    """The tokenizer's name with a digest of its file."""
    with open(path, "rb") as f:
        return f"{name}@{hashlib.sha256(f.read()).hexdigest()[:12]}"


def counted(docs: DataFrame, tokenizer: str, *, text: str = "text", into: str = "n_tokens", keep: list[str] | None = None) -> DataFrame:
    """docs with the number of ids that the word-level tokenizer file gives for the whole text."""

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        code = encoder(tokenizer)
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        size = np.concatenate(([0], np.cumsum([len(t) if t else 0 for t in texts]))).astype(np.int64)
        out = [np.diff(code.encode([t or "" for t in texts[a:b]])[1]) for a, b in K.chunks(size)]
        return [pa.array(np.concatenate(out) if out else np.zeros(0, np.int64), pa.int64())]

    return append(docs.withColumn(text, F.col(text).cast("string")), T.StructType([T.StructField(into, T.LongType())]), compute, keep)


def signed(rows: DataFrame, sign: int, *, source: str | Column = "source", lang: str | Column = "lang", tokenizer: str | Column = "tokenizer", tokens: str | Column = "n_tokens", chars: str | Column = "n_chars") -> DataFrame:
    """Delta rows of documents that come (sign 1) or go (-1)."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    number = lambda c: F.coalesce(col(c).cast("long"), F.lit(0)) * sign
    return rows.select(col(source).cast("string").alias("source"), col(lang).cast("string").alias("lang"), col(tokenizer).cast("string").alias("tokenizer"), F.lit(sign).cast("long").alias("n_docs"), number(tokens).alias("n_tokens"), number(chars).alias("n_chars"))


def deltas(*, inserted: DataFrame | None = None, deleted: DataFrame | None = None, revised: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Signed rows of a batch. revised: the rows as they were and as they are now, in tables of counted documents."""
    parts = [signed(x, s) for x, s in ((inserted, 1), (deleted, -1), *(((revised[0], -1), (revised[1], 1)) if revised else ())) if x is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])


class Rollups:
    """A store of committed batches in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @staticmethod
    def _name(batch: str) -> str:
        return "batch=" + hashlib.sha256(batch.encode()).hexdigest()[:32]

    def _names(self) -> list[str]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        return sorted(n for f in self._fs.listStatus(self._path(self.folder)) if (n := f.getPath().getName()).startswith(("batch=", "sum=")))

    def _replaced(self, names: list[str]) -> set[str]:
        """Batches that a sum holds; a sum that a later sum holds, too."""
        gone: set[str] = set()
        for n in names:
            if n.startswith("sum="):
                lines = self.spark.read.text(f"{self.folder}/{n}/members").collect()
                gone |= set(json.loads(lines[0].value))
        return gone

    def committed(self, batch: str) -> bool:
        names = self._names()
        return self._name(batch) in names or self._name(batch) in self._replaced(names)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch once. False if its id is there already. A commit that dies leaves nothing that is read."""
        if self.committed(batch):
            return False
        aside = f"{self.folder}/_aside-{uuid.uuid4().hex}"
        summed(changes).coalesce(1).write.parquet(aside)
        return self._put(aside, self._name(batch))

    def _put(self, aside: str, name: str) -> bool:
        """Gives a folder its name, if no other writer has taken it; else deletes the folder."""
        where = f"{self.folder}/{name}"
        if not self._fs.exists(self._path(where)) and self._fs.rename(self._path(aside), self._path(where)):
            # a rename onto a folder that another writer has just made puts ours inside it: take it out again
            inner = self._path(f"{where}/{aside.rsplit('/', 1)[1]}")
            if not self._fs.exists(inner):
                return True
            self._fs.delete(inner, True)
            return False
        self._fs.delete(self._path(aside), True)
        return False

    def totals(self) -> DataFrame:
        names = self._names()
        gone = self._replaced(names)
        live = [f"{self.folder}/{n}" + ("/rows" if n.startswith("sum=") else "") for n in names if n not in gone]
        if not live:
            return self.spark.createDataFrame([], SCHEMA)
        return summed(self.spark.read.schema(SCHEMA).parquet(*live)).where("n_docs <> 0 or n_tokens <> 0 or n_chars <> 0")

    def compact(self) -> None:
        """Replaces all batches so far by their sum. Batches that are committed meanwhile stay beside it.

        A sum is named by its generation. Of compactions that start from the same one, the first to end counts; the others
        find its name taken and leave nothing.
        """
        names = self._names()
        gone = self._replaced(names)
        live = [n for n in names if n not in gone]
        if len(live) < 2:
            return
        aside = f"{self.folder}/_aside-{uuid.uuid4().hex}"
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.folder}/{n}" + ("/rows" if n.startswith("sum=") else "") for n in live])
        summed(rows).coalesce(1).write.parquet(f"{aside}/rows")
        held = sorted(set(live) | gone)
        self.spark.createDataFrame([(json.dumps(held),)], "value string").coalesce(1).write.text(f"{aside}/members")
        self._put(aside, f"sum={1 + max((int(n[4:]) for n in names if n.startswith('sum=')), default=0):09d}")
