"""A training corpus from raw documents: language ID, near-dedup, decontamination, surrogates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import decontamination, langid, neardup, packing, pii
from orrery.llm.frames import table, written
from orrery.session import ready

#: Documents go if their language is undetermined or its probability is below this.
MIN_SCORE = 0.4
#: Up to so many removed ids are broadcast; more are joined with a shuffle.
BROADCAST_IDS = 500_000
KEY = b"a key for the pipeline of this repository"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a sure language; a missing language is filled in."""
    ready(spark)
    columns = docs.columns
    model = langid.fit(docs, F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    found = langid.identify(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the smallest id, of each group of near duplicates (five words, similarity 0.8).

    Rows that repeat an id are one document: of those that are kept, the one with the least text stays. Null ids are kept.
    """
    ready(spark)
    groups = neardup.groups_of(docs.select("doc_id", "text"), neardup.Rule(words=5, percent=80))
    gone = written(groups.where(~F.col("kept")).select("doc_id").distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    order = F.struct(F.col("text").isNull(), "text", F.to_json(F.struct(*docs.columns)))
    once = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias("x")).select("x.*")
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a ten-word window of a benchmark item."""
    ready(spark)
    columns = docs.columns
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("n_hit = 0").select(*columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts surrogates in place of personal data."""
    ready(spark)
    columns = docs.columns
    return pii.surrogates(docs, KEY, entities=None).withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 2048 tokens."""
    ready(spark)
    out = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("PII", replace_personal_data),
    ("best-fit packing", pack),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = table(ready(spark), sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
