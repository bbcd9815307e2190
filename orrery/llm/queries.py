"""The queries of this subpackage: thin wrappers that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html, langid, neardup, oracles, packing, pii, quality, tokens, toxicity, urls
from .frames import scratch, table

Query = Callable[[SparkSession, str], DataFrame]


RULES = [
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
]
#: Of this repository's queries only: a deployment keeps its own key secret.
DEMO_KEY = b"a key for the queries of this repository"


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return html.extract(pages, keep=["page_id"])


def bad_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a label: a url's last path segment, with or without an extension, names the document that the page shows, which may have a quality."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    named = F.regexp_extract(urls.path_of(F.col("url")), r"/(\d{1,18})(?:\.[A-Za-z][A-Za-z0-9]*)?/?$", 1)
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    return pages.withColumn("doc_id", F.when(named != "", named.cast("long"))).join(labels, "doc_id", "left").select("page_id", "url", "bad")


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(bad_pages(spark, sf_dir), RULES, bad=F.col("bad"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "template")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.surrogates(docs, DEMO_KEY)
    return found.select("doc_id", "text", F.transform("entities", lambda e: F.struct(e["type"].alias("type"), e["start"].alias("start"), e["surrogate"].alias("surrogate"))).alias("entities"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "lang", "text")
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = tokens.counted(docs.withColumn("n_chars", F.length("text")), path, keep=["source", "lang", "n_chars"])
    rows = rows.withColumn("tokenizer", F.lit(tokens.version(path, "word_bpe_49k")))
    store = tokens.Rollups(spark, scratch(spark))
    store.commit("all documents", tokens.deltas(inserted=rows))
    return store.totals()


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.groups_of(docs, neardup.Rule(words=3, percent=85))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = langid.fit(docs, F.col("doc_id").isNotNull() & ~held_out)
    found = langid.identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def severity_labels(labels: DataFrame) -> DataFrame:
    """Grades from the label table: 0 not toxic, 1 toxic, 2 toxic in a text of low quality too."""
    return labels.select("doc_id", F.expr("case when toxic = 0 then 0 when toxic = 1 and coalesce(quality, 1) = 1 then 1 when toxic = 1 then 2 end").alias("grade"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, severity_labels(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model, keep=["doc_id"])


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.repetition(docs, keep=["doc_id"]).withColumn("n_gram_chars", F.array_join(F.col("n_gram_chars").cast("array<string>"), ","))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_html, op2_urls, op3_pii, op4_neardup, op5_tokens, op6_langid, op7_toxicity, op8_packing, op9_quality, op10_decontamination)}
ORACLE_SQL: dict[str, str] = {"op4_neardup": oracles.NEARDUP, "op9_quality": oracles.QUALITY, "op10_decontamination": oracles.DECONTAMINATION}
