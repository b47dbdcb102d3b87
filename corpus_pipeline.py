"""A corpus pipeline: each stage reads what the one before it kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm import decontaminate, jaccard, language, pieces, secrets
from quadrat.llm.common import table
from quadrat.llm.queries import tokenizer_path
from quadrat.session import remove, shared_folder

#: A document whose best language has less than this share is rejected as undecided.
LEAST_SHARE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep documents that are written in one of the languages learned from the labelled ones."""
    found = language.train(language.taught_rows(docs))
    return language.keep(docs, found, least=LEAST_SHARE)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep one document of each group of near copies (five words, 0.8): the one with the smallest id.

    Rows are told apart by id and text, so two texts of one id are two documents and rows without an id take
    part; a row with an id goes before one without.  Of rows with one id and one text the first of the table stays.
    Texts without words are in no group, so all of them stay.  ``docs`` is read twice and must be a table, whose rows
    keep their order.  Where ids are known and occur once each, they say as much and are shorter keys.
    """
    rule = jaccard.Rule(words=5, percent=80)
    if docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        groups = jaccard.join(docs, rule=rule)
        first = groups.filter(F.col("doc_id") == F.col("component_id")).select("doc_id")
        return docs.join(first, "doc_id").select(docs.columns)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("digest"))
    keyed = docs.withColumn("__key", key).withColumn("__row", F.monotonically_increasing_id())
    groups = jaccard.join(keyed, key="__key", rule=rule)
    stays = groups.groupBy("__key").agg(F.max("n_shingles").alias("__n"), F.min("component_id").alias("__of")).filter("__n = 0 or __key = __of")
    first = keyed.groupBy("__key").agg(F.min("__row").alias("__first"))
    chosen = stays.join(first, "__key").select("__key", F.when(F.col("__n") > 0, F.col("__first")).alias("__first"))
    kept = keyed.join(chosen, "__key").filter(F.col("__first").isNull() | (F.col("__row") == F.col("__first")))
    return kept.select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents that hold half of a benchmark item or more."""
    return decontaminate.keep(docs, table(spark, folder, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Replace secrets in the texts; all documents stay."""
    return secrets.mask(docs)


def piece_encoding(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Encode the texts and decode them again; digests and counts of each document."""
    return pieces.encode(docs, pieces.load_vocabulary(tokenizer_path()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("piece_encoding", piece_encoding),
]

#: Neither code lengths, links nor merges can be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again; what the next stage has read is removed."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return docs
