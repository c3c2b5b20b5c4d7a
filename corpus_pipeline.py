"""Corpus preparation as stages over ``documents``.

Each stage is a function of (spark, docs, sf_dir). Its result is written as
Parquet and read again as the next one's docs, so a stage starts from files that
all executors reach.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislecast.llm import decontaminate, lines, near_copies, quality, trie_bpe
from aislecast.llm.text import table, with_columns
from aislecast.session import importable_by_workers, remove_path, work_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go. It is fitted on the labelled ones that are not held out."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model, carry=COLUMNS).where("predicted = 1").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them alone; n_chars is counted anew."""
    rows = lines.drop_repeated_lines(docs)
    return with_columns(rows, n_chars=F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id.

    Rows that repeat a doc_id stay or go together; a row without one stays.
    """
    gone = near_copies.near_copies(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.find_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where("not contaminated").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document that is left, and digests of them and of the decoded text."""
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = trie_bpe.encode_and_decode(docs, path, with_ids=True, carry=["doc_id"])
    return rows.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("bpe_encoding", encode),
]

# The stages fit a classifier and encode with a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each one's input is removed when its result is written."""
    importable_by_workers(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
