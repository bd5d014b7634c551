"""Corpus pipeline: quality rules, near-duplicate join, suffix-array dedup, decontamination, encoding.

Each stage reads what the stage before kept, as Parquet in the shared folder, and returns all columns of
its documents, the last one ids. Documents without text or words are rejected by the quality rules; so
later stages see none, unless called alone, where they leave such documents as they are. Of repeated rows
(one id and text) the second stage keeps one; rows with one id and other texts are judged each by itself,
but passages of one such row do not count as earlier than another's. An empty table gives an
empty result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.columns import quoted
from tablewright.llm._shared import stored
from tablewright.llm.bpe import bpe_encode
from tablewright.llm.decontaminate import decontaminate
from tablewright.llm.ngram_join import one_of_each_group
from tablewright.llm.quality import quality_filter
from tablewright.llm.suffix_dedup import remove_repeats

VOCABULARY = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated byte strings go; a character that was cut in two goes with them, and so do documents of which nothing is left.
    n_chars, where there is such a column, is counted anew."""
    cut = remove_repeats(docs, as_text=True).where((F.col("n_bytes") == 0) | (F.length("kept") > 0))
    made = {"doc_id": F.col("doc_id"), "text": F.when(F.col("n_bytes") > 0, F.col("kept")), "n_chars": F.length("kept").cast("long")}
    return cut.select(*[made[c].alias(c) if c in made else F.col(f"rest.{quoted(c)}") for c in docs.columns])


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of what is left."""
    ids = bpe_encode(docs, public_tokenizers.path(VOCABULARY))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("ngram_join", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontamination", benchmark_passages),
    ("bpe", encoded),
]

#: BPE cannot be written in SQL; tests/llm holds the rows against a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
