"""Corpus pipeline: from raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. All but
the last return the columns of ``documents``; the last returns one row per packed piece.

1. quality rules: documents that fail a rule go
2. SimHash near-dedup: one document of each class stays (the smallest id)
3. suffix-array dedup: passages that repeat earlier ones are cut out; ``n_chars`` follows the
   text, and a document with no word left goes
4. mixing: documents are taken 0 to 3 times, so that sources meet their targets
5. best-fit packing of the token ids
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import mixing, packing, quality, simhash, suffix
from riskloom.session import ensure_checkpoint_dir, materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_rules(docs, verdict="_verdict").where("_verdict.kept").drop("_verdict")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return simhash.keep_first(docs, shingle=3, max_bits=3)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return suffix.remove_repeated(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return mixing.take(mixing.mix_sources(docs, weights=(1, 2, 3), cap=3, added="_mix"), "_mix")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return packing.pack_documents(docs, capacity=4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("simhash near-dedup", simhash_stage),
    ("suffix-array dedup", suffix_stage),
    ("mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Fingerprints, suffix order and the tokenizer are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written and read again."""
    ensure_checkpoint_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
