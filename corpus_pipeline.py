"""From raw documents to packed training sequences, a stage at a time.

Each stage reads the Parquet files its predecessor wrote, works on every row
of them and decides for itself: toxic documents go, documents of low quality
go, one document of each group of near-duplicates stays, and what is left is
packed. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilowatt.llm import minhash, packing, quality, toxicity
from kilowatt.llm.shared import shared_folder

TOXIC = 0.5


def _kept(scored: DataFrame, columns: list[str], condition: "F.Column") -> DataFrame:
    return scored.where(condition).select(columns)


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents scored as toxic by weights fitted on ``labels``."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = _free(docs, "__toxicity")
    return _kept(toxicity.score(docs, model, out=out), docs.columns, F.col(out) < TOXIC)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the weakly trained scorer finds bad."""
    model = quality.fit(docs)
    out = _free(docs, "__quality_score")
    return _kept(quality.score(docs, model, out=out), docs.columns, F.col(out) >= quality.KEEP)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates."""
    return minhash.drop_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens, with their token ids."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_dedup", drop_copies),
    ("packing", pack),
]

#: Learned scores and tokenization are beyond SQL; tests/llm checks run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet to the
    shared folder and read again as the next stage's documents."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        # row groups of 16 MB: a writer holds one of them in memory
        stage(spark, docs, sf_dir).write.option("parquet.block.size", 16 << 20).parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
