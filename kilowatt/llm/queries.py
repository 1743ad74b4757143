"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilowatt.llm import ann, bpe, langid, minhash, mixing, oracle, packing, phrases, quality, toxicity, urls, vector_dedup, warc, whitening
from kilowatt.llm.shared import shared_folder


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(column: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    known = langid.fit(docs, where=_remainder("id", 3) != 1)
    found = langid.identify(docs.select("doc_id", "text"), known)
    return found.select("doc_id", F.coalesce(_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.decode(bpe.encode(_t(spark, sf_dir, "documents")))
    return ids.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_t(spark, sf_dir, "documents"))


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(_t(spark, sf_dir, "embeddings"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _t(spark, sf_dir, "pages")
    folder = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    warc.write_archives(pages, folder)
    kind = pages.schema["page_id"].dataType
    read = warc.captures(warc.read_archives(spark, folder))
    return read.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _t(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels, where=_remainder("id", 5) != 0)
    scored = toxicity.score(docs, model, out="score")
    return scored.select("doc_id", F.coalesce(_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_t(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs), out="score", weak_out="weak_posterior")
    return scored.select("doc_id", "score", "weak_posterior", (F.col("score") >= quality.KEEP).alias("kept"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_t(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_t(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_t(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_t(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(_t(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (
        op1_language_id, op2_bpe, op3_minhash, op4_vector_dedup, op5_warc, op6_toxicity, op7_url_filter, op8_quality, op9_packing, op10_ann,
        op11_mixing, op12_phrases, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
