"""Lexicon scoring over a stream of texts (DAT11, stream-static join).

Texts arrive as files and are dealt out, since a trigger has a few files only;
term occurrences are counted per Arrow batch, so a common word is not a row per
occurrence, and joined with a static lexicon (stored once) by hash, so they are
not sorted; totals per group are
kept in the streaming state store (one row per group). Each batch's totals
are written by ``foreachBatch`` to a folder of its own under the shared
checkpoint folder; the newest is read when the stream has caught up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kilowatt.operators.partitioning import materialize
from kilowatt.operators.text import counted_terms
from kilowatt.session import scratch_path

#: Tasks into which the texts of a trigger are dealt.
TEXT_PARTS = 32


def stream_lexicon_totals(
    spark: SparkSession,
    source_dir: str,
    schema: StructType | str,
    lexicon: DataFrame,
    group: str,
    text: str = "text",
    max_files_per_trigger: int = 1,
    work_dir: str | None = None,
) -> DataFrame:
    """(group, n_docs, total_score, n_hits) over every file in ``source_dir``."""
    work = work_dir or scratch_path(spark, "stream-lexicon")
    out_path, ckpt = f"{work}/totals", f"{work}/checkpoint"
    lex = materialize(lexicon.select(F.col("term").alias("__term"), F.col("score").cast("long").alias("__score")))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir)
    counted = counted_terms(stream.select(group, text).repartition(TEXT_PARTS), group, text)
    hits = counted.join(lex.hint("shuffle_hash"), "__term").select(
        group, F.lit(0).cast("long").alias("__doc"), (F.col("__score") * F.col("__n")).alias("__score"), F.col("__n").alias("__hit")
    )
    zero = F.lit(0).cast("long")
    docs = stream.select(group, F.lit(1).cast("long").alias("__doc"), zero.alias("__score"), zero.alias("__hit"))
    totals = hits.unionByName(docs).groupBy(group).agg(
        F.sum("__doc").cast("long").alias("n_docs"), F.sum("__score").cast("long").alias("total_score"),
        F.sum("__hit").cast("long").alias("n_hits"),
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        # complete mode: every batch holds all groups, in a folder of its own; a
        # replayed batch writes its folder again, and no other is touched
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    query = (
        totals.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", ckpt)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    written = spark.read.parquet(out_path)
    newest = written.agg(F.max("batch")).first()[0]
    return written.where(F.col("batch") == newest).drop("batch")
