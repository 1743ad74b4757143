"""Streaming k-means (DAT10) with Structured Streaming.

Points arrive as files; the centers are driver state, as the caller gives
them. Each micro-batch is assigned to the nearest current center and reduced to per-cluster (count, vector sum) by a
distributed aggregation. Only those k rows reach the driver. Centers then
move by the forgetful update

    c' = (c * n * a + s) / (n * a + m),   n' = n * a + m

with decay ``a`` (1.0 = plain running mean; 0 = only the newest batch).

Fault tolerance: after each batch the centers are written, with the batch
id, under the session's shared checkpoint folder next to the stream's own
checkpoint. A restarted query resumes from the last written state and
skips batches it has already applied, so a replayed batch is not counted
twice. :func:`score_stream` scores another stream with these versions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kilowatt.functions.vectors import nearest_of
from kilowatt.operators.metrics import literal_rows
from kilowatt.session import scratch_path


def _load_state(spark: SparkSession, state_dir: str):
    try:
        st = spark.read.parquet(state_dir)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # any other fault must not look like a fresh start
            raise
        return None
    last = st.agg(F.max("batch_id")).first()[0]
    if last is None:
        return None
    rows = st.where(F.col("batch_id") == last).orderBy("cluster").collect()
    return last, [list(r["center"]) for r in rows], [float(r["weight"]) for r in rows]


def stream_kmeans(
    spark: SparkSession,
    source_dir: str,
    schema: StructType | str,
    features: str,
    init_centers: Sequence[Sequence[float]],
    decay: float = 1.0,
    max_files_per_trigger: int = 1,
    work_dir: str | None = None,
) -> DataFrame:
    """Run the stream over every file now in ``source_dir`` (availableNow)
    and return the final centers as rows (cluster, slot, value, weight)."""
    k, dim = len(init_centers), len(init_centers[0])
    work = work_dir or scratch_path(spark, "stream-kmeans")
    state_dir, ckpt = f"{work}/state", f"{work}/checkpoint"
    restored = _load_state(spark, state_dir)
    state = {
        "batch": restored[0] if restored else -1,
        "centers": restored[1] if restored else [list(map(float, c)) for c in init_centers],
        "weights": restored[2] if restored else [0.0] * k,
    }

    def update(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= state["batch"]:
            return  # already applied (replay after a restart)
        x = F.col(features).cast("array<double>")
        known = literal_rows([Row(cluster=i, center=c) for i, c in enumerate(state["centers"])], "cluster:int,center:array<double>")
        assigned = batch.select(nearest_of(x, known)["c"].alias("cluster"), x.alias("x"))
        # one pass: per (cluster, slot) the sum, and the point count (each
        # point gives one row per slot)
        per = assigned.select("cluster", F.posexplode("x").alias("slot", "v")).groupBy("cluster", "slot").agg(
            F.sum("v").alias("s"), F.count(F.lit(1)).alias("m")
        )
        counts: dict[int, int] = {}
        sums: dict[int, list[float]] = {}
        for r in per.collect():  # k * dim rows at most
            sums.setdefault(r["cluster"], [0.0] * dim)[r["slot"]] = r["s"]
            counts[r["cluster"]] = r["m"]
        centers, weights = [list(c) for c in state["centers"]], list(state["weights"])
        for c, m in counts.items():
            n = weights[c] * decay
            centers[c] = [(cv * n + sv) / (n + m) for cv, sv in zip(centers[c], sums[c])]
            weights[c] = n + m
        rows = [(batch_id, i, centers[i], weights[i]) for i in range(k)]
        spark.createDataFrame(rows, "batch_id long, cluster int, center array<double>, weight double") \
            .coalesce(1).write.mode("append").parquet(state_dir)  # one file: a reader sees a version whole or not at all
        state.update(batch=batch_id, centers=centers, weights=weights)

    stream = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir)
    )
    query = (
        stream.writeStream.foreachBatch(update).option("checkpointLocation", ckpt)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = [
        (i, j, float(v), float(state["weights"][i]))
        for i, c in enumerate(state["centers"]) for j, v in enumerate(c)
    ]
    return spark.createDataFrame(rows, "cluster int, slot int, value double, weight double")


def score_stream(
    spark: SparkSession,
    source_dir: str,
    schema: StructType | str,
    features: str,
    model_dir: str,
    max_files_per_trigger: int = 1,
    work_dir: str | None = None,
) -> DataFrame:
    """Run a stream over every file now in ``source_dir`` and return its rows
    with ``cluster``, the nearest center, and ``model_batch``, the version of the
    centers that scored them.

    ``model_dir`` is the ``work_dir`` of a :func:`stream_kmeans`, which may run at
    the same time: each micro-batch reads the newest version of the centers that is written
    there, so all rows of a batch have one version. A batch's rows go to a
    folder of its own; a batch that is run again after a restart replaces its
    folder, and no row is there twice. Rows with a null vector have a null cluster.
    Without any written version it is an error.
    """
    work = work_dir or scratch_path(spark, "stream-score")
    out_path = f"{work}/scored"

    def score(batch: DataFrame, batch_id: int) -> None:
        newest = _load_state(spark, f"{model_dir}/state")
        if newest is None:
            raise RuntimeError(f"no centers are written in {model_dir}")
        known = literal_rows([Row(cluster=i, center=c) for i, c in enumerate(newest[1])], "cluster:int,center:array<double>")
        x = F.col(features).cast("array<double>")
        near = F.when(x.isNotNull(), nearest_of(x, known)["c"]).cast("int")
        scored = batch.withColumns({"cluster": near, "model_batch": F.lit(newest[0]).cast("long")})
        scored.write.mode("overwrite").parquet(f"{out_path}/stream_batch={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir)
    query = stream.writeStream.foreachBatch(score).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out_path).drop("stream_batch")
