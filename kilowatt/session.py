"""Session helpers: defaults that matter at scale, and the shared scratch area.

Library functions never override settings a cluster already has. The
builder here is for tests, the bench and runs on one machine; on a cluster
the caller's session is used as it is.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings applied only when the session has none of its own.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    master: str | None = None,
    app: str = "kilowatt",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with scale-safe defaults.

    ``shuffle_partitions`` should follow the data: roughly input bytes /
    128 MB for the widest shuffle. AQE coalesces small partitions at run
    time, so erring high is cheaper than erring low.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    use_own_folder(spark)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    ``spark.checkpoint.dir`` is read from the session; without it this is an
    error, because a folder of one machine would not survive the loss of an
    executor. Tests, the bench and the driver entry name one with
    :func:`use_own_folder` where the session has none.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise RuntimeError("spark.checkpoint.dir is unset; name a folder that all executors share")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def use_own_folder(spark: SparkSession) -> None:
    """Give a session that names no checkpoint folder a new one (one machine only)."""
    sc = spark.sparkContext
    one_machine = sc.master == "local" or sc.master.startswith("local[")
    if one_machine and not sc.getCheckpointDir() and not spark.conf.get("spark.checkpoint.dir", None):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kilowatt-ckpt-"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint area.

    Queries that write and read back files (round trips, sinks) put them
    here, so every executor sees the same path.
    """
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/kilowatt-scratch/{name}-{uuid.uuid4().hex}"
