"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, app: str = "provend",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE and skew-join handling switched on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting (tests) gets a fresh folder of
    its own; a cluster session without it is an error, because a machine-local
    folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running provend jobs")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="provend-ckpt-"))
    return sc.getCheckpointDir()


@contextmanager
def scratch_folder(spark: SparkSession) -> Iterator[str]:
    """All that is staged or checkpointed inside the block goes to one folder, deleted at its end.

    Results made in the block read from it, so they must be written before it ends.
    """
    from provend import files
    sc, base = spark.sparkContext, ensure_checkpoint_dir(spark)
    folder = os.path.join(base, f"run-{uuid.uuid4().hex[:12]}")
    sc.setCheckpointDir(folder)
    try:
        yield folder
    finally:
        sc.setCheckpointDir(base)
        files.delete(spark, folder)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "provend-scratch", f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder.

    Used where a result is read several times (sampling, counting, the main
    pass) so the upstream scan and shuffle run once and a lost executor does
    not force a recomputation from the raw input.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts lineage like ``checkpoint()`` but keeps a columnar, prunable table; used
    for large intermediates that several later passes read (and that must not be
    recomputed, e.g. because they carry a generated row-order key).
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def held_splits(spark: SparkSession) -> Iterator[None]:
    """Files read several times inside the block are cut into the same splits each time, also if executors come or go."""
    name = "spark.sql.files.minPartitionNum"
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(name)


def bound_batches(spark: SparkSession, size: str = "4m") -> None:
    """Let at most ``size`` of rows go to a Python worker at once, where the session does not say otherwise.

    Spark's default lets 64 MB go at once, of which the JVM and the worker both hold copies for every task.
    """
    name, default = "spark.sql.execution.arrow.maxBytesPerBatch", "64"
    if spark.conf.get(name).lower().rstrip("b").removesuffix("m") in (default, str(64 << 20)):
        spark.conf.set(name, size)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition rows by ``keys`` into ``spark.sql.shuffle.partitions`` parts ahead of a CPU-heavy
    ``mapInPandas`` stage (rows are whole groups, e.g. one series per row).

    The partition expression is ``xxhash64(keys)`` rather than the bare keys: a repartition on
    exactly the keys an upstream aggregate already hashed on is dropped by the optimizer, and the
    aggregate's small shuffle is then coalesced by AQE into very few tasks, serialising the work.
    An explicit-count repartition on a new expression is kept and not coalesced.
    """
    from pyspark.sql import functions as F
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, F.xxhash64(*keys))


def ensure_parallel(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition only when ``df`` has fewer partitions than the cluster's default parallelism.

    For CPU-heavy per-row stages (hashing for samples, vectorised Python scoring): on a large
    input with many splits this is a no-op, on a single-split input it spreads the rows.
    """
    from pyspark.sql import functions as F
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, F.xxhash64(*keys)) if keys else df.repartition(target)
