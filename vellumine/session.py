"""Session helpers: the tuned local session used by tests and benches, and lineage cuts."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("vellumine")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent (tests, one-machine runs) a folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        own = os.path.join(tempfile.gettempdir(), f"vellumine-checkpoints-{os.getuid()}")
        os.makedirs(own, exist_ok=True)
        spark.sparkContext.setCheckpointDir(own)
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder; later uses read that copy.

    The copy survives the loss of any executor, unlike a cached or locally checkpointed one.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def as_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read back: unlike a checkpoint
    it is compressed, and later uses read only the columns they need."""
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that are gone, which it does once the driver has
    collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
