"""Streaming ingest: micro-batches of change events appended to the log, and snapshots from it.

Every batch is written under its number, so a batch delivered again after a failure replaces
itself; the fold tolerates repeated and reordered changes in any case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellumine.operators.archive import fold, numbered
from vellumine.sources.wire import stream_wire

#: Rows of one batch get numbers in a range of this size.
BATCH_SPAN = 1 << 32


class Archive:
    """An event log and the snapshots folded from it, as Parquet under one folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    @property
    def log_path(self) -> str:
        return f"{self.root}/events"

    def append(self, batch: DataFrame, number: int) -> None:
        """Write a batch of events as the log's part ``number``, in arrival order."""
        rows = batch.drop("type").withColumn("created_at", F.current_timestamp()).withColumn("arrival", F.monotonically_increasing_id())
        numbered(rows, "arrival", number * BATCH_SPAN + 1).drop("arrival").write.mode("overwrite").parquet(f"{self.log_path}/batch={number}")

    def log(self) -> DataFrame:
        return self.spark.read.parquet(self.log_path)

    def snapshot(self) -> DataFrame:
        return fold(self.log().drop("batch"))

    def write_snapshot(self, version: int) -> str:
        """The current records, by collection so that readers prune to the one they ask for."""
        path = f"{self.root}/records/version={version}"
        self.snapshot().repartition("collection").write.mode("overwrite").partitionBy("collection").parquet(path)
        return path

    def ingest(self, source: str, checkpoint: str, files_per_batch: int = 1, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
        """Take all event files now in ``source``; ``keep`` may drop blocked accounts' events."""
        events = stream_wire(self.spark, source, files_per_batch)
        return events.writeStream.foreachBatch(lambda df, n: self.append(keep(df), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tail(spark: SparkSession, log_path: str, deliver: Callable[[DataFrame, int], None], checkpoint: str, schema: str | None = None, files_per_batch: int = 100) -> StreamingQuery:
    """Follow the log: each new part goes to ``deliver`` in order, as often as needed to commit."""
    schema = schema or spark.read.parquet(log_path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(log_path)
    return rows.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_counts(events: DataFrame, watermark: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Events per collection and time window of a stream, with bounded state."""
    return events.withWatermark("created_at", watermark).groupBy(F.window("created_at", window), "collection").agg(F.count("*").alias("events"))
