"""Table sources: one Parquet file or folder per table under a base directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The table ``name`` under ``base``; columns and filters are pruned by the scan."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def as_instant(df: DataFrame, *columns: str) -> DataFrame:
    """Cast zone-less timestamps to instants (the session zone is UTC)."""
    return df.withColumns({c: df[c].cast("timestamp") for c in columns})
