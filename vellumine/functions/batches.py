"""Python operators on Arrow batches: of bounded size, on workers that have this package."""

from __future__ import annotations

import os
import zipfile
from pathlib import Path
from typing import Any

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch, beside Spark's own bound on its rows, so that very long texts can't fill a
#: Python worker; a single row may exceed it.
BATCH_BYTES = 32 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the session's Python workers, once, through Spark's own file server;
    whoever runs a query needn't have it on the workers' path."""
    context = spark.sparkContext
    if getattr(context, "_vellumine_shipped", False):
        return
    home = Path(__file__).resolve().parent.parent
    place = os.path.join(SparkFiles.getRootDirectory(), "code")
    os.makedirs(place, exist_ok=True)
    archive = os.path.join(place, f"{home.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(home.rglob("*.py")):
            z.write(file, file.relative_to(home.parent))
    context.addPyFile(archive)
    context._vellumine_shipped = True


def by_batch(df: DataFrame, run: Any, schema: Any) -> DataFrame:
    """``df.mapInArrow`` on batches of at most BATCH_BYTES, unless the session sets its own bound."""
    spark = df.sparkSession
    ship_package(spark)
    if spark.conf.get(_SETTING, None) is None:
        spark.conf.set(_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)
