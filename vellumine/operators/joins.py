"""A left join that survives hot keys on its left side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a single task may receive before the key is split.
HOT_ROWS = 1 << 20


def split_join(left: DataFrame, right: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join of ``left`` with ``right``, unique on ``keys``.

    Keys with over ``hot_rows`` left rows are spread over ``ceil(rows / hot_rows)`` salts, and
    their one right row is repeated once per salt; no row is dropped or sampled.  The counting
    aggregate combines before its shuffle, and at most ``rows / hot_rows`` keys come out of it.
    Null keys match nothing.
    """
    keys = list(keys)
    hot = left.groupBy(*keys).count().filter(F.col("count") > hot_rows)
    hot = hot.select(*keys, F.ceil(F.col("count") / hot_rows).cast("int").alias("_fan")).na.drop()
    salted = left.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_fan").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*left.columns), F.col("_fan")).cast("int"))).drop("_fan")
    spread = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_fan"), F.lit(1)) - 1))).drop("_fan")
    return salted.join(spread, [*keys, "_salt"], "left").drop("_salt")
