"""Applying a feed of creates, updates and deletes (problem 5) as a signed multiset.

Every change that holds contributes the image it replaces with multiplicity -1 and the image it
leaves with multiplicity +1.  The multiplicities are summed with those of the base table; the rows
whose sum is positive are the current state.

Which changes hold is a fold over each key in feed order: a change is void if both it and the state
have a revision and its own isn't greater.  The fold is a segmented running maximum: a change
without a revision always holds and clears the stored one, so it opens a new segment, and within a
segment a change holds iff its revision exceeds every earlier one.

The fold runs as a two-level scan so that one key may hold any share of the feed: a key's changes
are cut into blocks by their order number, each block is scanned on its own, and only one summary
row per (key, block) travels to the scan over blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order numbers per block: a task never scans more than this many changes of one key at a time.
BLOCK = 1 << 18


def _has(rev: Column) -> Column:
    return rev.isNotNull() & (rev != "")


#: Blocks of the base table and of changes without an order number; both come before all others.
_BASE_BLOCK, _UNORDERED_BLOCK = -(1 << 62), -(1 << 62) + 1


def _marked(feed: DataFrame, keys: list[str], order: str, rev: str, base: DataFrame | None, block: int) -> DataFrame:
    """``feed``'s columns but ``keys``, with ``_key`` (a struct, whose nulls compare as equal), ``_block`` and ``_applied``."""
    rest = [c for c in feed.columns if c not in (*keys, order, rev)]
    text = F.to_json(F.struct(*rest)) if rest else F.lit("")
    number = F.coalesce(F.floor(F.col(order) / F.lit(block)).cast("long"), F.lit(_UNORDERED_BLOCK))
    e = feed.select(F.struct(*keys).alias("_key"), number.alias("_block"), order, rev, *rest, F.when(_has(F.col(rev)), F.col(rev)).alias("_rev"), F.lit(False).alias("_base"))
    if base is not None:
        first = base.select(F.struct(*keys).alias("_key"), F.lit(_BASE_BLOCK).alias("_block"), F.when(_has(F.col(rev)), F.col(rev)).alias("_rev"), F.lit(True).alias("_base"))
        e = e.unionByName(first, allowMissingColumns=True)
    # one exchange serves the scan in blocks, the block summaries and the join back
    cell = ["_key", "_block"]
    e = e.repartition(*cell)
    feed_order = [F.col(order).asc_nulls_first(), F.col("_rev").asc_nulls_first(), text.asc_nulls_first()]
    w = Window.partitionBy(*cell).orderBy(*feed_order)
    e = e.withColumn("_again", F.coalesce(F.lag(F.col(order)).over(w) == F.col(order), F.lit(False))).filter("not _again")
    e = e.withColumn("_seg", F.sum(F.when(F.col("_rev").isNull() & ~F.col("_base"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    in_seg = Window.partitionBy(*cell, "_seg").orderBy(*feed_order).rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("_before", F.max("_rev").over(in_seg))

    ends = e.groupBy(*cell).agg(F.max(F.struct("_seg", "_rev")).alias("_end"))
    over_blocks = Window.partitionBy("_key").orderBy("_block")
    ends = ends.withColumn("_run", F.sum(F.when(F.col("_end._seg") > 0, 1).otherwise(0)).over(over_blocks.rowsBetween(Window.unboundedPreceding, 0)))
    in_run = Window.partitionBy("_key", "_run").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("_left", F.max("_end._rev").over(in_run))
    entries = ends.select(*cell, F.lag("_left").over(over_blocks).alias("_entry")).filter("_entry is not null")

    e = e.join(entries, cell, "left")
    prior = F.when(F.col("_seg") == 0, F.greatest(F.col("_before"), F.col("_entry"))).otherwise(F.col("_before"))
    applied = F.col("_rev").isNull() | prior.isNull() | (F.col("_rev") > prior)
    return e.filter("not _base").select(*cell, order, rev, *rest, applied.alias("_applied"))


def mark_applied(
    feed: DataFrame,
    keys: Sequence[str],
    order: str = "id",
    rev: str = "rev",
    base: DataFrame | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """``feed`` without repeated rows, plus ``applied`` (boolean).

    Repeated rows (equal ``order``) count once; of differing rows under one order number and key
    the first by revision, then by all other columns, counts.  A null order number comes first.
    Keys may hold nulls, which compare as equal.  A null or empty revision is no revision.
    ``base`` has ``keys`` and ``rev`` and is the state before the feed, dead keys included.  An
    empty feed gives an empty result.  Other columns pass through; names beginning with an
    underscore and ``applied`` are reserved.
    """
    clash = [c for c in feed.columns if c.startswith("_") or c == "applied"]
    if clash:
        raise ValueError(f"reserved column names: {clash}")
    keys = list(keys)
    out = _marked(feed, keys, order, rev, base, block)
    columns = [F.col("_key")[c].alias(c) if c in keys else F.col(c) for c in feed.columns]
    return out.select(*columns, F.col("_applied").alias("applied"))


def apply_changes(
    feed: DataFrame,
    keys: Sequence[str],
    image: Sequence[str],
    order: str = "id",
    rev: str = "rev",
    action: str = "action",
    base: DataFrame | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """The current state of a table: ``keys`` and ``image`` of the rows alive after the feed.

    ``base`` (optional) has ``keys``, ``image``, ``rev`` and may have ``deleted`` (boolean): dead
    rows guard their key by ``rev`` but have multiplicity 0.  ``rev`` may be part of ``image``.  A
    null action counts as a write.  For nulls, repeated rows and ties see :func:`mark_applied`;
    other columns of the feed are not read.

    Before-images are taken within a block where possible; one row per (key, block) carries the
    image across blocks, so no key is ever gathered in one task.
    """
    keys, image = list(keys), [c for c in image if c not in keys]
    need = list(dict.fromkeys([*keys, order, rev, action, *image]))
    if base is not None:
        base = base.select(*[c for c in base.columns if c in (*keys, *image, rev, "deleted")])
        base = base if "deleted" in base.columns else base.withColumn("deleted", F.lit(False))
    marked = _marked(feed.select(*need), keys, order, rev, base, block).filter("_applied")
    alive = F.coalesce(F.col(action) != "delete", F.lit(True))
    cell = ["_key", "_block"]
    w = Window.partitionBy(*cell).orderBy(F.col(order).asc_nulls_first())
    held = marked.select(*cell, order, F.when(alive, F.struct(*image)).alias("_after")).withColumn("_prior", F.lag("_after").over(w))

    both = F.array(F.struct(F.col("_after").alias("i"), F.lit(1).alias("n")), F.struct(F.col("_prior").alias("i"), F.lit(-1).alias("n")))
    signed = held.select("_key", F.explode(both).alias("_s"))
    carried = held.groupBy(*cell).agg(F.max_by("_after", F.struct(F.col(order).isNotNull(), F.col(order))).alias("_after"))
    if base is not None:
        standing = base.select(F.struct(*keys).alias("_key"), F.when(~F.col("deleted"), F.struct(*image)).alias("_after")).distinct()
        signed = signed.unionByName(standing.select("_key", F.struct(F.col("_after").alias("i"), F.lit(1).alias("n")).alias("_s")))
        carried = carried.unionByName(standing.withColumn("_block", F.lit(_BASE_BLOCK)))
    over_blocks = Window.partitionBy("_key").orderBy("_block")
    across = carried.withColumn("_prior", F.lag("_after").over(over_blocks)).filter("_prior is not null")
    signed = signed.unionByName(across.select("_key", F.struct(F.col("_prior").alias("i"), F.lit(-1).alias("n")).alias("_s")))

    total = signed.filter("_s.i is not null").groupBy("_key", F.col("_s.i").alias("_i")).agg(F.sum("_s.n").alias("_n"))
    return total.filter("_n > 0").select(*[F.col("_key")[c].alias(c) for c in keys], *[F.col("_i")[c].alias(c) for c in image])
