"""References to rows that do not exist (problem 4).

A reference is a composite key some of whose parts may be null.  References are grouped by their
null mask; each mask is matched on its non-null columns only, against the table that mask refers
to.  ``match`` declares what a null means, after SQL's referential clauses: ``simple`` (a reference
with any null part refers to nothing and can't be an orphan), ``partial`` (the non-null parts must
match some row) or ``full`` (a reference with only some null parts is always an orphan).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.functions.uris import canonical_uri, uri_parts
from vellumine.operators.joins import HOT_ROWS, split_join


def orphan_references(
    references: DataFrame,
    keys: Sequence[str],
    target: DataFrame,
    match: str = "partial",
    other_targets: Mapping[tuple[str, ...], DataFrame] | None = None,
    created: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``references`` that lead nowhere, with a column ``reason``.

    ``target`` has ``keys`` and optionally ``deleted`` (boolean) and ``since`` (instant): a match
    is live if any matching row isn't deleted, and exists from the earliest ``since``.  The reason
    is ``missing``, else ``deleted``, else ``late`` (if ``created`` names the reference's time and
    the target exists only after it).  ``other_targets`` gives another table for the mask whose
    non-null columns are the given ones; there ``match`` doesn't apply.  A reference with all parts
    null refers to nothing and is no orphan.  Repeated references come out as often as they come
    in.  No references give no rows; an empty target makes every reference to it ``missing``.
    Other columns pass through; names beginning with an underscore and ``reason`` are reserved.

    Only masks that occur among the references are built on the target's side (at most
    ``2 ** len(keys) - 1`` of them, which bounds the one broadcast here).
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"unknown match semantics {match!r}")
    clash = [c for c in references.columns if c.startswith("_") or c == "reason"]
    if clash:
        raise ValueError(f"reserved column names: {clash}")
    keys, other = list(keys), dict(other_targets or {})
    full = (1 << len(keys)) - 1
    bit = {k: 1 << i for i, k in enumerate(keys)}
    apart = {sum(bit[k] for k in cols): frame for cols, frame in other.items()}

    mask = sum((F.when(F.col(k).isNotNull(), F.lit(bit[k])).otherwise(F.lit(0)) for k in keys), F.lit(0))
    masked = references.withColumns({"_mask": mask, "_key": F.struct(*keys)}).filter("_mask > 0")
    if match == "simple":
        masked = masked.filter(F.col("_mask").isin(full, *apart))
    occurring = F.broadcast(masked.select("_mask").distinct())

    own = [m for m in range(1, full + 1) if m not in apart and (m == full or match == "partial")]
    known = _projected(target, keys, bit, own).join(occurring, "_mask", "left_semi")
    for m, frame in apart.items():
        known = known.unionByName(_projected(frame, keys, bit, [m]))
    known = known.groupBy("_key").agg(F.min("_gone").alias("_gone"), F.min("_since").alias("_since"), F.lit(True).alias("_found"))

    joined = split_join(masked, known, ["_key"], hot_rows)
    late = F.col("_since") > F.col(created) if created else F.lit(False)
    reason = F.when(F.col("_found").isNull(), "missing").when(F.col("_gone"), "deleted").when(late, "late")
    return joined.withColumn("reason", reason).filter("reason is not null").select(*references.columns, "reason")


def _projected(frame: DataFrame, keys: list[str], bit: Mapping[str, int], masks: list[int]) -> DataFrame:
    """The key projections of ``frame`` for ``masks``, with nulls where a mask has no column."""
    have = frame.columns
    part = lambda k: F.when(F.col("_mask").bitwiseAND(bit[k]) != 0, F.col(k)) if k in have else F.lit(None).cast("string")
    return frame.withColumn("_mask", F.explode(F.array(*map(F.lit, masks)))).select(
        "_mask",
        F.struct(*[part(k).alias(k) for k in keys]).alias("_key"),
        (F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in have else F.lit(False)).alias("_gone"),
        (F.col("since") if "since" in have else F.lit(None)).cast("timestamp").alias("_since"),
    )


def orphan_links(links: DataFrame, records: DataFrame, accounts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Links of an archive that lead to no live, earlier record or to no known account.

    Out come ``link_id, reason, target_collection`` and ``created_at``, once per link: repeated
    rows of a link (equal ``id``) count once, the one with the least target and time.  What
    ``target_uri`` names decides; where it is null the columns ``target_did``,
    ``target_collection`` and ``target_rkey`` do.  A link that names nothing at all is ``missing``.
    A record counts as deleted if any of its repeated rows has ``deleted_at`` set, and as archived
    from its earliest ``indexed_at``.  A link without ``created_at`` is never ``late``.
    """
    refs = links.select(F.col("id").alias("link_id"), canonical_uri(F.col("target_uri")).alias("uri"), "target_did", "target_collection", "target_rkey", F.col("created_at").cast("timestamp").alias("created_at"))
    refs = refs.withColumn("parts", uri_parts(F.col("uri")))
    named = F.col("uri").isNotNull()
    refs = refs.select(
        "link_id",
        F.struct(
            F.when(named, F.get("parts", F.lit(0))).otherwise(F.col("target_did")).alias("did"),
            F.when(named, F.get("parts", F.lit(1))).otherwise(F.col("target_collection")).alias("collection"),
            F.when(named, F.get("parts", F.lit(2))).otherwise(F.col("target_rkey")).alias("rkey"),
            "created_at",
        ).alias("r"),
    )
    refs = refs.groupBy("link_id").agg(F.min("r").alias("r")).select("link_id", "r.*")
    archive = records.select("did", "collection", "rkey", F.col("deleted_at").isNotNull().alias("deleted"), F.col("indexed_at").alias("since"))
    archive = archive.groupBy("did", "collection", "rkey").agg(F.max("deleted").alias("deleted"), F.min("since").alias("since"))
    out = orphan_references(refs, ["did", "collection", "rkey"], archive, "partial", {("did",): accounts.select("did")}, "created_at", hot_rows)
    nothing = refs.filter("did is null and collection is null and rkey is null").withColumn("reason", F.lit("missing"))
    return out.unionByName(nothing).select("link_id", "reason", F.col("collection").alias("target_collection"), "created_at")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan links counted per target collection, month and reason (``links``)."""
    month = F.date_format("created_at", "yyyy-MM")
    return orphans.groupBy("target_collection", month.alias("month"), "reason").agg(F.count("*").alias("links"))
