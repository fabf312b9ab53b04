"""The archive: change events folded into current records, soft deletes and tombstones included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions.text import matches_any_glob
from vellumine.operators.changefeed import mark_applied
from vellumine.operators.derive import record_language

KEY = ["did", "collection", "rkey"]
# What a queue state may be.
EMBED_STATES = ("pending", "done", "skipped", "failed")


def uri_of(did: str = "did", collection: str = "collection", rkey: str = "rkey") -> Column:
    return F.concat(F.lit("at://"), F.col(did), F.lit("/"), F.col(collection), F.lit("/"), F.col(rkey))


def applied_log(events: DataFrame) -> DataFrame:
    """The changes that hold, in feed form."""
    return mark_applied(events, KEY).filter("applied").drop("applied")


def fold(events: DataFrame, cold: Column | None = None) -> DataFrame:
    """Records after ``events`` (``id, did, collection, rkey, action, record, cid, rev,
    created_at``): one row per key.

    A delete keeps the last written body and cid and sets ``deleted_at``; a key that was only ever
    deleted is a tombstone with an empty body.  A write clears ``deleted_at``.  The queue state
    becomes pending (skipped if cold) when a write changes the cid, else stays.
    """
    log = applied_log(events.select("id", *KEY, "action", "record", "cid", "rev", "created_at"))
    write = F.col("action") != "delete"
    at = F.struct("id", "created_at", "rev", "action")
    rows = log.groupBy(*KEY).agg(
        F.max(at).alias("last"),
        F.max_by(F.struct("record", "cid", "created_at"), F.when(write, F.col("id"))).alias("written"),
    )
    gone = F.col("last.action") == "delete"
    cold = F.lit(False) if cold is None else F.coalesce(cold, F.lit(False))
    out = rows.select(
        *KEY,
        uri_of().alias("uri"),
        F.col("written.cid").alias("cid"),
        F.col("last.rev").alias("rev"),
        F.coalesce("written.record", F.lit("{}")).alias("record"),
        F.when(F.col("written").isNotNull() & ~cold, "pending").otherwise("skipped").alias("embed_status"),
        cold.alias("cold"),
        F.when(F.col("written").isNotNull(), F.col("written.created_at")).otherwise(F.col("last.created_at")).alias("indexed_at"),
        F.when(gone, F.col("last.created_at")).alias("deleted_at"),
    )
    return out.withColumn("lang", record_language(F.col("record")))


def blocked(events: DataFrame, dids: DataFrame | None = None, hosts: DataFrame | None = None, globs: list[str] | None = None) -> DataFrame:
    """``events`` without those of blocked accounts: listed in ``dids`` (``did``), or resolved in
    ``hosts`` (``did, pds``) to a host that matches one of ``globs``.  Unresolved hosts pass."""
    out = events
    if dids is not None:
        out = out.join(dids.select("did").distinct(), "did", "left_anti")
    if hosts is not None and globs:
        out = out.join(hosts.filter(matches_any_glob(F.col("pds"), globs)).select("did"), "did", "left_anti")
    return out


def cooled(records: DataFrame, dids: DataFrame | None = None, hosts: DataFrame | None = None, globs: list[str] | None = None) -> DataFrame:
    """``records`` with ``cold`` set, and the queue state ``skipped``, for listed accounts and hosts;
    records that no list covers any more are warm, and live ones queue again."""
    lists = []
    if dids is not None:
        lists.append(dids.select("did"))
    if hosts is not None and globs:
        lists.append(hosts.filter(matches_any_glob(F.col("pds"), globs)).select("did"))
    if not lists:
        return records
    listed = lists[0]
    for more in lists[1:]:
        listed = listed.unionByName(more)
    marked = records.join(listed.distinct().withColumn("_cold", F.lit(True)), "did", "left").withColumn("_cold", F.coalesce("_cold", F.lit(False)))
    warmed = F.coalesce(F.col("cold"), F.lit(False)) & ~F.col("_cold") & F.col("deleted_at").isNull()
    status = F.when(F.col("_cold"), "skipped").when(warmed, "pending").otherwise(F.col("embed_status"))
    return marked.withColumns({"embed_status": status, "cold": F.col("_cold")}).select(*records.columns)


def purged(records: DataFrame, did: str, mode: str, at: Column) -> DataFrame:
    """The records after blocking ``did``: ``block`` leaves them, ``soft`` marks them deleted,
    ``hard`` removes them."""
    mine = F.col("did") == did
    if mode == "hard":
        return records.filter(~mine)
    if mode == "soft":
        return records.withColumn("deleted_at", F.when(mine & F.col("deleted_at").isNull(), at).otherwise(F.col("deleted_at")))
    if mode == "block":
        return records
    raise ValueError(f"unknown mode {mode!r}")


def without_derived(derived: DataFrame, records: DataFrame, did: str) -> DataFrame:
    """A derived table (by ``record_id``) without the rows of one account's records."""
    mine = records.filter(F.col("did") == did).select(F.col("id").alias("record_id"))
    return derived.join(mine, "record_id", "left_anti")


def missing_events(records: DataFrame, events: DataFrame) -> DataFrame:
    """Synthetic events for records that the log doesn't know: a create, or a delete for deleted
    records, not live; numbered after the log in order of record id by ``seq``."""
    unknown = records.join(events.select(*KEY).distinct(), KEY, "left_anti")
    return unknown.select(
        F.col("id").alias("record_id"),
        *KEY,
        F.when(F.col("deleted_at").isNull(), "create").otherwise("delete").alias("action"),
        "rev",
        F.lit(False).alias("live"),
        F.coalesce("deleted_at", "indexed_at").alias("created_at"),
    )


def numbered(rows: DataFrame, order: str, start: int) -> DataFrame:
    """``rows`` with ``id`` counting from ``start`` in order of ``order``: partitions are ranged,
    counted, and numbered each from its own offset, so nothing is gathered."""
    ranged = rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    counts = ranged.groupBy("_part").count()
    offsets = counts.withColumn("_from", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return ranged.join(F.broadcast(offsets), "_part").withColumn("id", place + F.col("_from") + F.lit(start - 1)).drop("_part", "_from")
