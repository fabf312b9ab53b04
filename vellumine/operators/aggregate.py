"""Grouped aggregation over records, events and links, facets, inventories and progress."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.errors import InvalidRequest
from vellumine.functions.jsonpath import extract_text
from vellumine.operators.paging import FACET_VALUES, OBSERVED_MEMBERS, clamp
from vellumine.operators.where import column_for, compile_where

BUCKETS = ("hour", "day", "week", "month", "year")


@dataclass(frozen=True)
class Source:
    """Dimensions by request name, the time dimension, and whether deleted records hide rows."""

    dims: Mapping[str, str]
    time: str
    hides_deleted: bool


# The sources and their dimensions.  Joined rows carry the record's own columns.
SOURCES = {
    "records": Source({"collection": "collection", "did": "did", "rkey": "rkey", "cid": "cid", "rev": "rev", "embedStatus": "embed_status", "indexedAt": "indexed_at"}, "indexedAt", True),
    "events": Source({"collection": "event_collection", "did": "event_did", "rkey": "event_rkey", "action": "action", "rev": "event_rev", "live": "live", "createdAt": "created_at"}, "createdAt", False),
    "links": Source({"path": "path", "targetUri": "target_uri", "targetDid": "target_did", "targetCollection": "target_collection", "targetRkey": "target_rkey", "collection": "collection", "did": "did", "createdAt": "created_at"}, "createdAt", True),
}


def joined_source(name: str, records: DataFrame, events: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """A source's rows, with the record they belong to."""
    if name == "records":
        return records
    if name == "links":
        return links.select("record_id", "path", "target_uri", "target_did", "target_collection", "target_rkey", "created_at").join(records.withColumnRenamed("id", "record_id"), "record_id")
    if name == "events":
        e = events.select(F.col("id").alias("event_id"), F.col("did").alias("event_did"), F.col("collection").alias("event_collection"), F.col("rkey").alias("event_rkey"), "action", F.col("rev").alias("event_rev"), "live", "created_at")
        own = (F.col("event_did") == F.col("did")) & (F.col("event_collection") == F.col("collection")) & (F.col("event_rkey") == F.col("rkey"))
        return e.join(records, own)
    raise InvalidRequest(f"unknown source {name!r}")


def dimension(token: str, source: Source) -> Column:
    """A groupBy token: a field, ``record.<path>``, or ``<time>:<bucket>``."""
    if token.startswith("record."):
        return extract_text(F.col("record"), token.removeprefix("record."))
    field, _, bucket = token.partition(":")
    if field not in source.dims:
        raise InvalidRequest(f"groupBy: unknown field {field!r}")
    column = F.col(source.dims[field])
    if not bucket:
        if ":" in token:
            raise InvalidRequest(f"groupBy: empty bucket in {token!r}")
        return column
    if field != source.time or bucket not in BUCKETS:
        raise InvalidRequest(f"groupBy: {token!r} is no time bucket")
    return F.date_trunc(bucket, column)


def measure(text: str | None, source: Source) -> Column:
    if text in (None, "count"):
        return F.count("*")
    kind, _, field = text.partition(":")
    if kind != "count_distinct" or not field:
        raise InvalidRequest(f"aggregate: unknown measure {text!r}")
    if ":" in field:
        raise InvalidRequest("aggregate: no time bucket in count_distinct")
    return F.count_distinct(dimension(field, source))


def instant(text: str | dt.datetime) -> dt.datetime:
    try:
        value = text if isinstance(text, dt.datetime) else dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        raise InvalidRequest(f"not a time: {text!r}") from None
    return value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)


def time_range(column: Column, since: Any = None, until: Any = None) -> Column:
    out = F.lit(True)
    if since is not None:
        out = out & (column >= F.lit(instant(since)))
    if until is not None:
        out = out & (column <= F.lit(instant(until)))
    return out


def aggregate(
    rows: DataFrame,
    source: str,
    group_by: Sequence[str] = (),
    measure_text: str | None = None,
    where: Mapping[str, Any] | None = None,
    since: Any = None,
    until: Any = None,
    order_by: str | None = None,
    limit: Any = None,
    include_deleted: bool = False,
) -> DataFrame:
    """``k0, k1, ..., count`` for the groups of ``rows`` (see :func:`joined_source`).

    Groups come by count, largest first, or by one groupBy token; ties by the keys.  Without
    groupBy there is one total row.
    """
    spec = SOURCES.get(source)
    if spec is None:
        raise InvalidRequest(f"unknown source {source!r}")
    keys = [dimension(t, spec).alias(f"k{i}") for i, t in enumerate(group_by)]
    value = measure(measure_text, spec).alias("count")
    if order_by not in (None, "count", *group_by):
        raise InvalidRequest(f"orderBy: {order_by!r} is neither count nor in groupBy")
    kept = rows.filter(compile_where(where) & time_range(F.col(spec.dims[spec.time]), since, until))
    if spec.hides_deleted and not include_deleted:
        kept = kept.filter("deleted_at is null")
    if not keys:
        return kept.agg(value)
    names = [f"k{i}" for i in range(len(keys))]
    ties = [F.col(n).asc_nulls_last() for n in names]
    order = [F.col("count").desc(), *ties] if order_by in (None, "count") else [F.col(f"k{list(group_by).index(order_by)}").asc_nulls_last(), *ties]
    return kept.groupBy(*keys).agg(value).orderBy(*order).limit(clamp(limit, "aggregate"))


def facets(matched: DataFrame, fields: Sequence[str]) -> dict[str, DataFrame]:
    """For each field its commonest values among the matched records: ``value, count``."""
    out = {}
    for field in fields:
        if field == "json":
            raise InvalidRequest("facets: json has no values")
        counted = matched.groupBy(column_for(field).cast("string").alias("value")).agg(F.count("*").alias("count"))
        out[field] = counted.orderBy(F.col("count").desc(), F.col("value").asc_nulls_last()).limit(FACET_VALUES)
    return out


def footprint(records: DataFrame, did: str | None = None) -> DataFrame:
    """Records and deleted ones of an account by collection; of every account if none is named."""
    rows = records if did is None else records.filter(F.col("did") == did)
    keys = ["collection"] if did is not None else ["did", "collection"]
    return rows.groupBy(*keys).agg(F.count("*").alias("count"), F.count("deleted_at").alias("deleted"))


def type_inventory(types: DataFrame, records: DataFrame) -> DataFrame:
    """``path, nsid, count`` over live records."""
    live = records.filter("deleted_at is null").select(F.col("id").alias("record_id"))
    return types.join(live, "record_id", "left_semi").groupBy("path", "nsid").agg(F.count("*").alias("count"))


def type_usage(types: DataFrame, records: DataFrame, nsid: str) -> DataFrame:
    """``path, collection, count`` of one type over live records."""
    live = records.filter("deleted_at is null").select(F.col("id").alias("record_id"), "collection")
    return types.filter(F.col("nsid") == nsid).join(live, "record_id").groupBy("path", "collection").agg(F.count("*").alias("count"))


def observed_members(types: DataFrame, nsid: str) -> DataFrame:
    """The types most often found below occurrences of ``nsid``: ``nsid, count``; deleted records
    count too, and a member under several occurrences counts for each."""
    stem = F.regexp_replace(F.col("p.path"), r"\.?\$type$", "")
    parent = types.filter(F.col("nsid") == nsid).alias("p")
    child = types.alias("c")
    below = (F.col("p.record_id") == F.col("c.record_id")) & (F.col("p.path") != F.col("c.path")) & F.col("c.path").startswith(stem)
    counted = parent.join(child, below).groupBy(F.col("c.nsid").alias("nsid")).agg(F.count("*").alias("count"))
    return counted.orderBy(F.col("count").desc(), "nsid").limit(OBSERVED_MEMBERS)


def progress(events: DataFrame, records: DataFrame, now: dt.datetime, window_seconds: Any = 60, collection: str | None = None) -> DataFrame:
    """Backfill progress per collection: repositories and events seen, recent rate, records."""
    try:
        window = min(max(int(window_seconds), 1), 3600)
    except (TypeError, ValueError):
        window = 60
    if collection is not None:
        events, records = events.filter(F.col("collection") == collection), records.filter(F.col("collection") == collection)
    live = F.col("live")
    recent = F.col("created_at") > F.lit(now - dt.timedelta(seconds=window))
    seen = events.groupBy("collection").agg(
        F.count_distinct("did").alias("repos_seen"),
        F.count_distinct(F.when(live, F.col("did"))).alias("repos_live"),
        F.count_if(recent & ~live).alias("recent_backfill"),
        F.count_if(recent & live).alias("recent_live"),
        F.max(F.when(~live, F.col("created_at"))).alias("last_backfill"),
        F.max("created_at").alias("last_event"),
    )
    held = records.groupBy("collection").agg(F.count_if(F.col("deleted_at").isNull()).alias("records_live"), F.count("*").alias("records"))
    both = seen.join(held, "collection", "full_outer")
    counts = ["repos_seen", "repos_live", "recent_backfill", "recent_live", "records_live", "records"]
    both = both.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    rate = F.round(F.col("recent_backfill") / window, 2)
    return both.withColumns({"rate": rate, "backfilling": rate > 0, "complete": (F.col("repos_seen") > 0) & (rate == 0)})


def queue_gauges(records: DataFrame) -> DataFrame:
    """Records that wait for embedding, and that failed."""
    return records.agg(F.count_if(F.col("embed_status") == "pending").alias("pending"), F.count_if(F.col("embed_status") == "failed").alias("failed"))
