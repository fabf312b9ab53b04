"""Queries of the core's data-pipeline operators (problems 1, 4 and 5) over an archive's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.operators.changefeed import apply_changes, mark_applied
from vellumine.operators.flatten import json_nodes
from vellumine.operators.orphans import orphan_links, orphan_report
from vellumine.sources.tables import table


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    found = json_nodes(table(spark, base, "records"), "id", "record").filter("parent_path is not null")
    return found.select("record_id", "node_path", "parent_path").distinct()


def p1_node_tables(spark: SparkSession, base: str) -> DataFrame:
    """The flat tables that the bodies make: their rows, records and scalar values."""
    nodes = json_nodes(table(spark, base, "records").dropDuplicates(["id"]), "id", "record", fields=True)
    return nodes.groupBy("table_path").agg(F.count("*").alias("rows"), F.count_distinct("record_id").alias("records"), F.sum(F.size("fields")).alias("scalars"))


def _orphans(spark: SparkSession, base: str) -> DataFrame:
    return orphan_links(table(spark, base, "record_links"), table(spark, base, "records"), table(spark, base, "did_pds"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return _orphans(spark, base).select("link_id", "reason")


def p4_report(spark: SparkSession, base: str) -> DataFrame:
    return orphan_report(_orphans(spark, base))


def _changes(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "change_events").filter("event_type = 'record'")


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return apply_changes(_changes(spark, base), ["did", "collection", "rkey"], ["cid"])


def p5_applied(spark: SparkSession, base: str) -> DataFrame:
    """Every change of the feed with whether it holds."""
    feed = _changes(spark, base).select("id", "did", "collection", "rkey", "action", "rev")
    return mark_applied(feed, ["did", "collection", "rkey"]).select("id", "action", F.col("applied"))


QUERIES = {f.__name__: f for f in (p1_found, p1_node_tables, p4_found, p4_report, p5_found, p5_applied)}

_ORPHANS = r"""
WITH l AS (SELECT DISTINCT id, created_at, regexp_replace(regexp_replace(regexp_replace(trim(target_uri, e' \t\r\n'), '[?#].*$', ''), '/$', ''), '^(?i:at)://', 'at://') AS u FROM record_links),
r AS (SELECT id, created_at, CASE WHEN u LIKE 'at://%' THEN url_decode(substr(u, 6)) ELSE url_decode(u) END AS u FROM l),
p AS (SELECT id, created_at, split_part(u, '/', 1) AS did, nullif(split_part(u, '/', 2), '') AS collection, nullif(split_part(u, '/', 3), '') AS rkey FROM r),
a AS (SELECT did, collection, rkey, min(indexed_at) AS since, max(CASE WHEN deleted_at IS NULL THEN 0 ELSE 1 END) AS gone FROM records GROUP BY ALL),
o AS (SELECT p.id AS link_id, p.collection AS target_collection, p.created_at,
  CASE WHEN p.collection IS NULL THEN CASE WHEN p.did NOT IN (SELECT did FROM did_pds) THEN 'missing' END
       WHEN a.did IS NULL THEN 'missing' WHEN a.gone = 1 THEN 'deleted' WHEN a.since > p.created_at THEN 'late' END AS reason
  FROM p LEFT JOIN a ON p.did = a.did AND p.collection = a.collection AND p.rkey = a.rkey)
"""

_FOLD = """
WITH RECURSIVE e AS (SELECT DISTINCT id, did, collection, rkey, action, cid, nullif(rev, '') AS rev FROM change_events WHERE event_type = 'record'),
n AS (SELECT *, row_number() OVER (PARTITION BY did, collection, rkey ORDER BY id) AS k FROM e),
s AS (SELECT did, collection, rkey, k, id, action, action AS live, cid, rev, true AS applied FROM n WHERE k = 1
  UNION ALL
  SELECT n.did, n.collection, n.rkey, n.k, n.id, n.action,
    CASE WHEN n.rev IS NULL OR s.rev IS NULL OR n.rev > s.rev THEN n.action ELSE s.live END,
    CASE WHEN n.rev IS NULL OR s.rev IS NULL OR n.rev > s.rev THEN n.cid ELSE s.cid END,
    CASE WHEN n.rev IS NULL OR s.rev IS NULL OR n.rev > s.rev THEN n.rev ELSE s.rev END,
    n.rev IS NULL OR s.rev IS NULL OR n.rev > s.rev
  FROM s JOIN n ON n.did = s.did AND n.collection = s.collection AND n.rkey = s.rkey AND n.k = s.k + 1)
"""

ORACLE = {
    "p4_found": _ORPHANS + "SELECT link_id, reason FROM o WHERE reason IS NOT NULL",
    "p4_report": _ORPHANS + "SELECT target_collection, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m') AS \"month\", reason, count(*) AS links FROM o WHERE reason IS NOT NULL GROUP BY ALL",
    "p5_found": _FOLD + "SELECT did, collection, rkey, cid FROM (SELECT *, row_number() OVER (PARTITION BY did, collection, rkey ORDER BY k DESC) AS b FROM s) WHERE b = 1 AND live <> 'delete'",
    "p5_applied": _FOLD + "SELECT id, action, applied FROM s",
}
