"""The records plane: scan, point lookup, list, count, and the shapes rows come out in."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.errors import RecordNotFound
from vellumine.operators.paging import clamp, offset_page
from vellumine.operators.where import compile_sort, compile_where, system_filters


def unique_records(records: DataFrame) -> DataFrame:
    """One row per ``id``: repeated rows differ at most in ``indexed_at``, whose earliest counts.
    Unused columns are pruned from the aggregate and from the scan."""
    rest = [c for c in records.columns if c not in ("id", "indexed_at")]
    return records.groupBy("id").agg(*[F.first(c).alias(c) for c in rest], F.min("indexed_at").alias("indexed_at"))


def unique_links(links: DataFrame) -> DataFrame:
    return links.dropDuplicates(["id"])


def public_shape(*extra: Column | str) -> list[Column]:
    """The public columns of a record."""
    plain = [F.col(c) for c in ("uri", "cid", "did", "collection")]
    return [*plain, F.col("record").alias("value"), F.col("indexed_at"), *(F.col(e) if isinstance(e, str) else e for e in extra)]


def full_shape() -> list[Column]:
    return [F.col(c) for c in ("uri", "did", "collection", "rkey", "cid", "rev", "record", "indexed_at", "deleted_at")]


def get_record(records: DataFrame, collection: str, uri: str) -> DataFrame:
    """The live record at ``uri``; RecordNotFound if there is none in that collection."""
    row = records.filter((F.col("uri") == uri) & system_filters(collection)).limit(1)
    if row.isEmpty():
        raise RecordNotFound(f"no record {uri}")
    return row.select(*public_shape())


def filtered(records: DataFrame, collection: str | None = None, where: Mapping[str, Any] | None = None, include_deleted: bool = False, exclude_cold: bool = False) -> DataFrame:
    return records.filter(system_filters(collection, include_deleted, exclude_cold) & compile_where(where))


def get_records(
    records: DataFrame,
    collection: str | None = None,
    where: Mapping[str, Any] | None = None,
    sort_by: Sequence[Mapping[str, str]] | None = None,
    limit: Any = None,
    cursor: str | None = None,
    include_deleted: bool = False,
    exclude_cold: bool = False,
) -> DataFrame:
    """A page of records; the next cursor is :func:`paging.next_offset` of the page."""
    matching = filtered(records, collection, where, include_deleted, exclude_cold)
    page, _ = offset_page(matching, compile_sort(sort_by), clamp(limit, "records"), cursor)
    return page


def count_records(records: DataFrame, collection: str | None = None, where: Mapping[str, Any] | None = None, include_deleted: bool = False) -> DataFrame:
    return filtered(records, collection, where, include_deleted).agg(F.count("*").alias("count"))
