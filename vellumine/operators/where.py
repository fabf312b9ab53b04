"""The filter and sort language over system fields and JSON paths, compiled to Columns.

``where`` is ``{field: {op: value, ...}, ...}``, all conditions together.  A field is a system
column, ``json`` (the whole body as text) or a path into the body; ``record.`` in front forces the
latter.  On columns values compare as text, on paths by typed containment.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumine.errors import InvalidRequest
from vellumine.functions.jsonpath import contains, extract_text
from vellumine.functions.text import contains_ignoring_case

# Request names of the system fields and their columns.
SYSTEM = {"id": "id", "uri": "uri", "did": "did", "collection": "collection", "rkey": "rkey", "cid": "cid", "rev": "rev", "indexedAt": "indexed_at", "embedStatus": "embed_status", "cold": "cold"}
OPERATORS = ("eq", "neq", "in", "nin", "contains")


def system_column(field: str) -> str | None:
    return SYSTEM.get(field)


def path_of(field: str) -> str | None:
    """The path a field names in the body, or None for system fields and ``json``."""
    if field.startswith("record."):
        return field.removeprefix("record.")
    return None if field in SYSTEM or field == "json" else field


def column_for(field: str, body: str = "record") -> Column:
    """A field as a value: a column, the body, or text at a path."""
    path = path_of(field)
    if path is not None:
        return extract_text(F.col(body), path)
    return F.col(body) if field == "json" else F.col(SYSTEM[field])


def as_text(value: Any) -> str:
    return str(value).lower() if isinstance(value, bool) else "" if value is None else str(value)


def compile_where(where: Mapping[str, Any] | None, body: str = "record") -> Column:
    """One predicate that is never null; raises InvalidRequest naming field and operator."""
    if where is None:
        return F.lit(True)
    if not isinstance(where, Mapping):
        raise InvalidRequest("where must be an object")
    tests = []
    for field, condition in where.items():
        if not isinstance(condition, Mapping) or not condition:
            raise InvalidRequest(f"where.{field} must be a non-empty object of operators")
        for op, value in condition.items():
            tests.append(_condition(field, op, value, body))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _condition(field: str, op: str, value: Any, body: str) -> Column:
    name = f"where.{field}.{op}"
    if op not in OPERATORS:
        raise InvalidRequest(f"{name}: unknown operator")
    if op in ("in", "nin"):
        if not isinstance(value, Sequence) or isinstance(value, str) or not value:
            raise InvalidRequest(f"{name} needs a non-empty list")
    elif op == "contains":
        if not isinstance(value, str):
            raise InvalidRequest(f"{name} needs a string")
        return F.coalesce(contains_ignoring_case(column_for(field, body).cast("string"), value), F.lit(False))
    elif value is None and path_of(field) is None:
        raise InvalidRequest(f"{name} needs a value")
    path = path_of(field)
    if path is not None:
        options = value if op in ("in", "nin") else [value]
        any_of = reduce(lambda a, b: a | b, [contains(F.col(body), path, v) for v in options])
        return any_of if op in ("eq", "in") else ~any_of
    column = column_for(field, body).cast("string")
    texts = [as_text(v) for v in (value if op in ("in", "nin") else [value])]
    same = F.coalesce(column.isin(*texts), F.lit(False))
    return same if op in ("eq", "in") else ~same


def matchers(pairs: Mapping[str, Any] | None, body: str = "record") -> Column:
    """``{path: value}`` as containments that must all hold."""
    return reduce(lambda a, b: a & b, [contains(F.col(body), p, v) for p, v in (pairs or {}).items()], F.lit(True))


def system_filters(collection: str | None = None, include_deleted: bool = False, exclude_cold: bool = False) -> Column:
    tests = [F.lit(True)]
    if collection is not None:
        tests.append(F.col("collection") == collection)
    if not include_deleted:
        tests.append(F.col("deleted_at").isNull())
    if exclude_cold:
        tests.append(~F.coalesce(F.col("cold"), F.lit(False)))
    return reduce(lambda a, b: a & b, tests)


def compile_sort(sort_by: Sequence[Mapping[str, str]] | None) -> list[Column]:
    """Ordering columns: nulls last ascending and first descending; ``id`` descending at the end."""
    out = []
    for item in sort_by or []:
        field, direction = item.get("field", ""), item.get("direction", "asc")
        if field == "json":
            raise InvalidRequest("sortBy: json can't be sorted by")
        if direction not in ("asc", "desc"):
            raise InvalidRequest(f"sortBy.{field}: direction must be asc or desc")
        column = column_for(field)
        out.append(column.asc_nulls_last() if direction == "asc" else column.desc_nulls_first())
    return [*out, F.col("id").desc()]
