"""JSON bodies: text extraction by dotted path and typed containment, as Column expressions.

Containment follows the rules of ``@>`` on binary JSON: scalars compare with their type, an object
contains another if it contains it key by key, a list contains another if each element of the
latter is contained in some element of the former, and a list also contains a bare scalar only
where the needle itself is that scalar at top level (not used here, as needles sit under a path).
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumine.errors import InvalidRequest


def segments(path: str) -> list[str]:
    parts = path.split(".")
    if not path or any(p == "" for p in parts):
        raise InvalidRequest(f"bad path {path!r}")
    return parts


def _quoted(key: str) -> str:
    return key.replace("\\", "\\\\").replace("'", "\\'")


def extract_text(body: Column, path: str) -> Column:
    """The value at a dotted path as text; a number as a segment indexes a list or names a key
    (``a.0``).  Null for an absent path, a JSON null and an unreadable body."""
    value = F.try_parse_json(body)
    for s in segments(path):
        key = F.try_variant_get(value, f"$['{_quoted(s)}']", "variant")
        value = F.coalesce(F.try_variant_get(value, f"$[{s}]", "variant"), key) if s.isdigit() else key
    return F.try_variant_get(value, "$", "string")


def contains(body: Column, path: str, needle: Any) -> Column:
    """Whether the JSON text ``body`` contains ``needle`` under the keys of ``path``; unreadable or
    null bodies contain nothing.  The body is parsed once per use: parse and keep the variant where
    several predicates read it (:func:`variant_contains`)."""
    return variant_contains(F.try_parse_json(body), path, needle)


def variant_contains(body: Column, path: str, needle: Any) -> Column:
    for key in reversed(segments(path)):
        needle = {key: needle}
    return F.coalesce(_within(body, needle), F.lit(False))


def _kind(v: Column, kind: str) -> Column:
    return F.schema_of_variant(v).startswith(kind)


def _within(v: Column, needle: Any) -> Column:
    if needle is None:
        return F.is_variant_null(v)
    if isinstance(needle, bool):
        return _kind(v, "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(needle))
    if isinstance(needle, (int, float)):
        number = _kind(v, "BIGINT") | _kind(v, "DECIMAL") | _kind(v, "DOUBLE") | _kind(v, "FLOAT")
        return number & (F.try_variant_get(v, "$", "double") == F.lit(float(needle)))
    if isinstance(needle, str):
        return _kind(v, "STRING") & (F.try_variant_get(v, "$", "string") == F.lit(needle))
    if isinstance(needle, dict):
        tests = [_kind(v, "OBJECT")] + [F.coalesce(_within(F.try_variant_get(v, f"$['{_quoted(k)}']", "variant"), x), F.lit(False)) for k, x in needle.items()]
        return reduce(lambda a, b: a & b, tests)
    if isinstance(needle, (list, tuple)):
        members = F.try_variant_get(v, "$", "array<variant>")
        tests = [_kind(v, "ARRAY")] + [F.coalesce(F.exists(members, _member(x)), F.lit(False)) for x in needle]
        return reduce(lambda a, b: a & b, tests)
    raise InvalidRequest(f"unsupported value {needle!r}")


def _member(needle: Any):  # noqa: ANN202
    return lambda v: F.coalesce(_within(v, needle), F.lit(False))
