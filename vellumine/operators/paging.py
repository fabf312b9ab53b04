"""Limits and cursors."""

from __future__ import annotations

import base64
import binascii
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.errors import InvalidRequest

# Fixed values: (default, most) rows of a page.
LIMITS = {"records": (50, 100), "aggregate": (100, 500), "events": (200, 500), "feed": (50, 100), "preview": (25, 100), "footprint": (50, 100), "members": (100, 1000)}
FACET_VALUES, OBSERVED_MEMBERS, BACKLINKS, FUSED_LEG = 20, 10, 200, 100


def clamp(value: Any, kind: str) -> int:
    """A page size: the default if missing, not a whole number or below 1; at most the maximum."""
    default, most = LIMITS[kind]
    text = str(value).strip() if value is not None and not isinstance(value, bool) else ""
    if not re.fullmatch(r"\d+(?:\.0+)?", text) or float(text) < 1:
        return default
    return min(int(float(text)), most)


def offset_page(df: DataFrame, order: list[Column], limit: int, cursor: str | None) -> tuple[DataFrame, int]:
    """A page by offset and the offset it starts at."""
    start = 0
    if cursor not in (None, ""):
        if not re.fullmatch(r"\d+", str(cursor)):
            raise InvalidRequest("cursor must be a whole number")
        start = int(cursor)
    return df.orderBy(*order).offset(start).limit(limit), start


def next_offset(start: int, rows: int, limit: int) -> str | None:
    """The next cursor, only after a full page."""
    return str(start + rows) if rows == limit else None


def id_page(df: DataFrame, column: str, limit: int, cursor: Any = None, descending: bool = False) -> DataFrame:
    """A page by id, exclusive of the cursor."""
    if cursor is not None:
        if not re.fullmatch(r"\d+", str(cursor)):
            raise InvalidRequest("cursor must be a whole number of at least 0")
        c = F.col(column)
        df = df.filter(c < int(cursor) if descending else c > int(cursor))
    return df.orderBy(F.col(column).desc() if descending else F.col(column).asc()).limit(limit)


@dataclass(frozen=True)
class RankCursor:
    """Where a ranked page ended; the anchor keeps scores of later pages on the same clock."""

    score: float
    id: int
    anchor_ms: int

    def encode(self) -> str:
        return base64.urlsafe_b64encode(f"{self.score!r}|{self.id}|{self.anchor_ms}".encode()).decode().rstrip("=")

    @staticmethod
    def decode(text: str) -> RankCursor:
        try:
            score, row, anchor = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)).decode().split("|")
            return RankCursor(float(score), int(row), int(anchor))
        except (ValueError, binascii.Error, UnicodeDecodeError):
            raise InvalidRequest("malformed cursor") from None

    def after(self, score: Column, row: Column) -> Column:
        s = score.cast("double")
        return (s < self.score) | ((s == self.score) & (row < self.id))


def encode_id(value: int) -> str:
    return base64.b64encode(str(value).encode()).decode()


def decode_id(text: str | None) -> int | None:
    """The id of a plain cursor; anything else is no cursor."""
    try:
        return int(base64.b64decode(text or "", validate=True).decode())
    except (ValueError, binascii.Error, UnicodeDecodeError):
        return None
