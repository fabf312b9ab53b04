"""Ranking profiles compiled to one linear score, the interaction rollup, and source planning."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.errors import InvalidRequest
from vellumine.functions.jsonpath import extract_text
from vellumine.operators.paging import RankCursor, clamp

TRANSFORMS = ("log1p", "clamp", "identity")
#: Coverage from which local interaction counts are trusted.
COVERAGE = 0.9


@dataclass(frozen=True)
class Link:
    collection: str
    path: str
    weight: float = 1.0

    @property
    def kind(self) -> str:
        return f"{self.collection}:{self.path}"


@dataclass(frozen=True)
class Signal:
    kind: str
    weight: float
    links: tuple[Link, ...] = ()
    transform: str = "identity"
    least: float | None = None
    most: float | None = None
    field: str = ""
    half_life_hours: float = 0.0

    def check(self, profile: str) -> None:
        problem = None
        if self.kind not in ("relevance", "interactions", "recency"):
            problem = "unknown kind"
        elif isinstance(self.weight, bool) or not isinstance(self.weight, (int, float)) or not math.isfinite(self.weight):
            problem = "weight must be a finite number"
        elif self.kind == "interactions":
            if not self.links or any(not x.collection or not x.path or not isinstance(x.weight, (int, float)) for x in self.links):
                problem = "links must be a non-empty list of collection, path and weight"
            elif self.transform not in TRANSFORMS:
                problem = f"unknown transform {self.transform!r}"
        elif self.kind == "recency" and (not self.field or not self.half_life_hours > 0):
            problem = "recency needs a field and a half-life above 0"
        if problem:
            raise InvalidRequest(f"ranking {profile!r}, signal {self.kind!r}: {problem}")


@dataclass(frozen=True)
class Profile:
    name: str
    signals: tuple[Signal, ...]

    def check(self) -> Profile:
        if not self.signals:
            raise InvalidRequest(f"ranking {self.name!r} has no signals")
        for s in self.signals:
            s.check(self.name)
        return self

    def links(self) -> list[Link]:
        return [x for s in self.signals for x in s.links]


def recency(field: str, half_life_hours: float, now: dt.datetime) -> Column:
    """Halves every half-life; a time in the body that can't be read gives null."""
    at = F.col("indexed_at") if field == "indexedAt" else F.try_to_timestamp(extract_text(F.col("record"), field.removeprefix("record.")))
    hours = (F.unix_micros(F.lit(now)) - F.unix_micros(at.cast("timestamp"))) / F.lit(3.6e9)
    return F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -math.log(2) * hours / float(half_life_hours))))


def transformed(signal: Signal, x: Column) -> Column:
    if signal.transform == "log1p":
        return F.log1p(x)
    if signal.transform == "clamp":
        x = x if signal.least is None else F.greatest(F.lit(float(signal.least)), x)
        return x if signal.most is None else F.least(F.lit(float(signal.most)), x)
    return x


def score(profile: Profile, now: dt.datetime, relevance: Column | None = None, interactions: Callable[[Signal], Column] | None = None) -> Column | None:
    """The weighted sum of a profile's signals in their order, or None if no signal is active
    (relevance without a query isn't)."""
    out = None
    for s in profile.signals:
        if s.kind == "relevance":
            if relevance is None:
                continue
            x = relevance
        elif s.kind == "recency":
            x = recency(s.field, s.half_life_hours, now)
        else:
            x = transformed(s, interactions(s) if interactions else F.lit(0.0))
        term = F.lit(float(s.weight)) * x
        out = term if out is None else out + term
    return None if out is None else out.cast("double")


def rollup(links: DataFrame, records: DataFrame, specs: Sequence[Link]) -> DataFrame:
    """``target_uri, kind, count`` from the links of live records on the tracked paths."""
    live = records.filter("deleted_at is null").select(F.col("id").alias("record_id"), "collection")
    tracked = sorted({x.kind for x in specs})
    kind = F.concat_ws(":", "collection", "path")
    return links.join(live, "record_id").select("target_uri", kind.alias("kind")).filter(F.col("kind").isin(*tracked)).groupBy("target_uri", "kind").agg(F.count("*").alias("count"))


def rollup_deltas(counts: DataFrame, deltas: DataFrame) -> DataFrame:
    """``counts`` after signed ``deltas`` (``target_uri, kind, count``); none falls below 0."""
    both = counts.unionByName(deltas).groupBy("target_uri", "kind").agg(F.sum("count").alias("count"))
    return both.withColumn("count", F.greatest("count", F.lit(0))).filter("count > 0")


def set_network_counts(counts: DataFrame, network: DataFrame) -> DataFrame:
    """``counts`` with the pairs of ``network`` (``target_uri, collection, path, count``) replaced."""
    given = network.select("target_uri", F.concat_ws(":", "collection", F.regexp_replace("path", r"^\.", "")).alias("kind"), "count")
    return counts.join(given, ["target_uri", "kind"], "left_anti").unionByName(given)


def with_interactions(records: DataFrame, counts: DataFrame, profile: Profile) -> tuple[DataFrame, Callable[[Signal], Column]]:
    """``records`` joined with one weighted count per interactions signal of the profile."""
    signals = [s for s in profile.signals if s.kind == "interactions"]
    if not signals:
        return records, lambda _: F.lit(0.0)
    weight = lambda s: F.sum(sum((F.when(F.col("kind") == x.kind, F.col("count") * float(x.weight)).otherwise(F.lit(0.0)) for x in s.links), F.lit(0.0)))
    totals = counts.filter(F.col("kind").isin(*{x.kind for x in profile.links()})).groupBy(F.col("target_uri").alias("uri")).agg(*[weight(s).alias(f"_i{i}") for i, s in enumerate(signals)])
    joined = records.join(totals, "uri", "left")
    return joined, lambda s: F.coalesce(F.col(f"_i{signals.index(s)}"), F.lit(0.0))


def ranked_page(records: DataFrame, profile: Profile, counts: DataFrame, now: dt.datetime, limit: Any = None, cursor: str | None = None, relevance: Column | None = None, kind: str = "records") -> DataFrame:
    """``records``' columns and ``score``, best first; later pages use the first page's clock."""
    after = RankCursor.decode(cursor) if cursor else None
    if after:
        now = dt.datetime.fromtimestamp(after.anchor_ms / 1000, dt.timezone.utc)
    joined, interactions = with_interactions(records, counts, profile)
    value = score(profile, now, relevance, interactions)
    if value is None:
        page = joined.withColumn("score", F.lit(0.0))
        page = page.filter(F.col("id") < after.id) if after else page
        order = [F.col("id").desc()]
    else:
        page = joined.withColumn("score", value)
        page = page.filter(after.after(F.col("score"), F.col("id"))) if after else page
        order = [F.col("score").desc_nulls_last(), F.col("id").desc()]
    return page.orderBy(*order).limit(clamp(limit, kind)).select(*records.columns, "score")


def next_cursor(page: Sequence[Any], now: dt.datetime) -> str | None:
    """After any non-empty page."""
    return RankCursor(float(page[-1]["score"]), int(page[-1]["id"]), int(now.timestamp() * 1000)).encode() if page else None


@dataclass(frozen=True)
class Coverage:
    """How much of a collection the archive has seen."""

    repos_caught_up: int = 0
    repos_total: int | None = None
    complete: bool = False

    def met(self, threshold: float) -> bool:
        if self.repos_total:
            return self.repos_caught_up / self.repos_total >= threshold
        return self.complete


def plan_sources(links: Sequence[Link], consumed: Sequence[str], coverage: Mapping[str, Coverage], overrides: Mapping[str, str] | None = None, threshold: float = COVERAGE) -> list[tuple[Link, str]]:
    """For each link whether to count it locally or in the network: an override decides, else a
    collection not consumed is the network's, else its coverage decides."""
    out = []
    for x in links:
        forced = (overrides or {}).get(x.collection)
        if forced in ("local", "network"):
            out.append((x, forced))
        elif x.collection in consumed and coverage.get(x.collection, Coverage()).met(threshold):
            out.append((x, "local"))
        else:
            out.append((x, "network"))
    return out
