"""Push delivery: pending batches of a subscription, signatures, and the retry state machine."""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.errors import AlreadyExists, EngineError, InvalidRequest, NotFound
from vellumine.operators.graph import Audiences, Following, following_feed, in_audience
from vellumine.operators.where import matchers

# Backoff and the statuses by which a consumer asks for a slower pace.
FIRST_WAIT_S, LONGEST_WAIT_S, FAILING_AFTER = 1, 300, 100
SLOW_DOWN = (429, 503)


@dataclass(frozen=True)
class Subscription:
    name: str
    url: str
    secret: str
    cursor: int = 0
    collections: tuple[str, ...] = ()
    actions: tuple[str, ...] = ()
    record_matchers: Mapping[str, Any] = field(default_factory=dict)
    audience: str | None = None
    feed: str | None = None
    include_record: bool = False
    max_events: int = 200
    max_wait_ms: int = 5000
    status: str = "active"
    failures: int = 0
    last_delivery: dt.datetime | None = None
    next_attempt: dt.datetime | None = None
    last_error: str | None = None


def signature(secret: str, body: str) -> str:
    return "sha256=" + hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()


def pending_batch(sub: Subscription, events: DataFrame, records: DataFrame, links: DataFrame, audiences: Audiences, how: Following = Following()) -> DataFrame | None:
    """The next events of a subscription in order, or None if its audience or feed can't be
    resolved: then nothing is delivered rather than everything."""
    key = ["did", "collection", "rkey"]
    rows = events.filter(F.col("id") > sub.cursor)
    if sub.collections:
        rows = rows.filter(F.col("collection").isin(*sub.collections))
    if sub.actions:
        rows = rows.filter(F.col("action").isin(*sub.actions))
    own = records.filter(matchers(sub.record_matchers))
    try:
        if sub.audience:
            rows = in_audience(rows, audiences.get(sub.audience), records, links)
        if sub.feed:
            own = following_feed(own, links, records, sub.feed, how)
    except EngineError:
        return None
    body = own.select(*key, "uri", F.col("cid").alias("_cid"), F.col("record").alias("_record"))
    rows = rows.select("id", *key, "action", "rev", "live", "created_at").join(body, key)
    kept = F.col("action") != "delete"
    shape = [F.col("id").cast("string").alias("cursor"), "uri", *key, "action", F.when(kept, F.col("_cid")).alias("cid"), "rev", "live", "created_at"]
    shape += [F.when(kept, F.col("_record")).alias("record")] if sub.include_record else []
    return rows.orderBy("id").limit(sub.max_events).select(*shape)


def wait_after(failures: int) -> dt.timedelta:
    """Doubles from two seconds to five minutes."""
    return dt.timedelta(seconds=min(FIRST_WAIT_S * 2 ** min(max(failures, 1), 30), LONGEST_WAIT_S))


def after_delivery(sub: Subscription, cursor: int, now: dt.datetime) -> Subscription:
    return replace(sub, cursor=cursor, failures=0, last_delivery=now, next_attempt=now, last_error=None)


def after_failure(sub: Subscription, status: int | None, detail: str, now: dt.datetime) -> Subscription:
    """A consumer that asks for a slower pace is waited for but not counted as failing."""
    failures = sub.failures if status in SLOW_DOWN else sub.failures + 1
    state = "failing" if failures >= FAILING_AFTER else sub.status
    return replace(sub, failures=failures, status=state, next_attempt=now + wait_after(failures), last_error=detail)


def deliver(sub: Subscription, batch: list[Mapping[str, Any]], post: Callable[[str, Mapping[str, str], str], int], now: dt.datetime) -> Subscription:
    """Post a batch if it is due: a full one at once, a partial one at most every ``max_wait_ms``."""
    if sub.status != "active" or (sub.next_attempt and now < sub.next_attempt) or not batch:
        return sub
    waited = sub.last_delivery is None or now - sub.last_delivery >= dt.timedelta(milliseconds=sub.max_wait_ms)
    if len(batch) < sub.max_events and not waited:
        return sub
    cursor = batch[-1]["cursor"]
    body = json.dumps({"subscription": sub.name, "cursor": cursor, "events": batch}, default=str, separators=(",", ":"))
    headers = {"Content-Type": "application/json", "X-Archive-Subscription": sub.name, "X-Archive-Cursor": cursor, "X-Archive-Signature": signature(sub.secret, body)}
    try:
        status = post(sub.url, headers, body)
    except OSError as e:
        return after_failure(sub, None, str(e), now)
    if 200 <= status < 300:
        return after_delivery(sub, int(cursor), now)
    return after_failure(sub, status, f"HTTP {status} ({len(batch)} events, {len(body)} bytes)", now)


class Subscriptions:
    """Named subscriptions and their state."""

    def __init__(self) -> None:
        self.named: dict[str, Subscription] = {}

    def create(self, **given: Any) -> Subscription:
        name = given.get("name")
        if not name or not str(given.get("url", "")).startswith(("http://", "https://")) or not given.get("secret"):
            raise InvalidRequest("a subscription needs name, url and secret")
        if name in self.named:
            raise AlreadyExists(f"subscription {name!r} exists")
        self.named[name] = Subscription(**given)
        return self.named[name]

    def get(self, name: str) -> Subscription:
        if name not in self.named:
            raise NotFound(f"no subscription {name!r}")
        return self.named[name]

    def update(self, name: str, **given: Any) -> Subscription:
        """Reactivation clears failures and the wait."""
        if given.get("status") not in (None, "active", "paused"):
            raise InvalidRequest("status must be active or paused")
        if given.get("status") == "active":
            given |= {"failures": 0, "next_attempt": None, "last_error": None}
        self.named[name] = replace(self.get(name), **given)
        return self.named[name]

    def delete(self, name: str) -> None:
        self.get(name)
        del self.named[name]

    def list(self) -> list[Subscription]:
        return [self.named[n] for n in sorted(self.named)]


def frames(page: list[Mapping[str, Any]]) -> list[str]:
    """Server-sent frames of a page of events; a ping when there are none."""
    if not page:
        return ["event: ping\ndata: {}\n\n"]
    return [f"event: event\nid: {row['id']}\ndata: {json.dumps(dict(row), default=str, separators=(',', ':'))}\n\n" for row in page]
