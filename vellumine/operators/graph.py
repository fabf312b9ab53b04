"""The link graph: out-edges, backlinks, following feeds, audiences and the ranked feed."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.errors import AlreadyExists, InvalidRequest, NotFound, RecordNotFound
from vellumine.functions.text import BARE_DID
from vellumine.operators.paging import BACKLINKS, clamp
from vellumine.operators.ranking import Profile, ranked_page
from vellumine.operators.records import filtered
from vellumine.operators.where import matchers


def _live(records: DataFrame) -> DataFrame:
    return records.filter("deleted_at is null")


def _edges(links: DataFrame, records: DataFrame) -> DataFrame:
    """Links with the account and collection of the live record they are in."""
    own = _live(records).select(F.col("id").alias("record_id"), "did", "collection", F.col("uri").alias("source_uri"))
    return links.select("id", "record_id", "path", "target_uri", "target_did", "target_collection", "target_rkey").join(own, "record_id")


def out_links(links: DataFrame, records: DataFrame, uri: str) -> DataFrame:
    """``path, target_uri, ...`` of the record at ``uri``, which may be deleted but must be known."""
    mine = records.filter(F.col("uri") == uri).select(F.col("id").alias("record_id")).distinct()
    if mine.isEmpty():
        raise RecordNotFound(f"no record {uri}")
    return links.join(mine, "record_id", "left_semi").select("path", "target_uri", "target_did", "target_collection", "target_rkey")


def backlinks(links: DataFrame, records: DataFrame, target: str, collection: str | None = None, path: str | None = None, limit: int = BACKLINKS) -> DataFrame:
    """Live records that link to a record or an account, oldest link first."""
    hit = links.filter((F.col("target_uri") == target) | (F.col("target_did") == target))
    hit = hit if path is None else hit.filter(F.col("path") == path)
    found = _edges(hit, records)
    found = found if collection is None else found.filter(F.col("collection") == collection)
    return found.select("id", "source_uri", "did", "collection", "path").orderBy("id").limit(limit)


def linking_to(records: DataFrame, links: DataFrame, targets: Mapping[str, str]) -> DataFrame:
    """Records that link on each path to its target."""
    for path, target in targets.items():
        hit = links.filter((F.col("path") == path) & (F.col("target_uri") == target)).select(F.col("record_id").alias("id"))
        records = records.join(hit, "id", "left_semi")
    return records


@dataclass(frozen=True)
class Following:
    """What following means: the collection of follow records and the path of their target."""

    collection: str = "site.standard.graph.subscription"
    path: str = "publication"


def followed_targets(links: DataFrame, records: DataFrame, did: str, how: Following) -> DataFrame:
    mine = _live(records).filter((F.col("did") == did) & (F.col("collection") == how.collection)).select(F.col("id").alias("record_id"))
    return links.filter(F.col("path") == how.path).join(mine, "record_id", "left_semi").select("target_uri").distinct()


def parse_feed(feed: str) -> str:
    """The account of ``following:<did>``."""
    kind, _, did = feed.partition(":")
    if kind != "following" or not re.match(BARE_DID, did):
        raise InvalidRequest(f"feed: {feed!r} is not following:<did>")
    return did


def following_feed(records: DataFrame, links: DataFrame, archive: DataFrame, feed: str, how: Following = Following()) -> DataFrame:
    """The ``records`` that link, on any path, to what the account follows; two semi-joins."""
    targets = followed_targets(links, archive, parse_feed(feed), how)
    member = links.join(targets, "target_uri", "left_semi").select(F.col("record_id").alias("id"))
    return records.join(member, "id", "left_semi")


# The kinds of audience and what each needs.
KINDS = {"backlink": "target", "outlink": "did", "collection": "collection", "static": "dids"}


def check_audience(definition: Any) -> None:
    if not isinstance(definition, Mapping) or definition.get("kind") not in KINDS:
        raise InvalidRequest(f"audience: kind must be one of {', '.join(KINDS)}")
    need = KINDS[definition["kind"]]
    value = definition.get(need)
    if need == "dids":
        if not isinstance(value, list) or not all(isinstance(d, str) for d in value):
            raise InvalidRequest("audience: dids must be a list of texts")
    elif not isinstance(value, str) or not value:
        raise InvalidRequest(f"audience: {definition['kind']} needs {need}")


def members(definition: Mapping[str, Any], records: DataFrame, links: DataFrame) -> DataFrame:
    """``did`` of an audience; distinct but for the static kind, which is as given."""
    check_audience(definition)
    kind = definition["kind"]
    if kind == "static":
        return records.sparkSession.createDataFrame([(d,) for d in definition["dids"]], "did string")
    if kind == "collection":
        hit = _live(records).filter(F.col("collection") == definition["collection"]).filter(matchers(definition.get("matchers")))
        return hit.select("did").distinct()
    if kind == "backlink":
        found = _edges(links.filter(F.col("target_uri") == definition["target"]), records).select("did", "collection", "path")
    else:
        found = _edges(links.filter("target_did is not null"), records).filter(F.col("did") == definition["did"]).select(F.col("target_did").alias("did"), "collection", "path")
    for column in ("collection", "path"):
        if definition.get(column):
            found = found.filter(F.col(column) == definition[column])
    return found.select("did").distinct()


def in_audience(rows: DataFrame, definition: Mapping[str, Any], records: DataFrame, links: DataFrame) -> DataFrame:
    return rows.join(members(definition, records, links), "did", "left_semi")


def is_member(did: str, definition: Mapping[str, Any], records: DataFrame, links: DataFrame) -> bool:
    return not members(definition, records, links).filter(F.col("did") == did).isEmpty()


class Audiences:
    """Named audiences, kept as definitions."""

    def __init__(self) -> None:
        self.named: dict[str, dict] = {}

    def create(self, name: str, definition: dict) -> dict:
        if name in self.named:
            raise AlreadyExists(f"audience {name!r} exists")
        check_audience(definition)
        self.named[name] = dict(definition)
        return self.named[name]

    def update(self, name: str, definition: dict) -> dict:
        self.get(name)
        check_audience(definition)
        self.named[name] = dict(definition)
        return self.named[name]

    def get(self, name: str) -> dict:
        if name not in self.named:
            raise NotFound(f"no audience {name!r}")
        return self.named[name]

    def delete(self, name: str) -> None:
        self.get(name)
        del self.named[name]

    def list(self) -> list[str]:
        return sorted(self.named)

    def page(self, name: str, records: DataFrame, links: DataFrame, limit: Any = None, offset: int = 0) -> DataFrame:
        return members(self.get(name), records, links).orderBy("did").offset(offset).limit(clamp(limit, "members"))

    def preview(self, definition: dict, records: DataFrame, links: DataFrame, limit: Any = None) -> DataFrame:
        return members(definition, records, links).orderBy("did").limit(clamp(limit, "preview"))


def ranked_feed(
    records: DataFrame,
    links: DataFrame,
    counts: DataFrame,
    now: dt.datetime,
    profile: Profile | None = None,
    collection: str | None = None,
    where: Mapping[str, Any] | None = None,
    audience: Mapping[str, Any] | None = None,
    feed: str | None = None,
    targets: Mapping[str, str] | None = None,
    limit: Any = None,
    cursor: str | None = None,
    how: Following = Following(),
) -> DataFrame:
    """``uri, id, score``: live records through all filters, by profile or newest first."""
    rows = filtered(records, collection, where)
    if audience is not None:
        rows = in_audience(rows, audience, records, links)
    if feed is not None:
        rows = following_feed(rows, links, records, feed, how)
    if targets:
        rows = linking_to(rows, links, targets)
    profile = profile or Profile("chronological", ())
    return ranked_page(rows, profile, counts, now, limit, cursor, kind="feed").select("uri", "id", "score")


def event_page(events: DataFrame, records: DataFrame, limit: Any = None, cursor: Any = None, order: str = "asc", since: Any = None, until: Any = None, collections: Sequence[str] = (), did: str | None = None, actions: Sequence[str] = (), include_record: bool = False) -> DataFrame:
    """A page of the event log with each record's current cid (and body if asked for), which are
    null on deletes.  The page is cut before the join, so the join never sees more than it."""
    from vellumine.operators.aggregate import time_range
    from vellumine.operators.paging import id_page

    if order not in ("asc", "desc"):
        raise InvalidRequest("order must be asc or desc")
    rows = events.filter(time_range(F.col("created_at"), since, until))
    if collections:
        rows = rows.filter(F.col("collection").isin(*collections))
    if did is not None:
        rows = rows.filter(F.col("did") == did)
    if actions:
        rows = rows.filter(F.col("action").isin(*actions))
    own = records.select("did", "collection", "rkey", "uri", F.col("cid").alias("_cid"), F.col("record").alias("_record"))
    rows = rows.select("id", "did", "collection", "rkey", "action", "rev", "live", "created_at").join(own.select("did", "collection", "rkey"), ["did", "collection", "rkey"], "left_semi")
    page = id_page(rows, "id", clamp(limit, "events"), cursor, order == "desc")
    kept = F.col("action") != "delete"
    shape = ["id", "uri", "did", "collection", "rkey", "action", F.when(kept, F.col("_cid")).alias("cid"), "rev", "live", "created_at"]
    shape += [F.when(kept, F.col("_record")).alias("record")] if include_record else []
    return own.join(F.broadcast(page), ["did", "collection", "rkey"]).select(*shape)
