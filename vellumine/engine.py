"""The request surface: every verb as a call with named parameters, over one set of tables.

``Engine.records_call`` takes ``<collection>.<verb>`` requests, ``Engine.call`` the service verbs.
Answers are plain values; a page's rows come to the driver only after its limit.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.errors import InvalidRequest, MethodNotImplemented, NotFound, UpstreamFailure
from vellumine.functions.text import BARE_DID, authority
from vellumine.operators import aggregate as A
from vellumine.operators import archive as AR
from vellumine.operators import derive as D
from vellumine.operators import graph as G
from vellumine.operators import paging as P
from vellumine.operators import ranking as RK
from vellumine.operators import records as RC
from vellumine.operators import search as S
from vellumine.operators.where import compile_sort
from vellumine.sources.wire import NetworkCounts, Registry
from vellumine.streaming import delivery as DL


@dataclass
class Config:
    rankings: Mapping[str, RK.Profile] = field(default_factory=dict)
    following: G.Following = field(default_factory=G.Following)


@dataclass
class NamedList:
    """A list of accounts or host globs, each with a note; adding twice is adding once."""

    what: str
    shape: str | None = None
    rows: dict[str, dict] = field(default_factory=dict)

    def add(self, value: Any, **more: Any) -> dict:
        import re

        if not isinstance(value, str) or not value.strip() or (self.shape and not re.match(self.shape, value)):
            raise InvalidRequest(f"{self.what}: bad value {value!r}")
        return self.rows.setdefault(value, {"value": value, "active": True, **more})

    def update(self, value: str, **more: Any) -> dict:
        self.get(value).update(more)
        return self.rows[value]

    def get(self, value: str) -> dict:
        if value not in self.rows:
            raise NotFound(f"{self.what}: no {value!r}")
        return self.rows[value]

    def remove(self, value: str) -> dict:
        return {"removed": self.get(value) and self.rows.pop(value)["value"]}


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _need(params: Mapping[str, Any], *names: str) -> list[Any]:
    for n in names:
        if params.get(n) in (None, ""):
            raise InvalidRequest(f"{n} parameter is required")
    return [params[n] for n in names]


class Engine:
    """Verbs over ``records``, ``links``, ``events`` and ``chunks`` (each with repeated rows counted
    once), and the named lists, audiences and subscriptions.

    ``embed`` turns a query into a vector; ``network`` is the backlink index beyond the archive;
    ``schemas`` resolves type names; ``backfill`` imports a repository in the background.
    """

    def __init__(
        self,
        records: DataFrame,
        links: DataFrame,
        events: DataFrame,
        chunks: DataFrame,
        config: Config | None = None,
        embed: Callable[[str], Sequence[float]] | None = None,
        network: NetworkCounts | None = None,
        schemas: Registry | None = None,
        backfill: Callable[[str], Any] | None = None,
        post: Callable[[str, Mapping[str, str], str], int] | None = None,
        clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.timezone.utc),
    ) -> None:
        self.records, self.links, self.events, self.chunks = records, links, events, chunks
        self.config = config or Config()
        self.embed, self.network, self.schemas, self.backfill, self.post, self.clock = embed, network, schemas, backfill, post, clock
        for profile in self.config.rankings.values():
            profile.check()
        self.audiences, self.subscriptions = G.Audiences(), DL.Subscriptions()
        self.watched = NamedList("watched account", BARE_DID)
        self.blocked_dids, self.cold_dids = NamedList("blocked account", BARE_DID), NamedList("cold account", BARE_DID)
        self.blocked_hosts, self.cold_hosts = NamedList("blocked host"), NamedList("cold host")
        self.running: set[str] = set()

    # --- the collection plane

    def records_call(self, method: str, body: Mapping[str, Any] | None = None) -> dict:
        collection, _, verb = method.rpartition(".")
        run = {"getRecords": self._get_records, "getRecord": self._get_record, "countRecords": self._count_records, "searchRecords": self._search_records}.get(verb)
        if run is None or collection.count(".") < 2:
            raise MethodNotImplemented(f"unknown method {method!r}")
        return run(collection, body if isinstance(body, Mapping) else {})

    def _get_records(self, collection: str, q: Mapping[str, Any]) -> dict:
        limit = P.clamp(q.get("limit"), "records")
        matching = RC.filtered(self.records, collection, q.get("where"), bool(q.get("includeDeleted")), bool(q.get("excludeCold")))
        page, start = P.offset_page(matching, compile_sort(q.get("sortBy")), limit, q.get("cursor"))
        rows = _rows(page.select(*RC.public_shape()))
        return {"records": rows, "cursor": P.next_offset(start, len(rows), limit)}

    def _get_record(self, collection: str, q: Mapping[str, Any]) -> dict:
        (uri,) = _need(q, "uri")
        return _rows(RC.get_record(self.records, collection, uri))[0]

    def _count_records(self, collection: str, q: Mapping[str, Any]) -> dict:
        return {"count": RC.count_records(self.records, collection, q.get("where"), bool(q.get("includeDeleted"))).first()["count"]}

    def _search_records(self, collection: str, q: Mapping[str, Any]) -> dict:
        (text,) = _need(q, "q")
        mode = q.get("mode", "fts")
        profile = self._profile(q.get("ranking"))
        filters = {"collection": collection, "where": q.get("where"), "include_deleted": bool(q.get("includeDeleted"))}
        cold = not q.get("includeCold") if mode == "fts" else bool(q.get("excludeCold"))
        out: dict[str, Any] = {}
        if q.get("facets"):
            matched = S.searchable(RC.filtered(self.records, exclude_cold=cold, **filters)).filter(S.matches(S.parse_query(text)))
            out["facets"] = {f: _rows(v) for f, v in A.facets(matched, q["facets"]).items()}
        if profile is not None and mode == "fts":
            query = S.parse_query(text)
            kept = S.searchable(RC.filtered(self.records, exclude_cold=cold, **filters)).filter(S.matches(query))
            now = self.clock()
            page = RK.ranked_page(kept, profile, self._counts(profile), now, q.get("limit"), q.get("cursor"), S.rank(query))
            value = "score"
        else:
            page = S.search(self.records, text, mode, self.chunks, self.embed, profile, limit=q.get("limit"), exclude_cold=cold, **filters)
            value = {"fts": "rank", "semantic": "distance", "hybrid": "score"}[mode]
        shape: list = [value]
        if q.get("highlight"):
            page = S.highlighted(page, text)
            shape.append("highlight")
        rows = page.select("id", *RC.public_shape(*shape)).collect()
        if value == "score" and profile is not None:
            out["cursor"] = RK.next_cursor(rows, self._anchor(q.get("cursor"), now))
        return out | {"records": [{k: v for k, v in r.asDict().items() if k != "id"} for r in rows]}

    def _profile(self, name: str | None) -> RK.Profile | None:
        if name is None:
            return None
        if name not in self.config.rankings:
            raise InvalidRequest(f"unknown ranking {name!r}")
        return self.config.rankings[name]

    def _counts(self, profile: RK.Profile | None) -> DataFrame:
        return RK.rollup(self.links, self.records, profile.links() if profile else [])

    @staticmethod
    def _anchor(cursor: str | None, now: dt.datetime) -> dt.datetime:
        return dt.datetime.fromtimestamp(P.RankCursor.decode(cursor).anchor_ms / 1000, dt.timezone.utc) if cursor else now

    # --- the service plane

    def call(self, verb: str, params: Mapping[str, Any] | None = None) -> Any:
        run = getattr(self, f"verb_{verb}", None)
        if run is None:
            raise MethodNotImplemented(f"unknown method {verb!r}")
        return run(dict(params or {}))

    def verb_getEvents(self, p: dict) -> dict:  # noqa: N802
        page = G.event_page(
            self.events, self.records, p.get("limit"), p.get("cursor"), p.get("order", "asc"), p.get("since"), p.get("until"), [p["collection"]] if p.get("collection") else (), p.get("did"), [p["action"]] if p.get("action") else (), str(p.get("include_record", "")) in ("1", "True")
        )
        rows = sorted(_rows(page), key=lambda r: r["id"], reverse=p.get("order") == "desc")
        return {"events": rows, "cursor": str(rows[-1]["id"]) if rows else None}

    def verb_subscribeEvents(self, p: dict) -> list[str]:  # noqa: N802
        """The frames of one pass of the live tail, from the cursor on."""
        return DL.frames(self.verb_getEvents(p | {"order": "asc"})["events"])

    def verb_aggregate(self, p: dict) -> dict:
        source = p.get("source")
        rows = A.joined_source(source, self.records, self.events, self.links)
        tokens = p.get("groupBy") or []
        tokens = [t.strip() for t in tokens.split(",")] if isinstance(tokens, str) else list(tokens)
        found = _rows(A.aggregate(rows, source, tokens, p.get("aggregate"), p.get("where"), p.get("since"), p.get("until"), p.get("orderBy"), p.get("limit"), bool(p.get("includeDeleted"))))
        return {"groups": [{"key": {t: r[f"k{i}"] for i, t in enumerate(tokens)}, "count": r["count"]} for r in found]}

    def _types(self) -> DataFrame:
        return D.extract_types(self.records)

    def verb_getTypes(self, p: dict) -> dict:  # noqa: N802
        records = self.records if not p.get("collection") else self.records.filter(F.col("collection") == p["collection"])
        types = self._types() if not p.get("path") else self._types().filter(F.col("path") == p["path"])
        return {"types": _rows(A.type_inventory(types, records).orderBy("path", F.col("count").desc(), "nsid"))}

    def verb_getType(self, p: dict) -> dict:  # noqa: N802
        (nsid,) = _need(p, "nsid")
        resolve = (lambda n: self.schemas.get(n, self.clock())) if self.schemas else (lambda _: None)
        schema = resolve(nsid.partition("#")[0])
        types = self._types()
        return {
            "nsid": nsid,
            "authority": authority(nsid.partition("#")[0]),
            "usage": _rows(A.type_usage(types, self.records, nsid).orderBy(F.col("count").desc(), "path", "collection")),
            "schema": schema,
            "textFields": D.text_fields(schema, resolve) if schema else [],
            "observedMembers": _rows(A.observed_members(types, nsid)),
        }

    def verb_getLinks(self, p: dict) -> dict:  # noqa: N802
        (uri,) = _need(p, "uri")
        return {"uri": uri, "links": _rows(G.out_links(self.links, self.records, uri))}

    def verb_getBacklinks(self, p: dict) -> dict:  # noqa: N802
        (uri,) = _need(p, "uri")
        return {"uri": uri, "backlinks": _rows(G.backlinks(self.links, self.records, uri, p.get("collection"), p.get("path")))}

    def verb_getNetworkBacklinks(self, p: dict) -> dict:  # noqa: N802
        (uri,) = _need(p, "uri")
        if self.network is None:
            raise UpstreamFailure("no network index")
        narrow = bool(p.get("collection") and p.get("path"))
        endpoint = "links/all/count" if not narrow else "links/count" if p.get("count") else "links"
        asked = {"target": uri} | ({"collection": p["collection"], "path": p["path"]} if narrow else {}) | ({"cursor": p["cursor"]} if p.get("cursor") else {})
        data, stale = self.network.query(endpoint, asked, self.clock())
        return {"uri": uri, "data": data, "stale": stale}

    def verb_getFootprint(self, p: dict) -> dict:  # noqa: N802
        (did,) = _need(p, "did")
        limit, after = P.clamp(p.get("limit"), "footprint"), P.decode_id(p.get("cursor"))
        collections = _rows(A.footprint(self.records, did).orderBy(F.col("count").desc(), "collection"))
        mine = self.records.filter(F.col("did") == did)
        mine = mine if p.get("includeDeleted") else mine.filter("deleted_at is null")
        mine = mine if after is None else mine.filter(F.col("id") < after)
        rows = _rows(mine.orderBy(F.col("id").desc()).limit(limit).select("id", *RC.full_shape()))
        entry = self.watched.rows.get(did)
        return {
            "did": did,
            "watched": entry is not None,
            "active": entry and entry["active"],
            "snapshotAt": entry and entry.get("snapshot_at"),
            "totals": {"records": sum(c["count"] for c in collections), "deleted": sum(c["deleted"] for c in collections)},
            "collections": collections,
            "records": [{k: v for k, v in r.items() if k != "id"} for r in rows],
            "cursor": P.encode_id(rows[-1]["id"]) if len(rows) == limit else None,
        }

    def verb_getRankedFeed(self, p: dict) -> dict:  # noqa: N802
        profile, now = self._profile(p.get("ranking")), self._anchor(p.get("cursor"), self.clock())
        audience = self.audiences.get(p["audience"]) if p.get("audience") else None
        targets = {k.removeprefix("link."): v for k, v in p.items() if k.startswith("link.")}
        page = G.ranked_feed(self.records, self.links, self._counts(profile), now, profile, p.get("collection"), p.get("where"), audience, p.get("feed"), targets, p.get("limit"), p.get("cursor"), self.config.following).collect()
        return {"feed": [{"post": r.uri} for r in page], "cursor": RK.next_cursor(page, now)}

    def verb_getBackfillStatus(self, p: dict) -> dict:  # noqa: N802
        return {"collections": _rows(A.progress(self.events, self.records, self.clock(), p.get("window", 60), p.get("collection")).orderBy("collection"))}

    # --- lists, audiences, subscriptions

    def verb_getAudiences(self, p: dict) -> dict:  # noqa: N802
        return {"audiences": [{"name": n, "definition": self.audiences.named[n]} for n in self.audiences.list()]}

    def verb_getAudience(self, p: dict) -> dict:  # noqa: N802
        (name,) = _need(p, "name")
        definition = self.audiences.get(name)
        return {"name": name, "definition": definition, "members": G.members(definition, self.records, self.links).count()}

    def verb_getAudienceMembers(self, p: dict) -> dict:  # noqa: N802
        (name,) = _need(p, "name")
        return {"members": [r.did for r in self.audiences.page(name, self.records, self.links, p.get("limit"), int(p.get("offset") or 0)).collect()]}

    def verb_checkAudienceMember(self, p: dict) -> dict:  # noqa: N802
        name, did = _need(p, "name", "did")
        return {"member": G.is_member(did, self.audiences.get(name), self.records, self.links)}

    def verb_previewAudience(self, p: dict) -> dict:  # noqa: N802
        (definition,) = _need(p, "definition")
        G.check_audience(definition)
        found = G.members(definition, self.records, self.links)
        return {"count": found.count(), "members": [r.did for r in found.orderBy("did").limit(P.clamp(p.get("limit"), "preview")).collect()]}

    def verb_createAudience(self, p: dict) -> dict:  # noqa: N802
        return self.audiences.create(*_need(p, "name", "definition"))

    def verb_updateAudience(self, p: dict) -> dict:  # noqa: N802
        return self.audiences.update(*_need(p, "name", "definition"))

    def verb_deleteAudience(self, p: dict) -> dict:  # noqa: N802
        self.audiences.delete(*_need(p, "name"))
        return {"deleted": p["name"]}

    def verb_getWebhooks(self, p: dict) -> dict:  # noqa: N802
        return {"webhooks": [self._shown(s) for s in self.subscriptions.list()]}

    def verb_getWebhook(self, p: dict) -> dict:  # noqa: N802
        return self._shown(self.subscriptions.get(*_need(p, "name")))

    @staticmethod
    def _shown(s: DL.Subscription) -> dict:
        return {k: v for k, v in asdict(s).items() if k != "secret"}

    def verb_createWebhook(self, p: dict) -> dict:  # noqa: N802
        """A subscription starts at the head of the log unless it names a cursor."""
        if "cursor" not in p:
            p["cursor"] = self.events.agg(F.max("id")).first()[0] or 0
        return self._shown(self.subscriptions.create(**p))

    def verb_updateWebhook(self, p: dict) -> dict:  # noqa: N802
        return self._shown(self.subscriptions.update(p.pop("name"), **p))

    def verb_deleteWebhook(self, p: dict) -> dict:  # noqa: N802
        self.subscriptions.delete(*_need(p, "name"))
        return {"deleted": p["name"]}

    def verb_testWebhook(self, p: dict) -> dict:  # noqa: N802
        sub = self.subscriptions.get(*_need(p, "name"))
        if self.post is None:
            raise UpstreamFailure("no transport")
        body = '{"test":true}'
        return {"status": self.post(sub.url, {"X-Archive-Subscription": sub.name, "X-Archive-Signature": DL.signature(sub.secret, body)}, body)}

    def deliver_due(self) -> int:
        """One pass over all subscriptions; the number of batches delivered."""
        sent = 0
        for sub in self.subscriptions.list():
            batch = DL.pending_batch(sub, self.events, self.records, self.links, self.audiences, self.config.following) if sub.status == "active" else None
            if batch is None or self.post is None:
                continue
            after = DL.deliver(sub, _rows(batch), self.post, self.clock())
            sent += after.cursor > sub.cursor
            self.subscriptions.named[sub.name] = after
        return sent

    def verb_backfillRepo(self, p: dict) -> dict:  # noqa: N802
        """One import per account at a time; a second request while one runs starts nothing."""
        (did,) = _need(p, "did")
        if self.backfill is None:
            raise UpstreamFailure("no repository source")
        if did in self.running:
            return {"did": did, "started": False}
        self.running.add(did)
        try:
            self.backfill(did)
        finally:
            self.running.discard(did)
        if did in self.watched.rows:
            self.watched.update(did, snapshot_at=self.clock())
        return {"did": did, "started": True}

    def verb_getRepoBackfills(self, p: dict) -> dict:  # noqa: N802
        return {"running": sorted(self.running)}

    def verb_backfillEvents(self, p: dict) -> dict:  # noqa: N802
        """Adds the events that the log lacks for known records; a second time it adds none."""
        head = self.events.agg(F.max("id")).first()[0] or 0
        missing = AR.numbered(AR.missing_events(self.records, self.events), "record_id", head + 1).drop("record_id")
        added = missing.count()
        self.events = self.events.unionByName(missing, allowMissingColumns=True)
        return {"added": added}


def _list_verbs(name: str, attribute: str, parameter: str, plural: str) -> None:
    def listed(self: Engine, p: dict) -> dict:
        return {"rows": [getattr(self, attribute).rows[k] for k in sorted(getattr(self, attribute).rows)]}

    def add(self: Engine, p: dict) -> dict:
        (value,) = _need(p, parameter)
        return getattr(self, attribute).add(value, **{k: v for k, v in p.items() if k != parameter})

    def remove(self: Engine, p: dict) -> dict:
        return getattr(self, attribute).remove(*_need(p, parameter))

    setattr(Engine, f"verb_get{plural}", listed)
    setattr(Engine, f"verb_add{name}", add)
    setattr(Engine, f"verb_remove{name}", remove)


for _row in (
    ("WatchedDid", "watched", "did", "WatchedDids"),
    ("BlockedDid", "blocked_dids", "did", "BlockedDids"),
    ("BlockedPds", "blocked_hosts", "pattern", "BlockedPdses"),
    ("ColdDid", "cold_dids", "did", "ColdDids"),
    ("ColdPds", "cold_hosts", "pattern", "ColdPdses"),
):
    _list_verbs(*_row)
Engine.verb_getWatchedDid = lambda self, p: self.watched.get(*_need(p, "did"))
Engine.verb_updateWatchedDid = lambda self, p: self.watched.update(p.pop("did"), **p)
