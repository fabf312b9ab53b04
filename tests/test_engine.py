import datetime as dt

import pytest

from tests.test_graph import ALICE, BOB, CAROL, DOC, SUB, world  # noqa: F401
from vellumine import errors as X
from vellumine.engine import Config, Engine
from vellumine.operators import ranking as RK
from vellumine.sources.wire import NetworkCounts, Registry

NOW = dt.datetime(2025, 6, 1, tzinfo=dt.timezone.utc)
# The service verbs.
VERBS = """getEvents subscribeEvents getTypes getType getLinks getBacklinks getNetworkBacklinks getFootprint aggregate getRankedFeed getBackfillStatus getWebhooks getWebhook getAudiences
getAudience getAudienceMembers checkAudienceMember getWatchedDids getWatchedDid getBlockedDids getBlockedPdses getColdDids getColdPdses getRepoBackfills createWebhook updateWebhook deleteWebhook
testWebhook previewAudience createAudience updateAudience deleteAudience addWatchedDid updateWatchedDid removeWatchedDid addBlockedDid removeBlockedDid addBlockedPds removeBlockedPds addColdDid
removeColdDid addColdPds removeColdPds backfillRepo backfillEvents""".split()


@pytest.fixture
def engine(world, spark):  # noqa: F811
    records, links = world
    events = spark.createDataFrame([(1, CAROL, DOC, "3", "create", None, True, dt.datetime(2025, 1, 1))], "id long, did string, collection string, rkey string, action string, rev string, live boolean, created_at timestamp")
    chunks = spark.createDataFrame([(1, 3, [1.0, 0.0])], "id long, record_id long, embedding array<float>")
    profile = RK.Profile("fresh", (RK.Signal("recency", 1.0, field="indexedAt", half_life_hours=24.0),))
    posts = []
    e = Engine(records, links, events, chunks, Config({"fresh": profile}), embed=lambda q: [1.0, 0.0], network=NetworkCounts(lambda e, p: {e: p}, dt.timedelta(hours=1)), schemas=Registry(lambda n: None), backfill=lambda d: None, post=lambda u, h, b: posts.append(b) or 200, clock=lambda: NOW)
    e.posts = posts
    return e


def test_every_verb_exists(engine):
    assert len(VERBS) == 45 and all(hasattr(engine, f"verb_{v}") for v in VERBS)
    for bad in ("x.y.z.createRecord", "x.y.z.deleteRecord", "getRecords"):
        with pytest.raises(X.MethodNotImplemented):
            engine.records_call(bad)
    with pytest.raises(X.MethodNotImplemented):
        engine.call("nothing")


def test_collection_plane(engine):
    page = engine.records_call(f"{DOC}.getRecords", {"limit": 1})
    assert [r["uri"] for r in page["records"]] == ["d4"] and page["cursor"] == "1"
    page = engine.records_call(f"{DOC}.getRecords", {"limit": 2, "cursor": "1"})
    assert [r["uri"] for r in page["records"]] == ["d3"] and page["cursor"] is None
    assert engine.records_call(f"{SUB}.countRecords", {"includeDeleted": True}) == {"count": 3}
    assert engine.records_call(f"{DOC}.getRecord", {"uri": "d3"})["value"] == '{"k": "x"}'
    with pytest.raises(X.InvalidRequest):
        engine.records_call(f"{DOC}.getRecord")
    assert engine.records_call(f"{DOC}.searchRecords", {"q": "x", "facets": ["did"], "highlight": True}) == {"facets": {"did": []}, "records": []}
    assert [r["uri"] for r in engine.records_call(f"{DOC}.searchRecords", {"q": "x", "mode": "semantic"})["records"]] == ["d3"]
    assert engine.records_call(f"{DOC}.searchRecords", {"q": "x", "ranking": "fresh"}) == {"records": [], "cursor": None}
    with pytest.raises(X.InvalidRequest):
        engine.records_call(f"{DOC}.searchRecords", {"q": "x", "ranking": "none"})


def test_service_queries(engine):
    assert engine.call("getEvents")["cursor"] == "1" and engine.call("getEvents", {"cursor": 1}) == {"events": [], "cursor": None}
    assert engine.call("subscribeEvents", {"cursor": 1})[0].startswith("event: ping")
    assert engine.call("aggregate", {"source": "records", "groupBy": "collection"})["groups"][0] == {"key": {"collection": DOC}, "count": 2}
    assert engine.call("getTypes") == {"types": []} and engine.call("getType", {"nsid": "a.b.c"})["authority"] == "b.a"
    assert len(engine.call("getLinks", {"uri": "d4"})["links"]) == 2 and len(engine.call("getBacklinks", {"uri": "p2"})["backlinks"]) == 2
    assert engine.call("getNetworkBacklinks", {"uri": "u", "collection": "c", "path": "p", "count": 1})["data"] == {"links/count": {"target": "u", "collection": "c", "path": "p"}}
    engine.call("addWatchedDid", {"did": ALICE, "note": "n"})
    foot = engine.call("getFootprint", {"did": ALICE, "limit": 1})
    assert foot["totals"] == {"records": 2, "deleted": 1} and foot["watched"] and [r["uri"] for r in foot["records"]] == ["s0"] and foot["cursor"]
    assert engine.call("getFootprint", {"did": ALICE, "cursor": foot["cursor"]})["records"] == []
    feed = engine.call("getRankedFeed", {"ranking": "fresh", "collection": DOC, "limit": 1})
    assert feed["feed"] == [{"post": "d4"}]
    assert engine.call("getRankedFeed", {"ranking": "fresh", "collection": DOC, "limit": 1, "cursor": feed["cursor"]})["feed"] == [{"post": "d3"}]
    assert engine.call("getBackfillStatus")["collections"][0]["collection"] == DOC


def test_lists_audiences_and_imports(engine):
    for noun, p in (("BlockedDid", {"did": BOB}), ("ColdDid", {"did": BOB}), ("BlockedPds", {"pattern": "https://x.*"}), ("ColdPds", {"pattern": "https://x.*"})):
        engine.call(f"add{noun}", p)
        assert len(engine.call(f"get{noun}{'es' if noun.endswith('Pds') else 's'}")["rows"]) == 1
        engine.call(f"remove{noun}", p)
        with pytest.raises(X.NotFound):
            engine.call(f"remove{noun}", p)
    with pytest.raises(X.InvalidRequest):
        engine.call("addBlockedDid", {"did": "nobody"})
    static = {"kind": "static", "dids": [BOB, ALICE]}
    assert engine.call("previewAudience", {"definition": static})["count"] == 2
    engine.call("createAudience", {"name": "a", "definition": static})
    assert engine.call("getAudienceMembers", {"name": "a"})["members"] == [ALICE, BOB] and engine.call("checkAudienceMember", {"name": "a", "did": CAROL}) == {"member": False}
    assert engine.call("getAudience", {"name": "a"})["members"] == 2
    engine.call("addWatchedDid", {"did": BOB})
    assert engine.call("backfillRepo", {"did": BOB}) == {"did": BOB, "started": True} and engine.call("getWatchedDid", {"did": BOB})["snapshot_at"] == NOW
    assert engine.call("backfillEvents") == {"added": 4} and engine.call("backfillEvents") == {"added": 0}
    engine.call("createWebhook", {"name": "w", "url": "https://x", "secret": "s", "cursor": 0})
    assert "secret" not in engine.call("getWebhook", {"name": "w"}) and engine.call("testWebhook", {"name": "w"}) == {"status": 200}
    assert engine.deliver_due() == 1 and engine.call("getWebhook", {"name": "w"})["cursor"] == 5 and engine.deliver_due() == 0
    assert len(engine.posts) == 2
