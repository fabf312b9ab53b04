import datetime as dt

from pyspark.sql import functions as F

from vellumine.operators import archive as AR

T = lambda h: dt.datetime(2025, 1, 1, h)
SCHEMA = "id long, did string, collection string, rkey string, action string, record string, cid string, rev string, live boolean, created_at timestamp"


def test_fold_keeps_bodies_marks_tombstones_and_revives(spark):
    rows = [
        (1, "a", "c", "1", "create", '{"v":1,"lang":"fr"}', "x1", "1", True, T(1)),
        (2, "a", "c", "1", "delete", None, None, "2", True, T(2)),
        (3, "a", "c", "2", "delete", None, None, "1", True, T(3)),
        (4, "a", "c", "3", "create", "{}", "x2", "1", True, T(4)),
        (5, "a", "c", "3", "delete", None, None, "2", True, T(5)),
        (6, "a", "c", "3", "update", '{"v":2}', "x3", "3", True, T(6)),
        (7, "a", "c", "3", "update", '{"v":9}', "x9", "2", True, T(7)),
        (7, "a", "c", "3", "update", '{"v":9}', "x9", "2", True, T(7)),
    ]
    got = {x.rkey: x for x in AR.fold(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got["1"].record, got["1"].cid, got["1"].rev, got["1"].deleted_at, got["1"].lang) == ('{"v":1,"lang":"fr"}', "x1", "2", T(2), "fr")
    assert (got["2"].record, got["2"].embed_status, got["2"].deleted_at) == ("{}", "skipped", T(3))
    assert (got["3"].cid, got["3"].deleted_at, got["3"].indexed_at, got["3"].uri) == ("x3", None, T(6), "at://a/c/3")
    assert AR.fold(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lists_block_cool_and_purge(spark):
    records = spark.createDataFrame([(1, "a", "done", False, None), (2, "b", "done", True, None), (3, "c", "skipped", True, T(1)), (4, "d", "pending", None, None)], "id long, did string, embed_status string, cold boolean, deleted_at timestamp")
    hosts = spark.createDataFrame([("a", "https://x.example/"), ("b", "https://y.example"), ("d", None)], "did string, pds string")
    cool = {x.did: (x.embed_status, x.cold) for x in AR.cooled(records, spark.createDataFrame([("c",), ("c",)], "did string"), hosts, ["HTTPS://x.*"]).collect()}
    assert cool == {"a": ("skipped", True), "b": ("pending", False), "c": ("skipped", True), "d": ("pending", False)}
    events = records.select("id", "did")
    assert {x.did for x in AR.blocked(events, spark.createDataFrame([("d",)], "did string"), hosts, ["https://y.example/"]).collect()} == {"a", "c"}
    at = F.lit(T(9))
    assert AR.purged(records, "a", "hard", at).count() == 3 and AR.purged(records, "a", "soft", at).filter("deleted_at is not null").count() == 2
    assert AR.purged(records, "a", "block", at).count() == 4
    derived = spark.createDataFrame([(1,), (2,)], "record_id long")
    assert [x.record_id for x in AR.without_derived(derived, records, "a").collect()] == [2]


def test_missing_events_are_numbered_in_order(spark):
    records = spark.createDataFrame([(i, "a", "c", str(i), None, T(1), T(2) if i == 5 else None) for i in range(1, 30)], "id long, did string, collection string, rkey string, rev string, indexed_at timestamp, deleted_at timestamp")
    events = spark.createDataFrame([("a", "c", "3")], "did string, collection string, rkey string")
    rows = AR.numbered(AR.missing_events(records, events), "record_id", 1000).orderBy("id").collect()
    assert [x.record_id for x in rows] == [i for i in range(1, 30) if i != 3]
    assert [x.id for x in rows] == list(range(1000, 1028)) and rows[3].action == "delete"
