import json

import pytest
from pyspark.sql import functions as F

from vellumine.errors import InvalidRequest, RecordNotFound
from vellumine.functions.jsonpath import contains
from vellumine.operators import paging
from vellumine.operators import records as RC
from vellumine.operators.where import compile_sort, compile_where

SCHEMA = "id long, did string, collection string, rkey string, uri string, cid string, rev string, record string, lang string, embed_status string, cold boolean, extracted_title string, extracted_text string, indexed_at timestamp, deleted_at timestamp"


def frame(spark, rows):
    base = dict(did="d", collection="c", rkey="r", uri="u", cid=None, rev=None, record="{}", lang=None, embed_status="done", cold=False, extracted_title=None, extracted_text=None, indexed_at=None, deleted_at=None)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple((base | {"id": i} | r)[n] for n in names) for i, r in enumerate(rows)], SCHEMA)


def model(have, need):
    if isinstance(need, dict):
        return isinstance(have, dict) and all(k in have and model(have[k], v) for k, v in need.items())
    if isinstance(need, list):
        return isinstance(have, list) and all(any(model(h, n) for h in have) for n in need)
    if isinstance(need, bool) or isinstance(have, bool) or need is None or have is None:
        return have is need
    if isinstance(need, (int, float)):
        return isinstance(have, (int, float)) and float(have) == float(need)
    return isinstance(have, str) and have == need


BODIES = [{"t": 1}, {"t": "1"}, {"t": 1.0}, {"t": [1, "a"]}, {"t": {"x": [{"y": 1}, {"y": 2, "z": None}]}}, {"t": None}, {"t": True}, {}, {"t": []}, {"t": {"$type": "q'"}}, {"t": [[1]]}]
NEEDLES = [1, "1", [1], ["a", 1], [], {"x": [{"y": 2}]}, {"x": [{"z": None}]}, None, True, {}, {"$type": "q'"}, [[1]], False, {"x": [{"y": 1, "z": None}]}]


def test_containment_equals_its_rules(spark):
    df = frame(spark, [{"record": json.dumps(b)} for b in BODIES] + [{"record": None}, {"record": '{"t": '}])
    row = df.select("id", *[contains(F.col("record"), "t", n).alias(f"n{k}") for k, n in enumerate(NEEDLES)]).orderBy("id").collect()
    for i, body in enumerate(BODIES):
        for k, need in enumerate(NEEDLES):
            assert row[i][f"n{k}"] == ("t" in body and model(body["t"], need)), (body, need)
    assert not any(row[len(BODIES)][1:]) and not any(row[len(BODIES) + 1][1:])


def test_operators_keep_nulls_and_absent_paths(spark):
    df = frame(spark, [{"cid": "a", "record": '{"title": "100% A_b", "did": "in body"}'}, {"cid": "b", "cold": True}, {"record": '{"tags": ["x", "y"]}'}])
    run = lambda w: sorted(x.id for x in df.filter(compile_where(w)).collect())
    assert run({"cid": {"neq": "a"}}) == [1, 2]
    assert run({"cid": {"nin": ["a", "b"]}}) == [2]
    assert run({"cid": {"in": ["a", "b"]}}) == [0, 1]
    assert run({"cold": {"eq": True}}) == [1]
    assert run({"title": {"neq": "x"}}) == [0, 1, 2]
    assert run({"title": {"contains": "0% a_"}}) == [0]
    assert run({"title": {"contains": "0%_a"}}) == []
    assert run({"tags": {"eq": ["y"]}}) == [2] and run({"tags": {"eq": "y"}}) == []
    assert run({"did": {"eq": "in body"}}) == [] and run({"record.did": {"eq": "in body"}}) == [0]
    assert run({"json": {"contains": "TAGS"}}) == [2]
    assert run({"tags": {"nin": [["x"], ["z"]]}}) == [0, 1]
    assert run(None) == run({}) == [0, 1, 2]


@pytest.mark.parametrize("bad", [{"a": 1}, {"a": {}}, {"a": {"like": 1}}, {"a": {"in": []}}, {"a": {"in": "x"}}, {"a": {"contains": 1}}, {"cid": {"eq": None}}, [1]])
def test_bad_requests_are_refused_when_planned(bad):
    with pytest.raises(InvalidRequest):
        compile_where(bad)


def test_sorting_and_paging(spark):
    df = frame(spark, [{"cid": c} for c in ("b", None, "a", "b", None)])
    ids = lambda s: [x.id for x in df.orderBy(*compile_sort(s)).collect()]
    assert ids(None) == [4, 3, 2, 1, 0]
    assert ids([{"field": "cid"}]) == [2, 3, 0, 4, 1]
    assert ids([{"field": "cid", "direction": "desc"}]) == [4, 1, 3, 0, 2]
    page, start = paging.offset_page(df, compile_sort(None), 2, "2")
    assert [x.id for x in page.collect()] == [2, 1] and start == 2
    assert paging.next_offset(2, 2, 2) == "4" and paging.next_offset(4, 1, 2) is None
    for bad in ([{"field": "json"}], [{"field": "cid", "direction": "up"}]):
        with pytest.raises(InvalidRequest):
            compile_sort(bad)
    with pytest.raises(InvalidRequest):
        paging.offset_page(df, [], 2, "-1")


def test_limits_and_cursors():
    assert [paging.clamp(v, "records") for v in (None, 0, -3, 1.5, "x", 7, "7", 1000, True)] == [50, 50, 50, 50, 50, 7, 7, 100, 50]
    c = paging.RankCursor(0.1 + 0.2, 5, 1700000000123)
    assert paging.RankCursor.decode(c.encode()) == c
    for bad in ("", "x", "!!!", paging.encode_id(5)):
        with pytest.raises(InvalidRequest):
            paging.RankCursor.decode(bad)
    assert paging.decode_id(paging.encode_id(17)) == 17 and paging.decode_id("garbage") is None and paging.decode_id(None) is None


def test_point_lookup_and_unique_rows(spark):
    df = frame(spark, [{"uri": "at://a"}, {"uri": "at://b"}])
    assert RC.get_record(df, "c", "at://b").count() == 1
    with pytest.raises(RecordNotFound):
        RC.get_record(df, "other", "at://b")
    assert RC.unique_records(df.unionByName(df)).count() == 2
    assert RC.count_records(df, "c", {"uri": {"contains": "a"}}).first()["count"] == 2
