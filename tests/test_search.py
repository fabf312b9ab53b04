import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_where import frame
from vellumine.errors import InvalidRequest, ServiceUnavailable
from vellumine.operators import ranking as RK
from vellumine.operators import search as S

NOW = dt.datetime(2025, 6, 1, tzinfo=dt.timezone.utc)


def corpus(spark):
    return frame(
        spark,
        [
            {"extracted_title": "Night trains", "extracted_text": "The night train runs to the library."},
            {"extracted_title": "Libraries", "extracted_text": "A catalogue of libraries; the train at night."},
            {"extracted_text": "Le train de nuit des trains", "lang": "fr", "cold": True},
            {"extracted_title": "night train", "extracted_text": None, "deleted_at": dt.datetime(2025, 1, 1)},
            {},
        ],
    )


def test_query_language(spark):
    q = S.parse_query('The "night trains" or libraries -"cold catalogue" -the or')
    assert q.groups == [[["night", "train"], ["library"]]] and q.excluded == [["cold", "catalogue"]]
    rows = S.searchable(corpus(spark))
    ids = lambda text: sorted(x.id for x in rows.filter(S.matches(S.parse_query(text))).collect())
    assert ids("night train") == [0, 1, 3]
    assert ids('"night train"') == [0, 3]
    assert ids("train -library") == [2, 3]
    assert ids("catalogue or nuit") == [1, 2]
    assert ids("the") == [] and ids("-night") == [2, 4]


def test_stemming_is_the_same_on_both_sides(spark):
    words = ["libraries", "trains", "catalogues", "bus", "class", "does", "ties", "is", "as", "aries", "queues", "cafés"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for x in df.select("w", F.get(S.terms(df.w), F.lit(0)).alias("t")).collect():
        if x.w not in S.STOP_WORDS:
            assert x.t == S.stem_english(x.w)


def test_keyword_order_cold_rows_and_modes(spark):
    df = corpus(spark)
    assert [x.id for x in S.keyword_search(df, "night train").collect()] == [0, 1]
    assert [x.id for x in S.keyword_search(df, "train", exclude_cold=False).collect()] == [0, 2, 1]
    with pytest.raises(InvalidRequest):
        S.search(df, "x", "other")
    with pytest.raises(InvalidRequest):
        S.search(df, " ")
    with pytest.raises(ServiceUnavailable):
        S.search(df, "x", "semantic", df, embed=None)
    with pytest.raises(InvalidRequest):
        S.search(df, "x", "hybrid", df, embed=lambda q: [1.0], ranking={})
    assert S.search(df, "night train", embed=lambda q: 1 / 0).count() == 2


def test_vector_and_fused_search(spark):
    df = corpus(spark)
    chunks = [(1, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0]), (3, 1, [0.6, 0.8]), (4, 2, [-1.0, 0.0]), (5, 3, [0.0, 0.0]), (6, 1, None), (7, 1, [1.0]), (8, 0, [float("nan"), 1.0])]
    e = spark.createDataFrame(chunks, "id long, record_id long, embedding array<float>")
    q = [0.0, 2.0]
    got = {x.id: x.distance for x in S.chunk_distances(e, q).collect()}
    assert set(got) == {1, 2, 3, 4} and np.isclose(got[2], 0) and np.isclose(got[3], 0.2) and np.isclose(got[1], 1)
    column = {x.id: x.d for x in e.filter(F.size("embedding") == 2).select("id", S.cosine_distance(F.col("embedding"), q).alias("d")).collect()}
    assert all(np.isclose(column[i], got[i]) for i in got) and column[5] is None
    assert [x.id for x in S.semantic_search(df, e, q).collect()] == [0, 1, 2]
    assert [x.id for x in S.semantic_search(df, e, q, prefilter=True, collection="none").collect()] == []
    fused = S.hybrid_search(df, e, "night train", q).collect()
    assert [x.id for x in fused] == [0, 1, 2] and np.isclose(fused[0].score, 2 / 61)


def test_headlines():
    text = " ".join(f"w{i}" for i in range(100))
    out = S.headline(text, {"w50", "w52", "w99"})
    assert out.count("<mark>") == 3 and " … " in out and "<mark>w50</mark>" in out
    assert S.headline("no hit", {"x"}) == "no hit" and S.headline("", {"x"}) == ""


def test_ranking_profiles(spark):
    links = (RK.Link("follow", "to", 2.0),)
    good = RK.Profile("p", (RK.Signal("interactions", 1.0, links, "clamp", 1.0, 3.0), RK.Signal("recency", 2.0, field="indexedAt", half_life_hours=24.0), RK.Signal("relevance", 1.0))).check()
    for bad in ((), (RK.Signal("other", 1.0),), (RK.Signal("relevance", float("nan")),), (RK.Signal("interactions", 1.0),), (RK.Signal("interactions", 1.0, links, "cube"),), (RK.Signal("recency", 1.0, field="x"),), (RK.Signal("relevance", True),)):
        with pytest.raises(InvalidRequest):
            RK.Profile("p", bad).check()
    rows = [{"uri": f"u{i}", "indexed_at": dt.datetime(2025, 5, 31 - i % 5)} for i in range(25)]
    df = frame(spark, rows)
    counts = spark.createDataFrame([("u3", "follow:to", 1), ("u4", "follow:to", 9), ("u5", "other:x", 9)], "target_uri string, kind string, count long")
    seen, cursor = [], None
    while True:
        page = RK.ranked_page(df, good, counts, NOW, 7, cursor).collect()
        if not page:
            break
        seen += [(x.id, x.score) for x in page]
        cursor = RK.next_cursor(page, NOW)
    assert len(seen) == 25 == len({i for i, _ in seen}) and [s for _, s in seen] == sorted((s for _, s in seen), reverse=True)
    by = dict(seen)
    assert np.isclose(by[4] - by[9], 2.0) and np.isclose(by[3] - by[8], 1.0)
    only = RK.ranked_page(df, RK.Profile("q", (RK.Signal("relevance", 1.0),)), counts, NOW, 3).collect()
    assert [x.id for x in only] == [24, 23, 22]


def test_rollup_upkeep(spark):
    counts = spark.createDataFrame([("a", "k:p", 2), ("b", "k:p", 1)], "target_uri string, kind string, count long")
    deltas = spark.createDataFrame([("a", "k:p", -1), ("b", "k:p", -5), ("c", "k:p", 1)], "target_uri string, kind string, count long")
    assert {(x.target_uri, x["count"]) for x in RK.rollup_deltas(counts, deltas).collect()} == {("a", 1), ("c", 1)}
    network = spark.createDataFrame([("a", "k", ".p", 40)], "target_uri string, collection string, path string, count long")
    assert {(x.target_uri, x["count"]) for x in RK.set_network_counts(counts, network).collect()} == {("a", 40), ("b", 1)}
    plan = RK.plan_sources([RK.Link("x", "p"), RK.Link("y", "p"), RK.Link("z", "p"), RK.Link("w", "p")], ["x", "y", "z"], {"x": RK.Coverage(9, 10), "y": RK.Coverage(8, 10), "z": RK.Coverage(complete=True)}, {"w": "local"})
    assert [s for _, s in plan] == ["local", "network", "local", "local"]


def test_phrases_are_matched_on_terms_made_once(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [
        {"extracted_title": "Night of the trains", "extracted_text": None},
        {"extracted_text": f"{long} winter timetables"},
        {"extracted_text": f"{long} winter", "extracted_title": "timetable"},
        {"extracted_text": "night train to the glossaries, a glossary"},
        {"extracted_text": "midnight trains; night trainee"},
        {"extracted_text": "Night\ntrains", "lang": "fr"},
        {"extracted_text": "NIGHT train", "lang": "fr"},
        {"extracted_text": "libraries y", "extracted_title": None},
        {},
    ]
    df = frame(spark, rows)
    for text in ('"night train" or "winter timetable" -glossary', "library", "y", "-night", "the", '"library y" -train', "night trainee"):
        q = S.parse_query(text)
        want = sorted(x.id for x in S.searchable(df).filter(S.matches(q)).collect())
        assert sorted(x.id for x in S.matching(df, q).collect()) == want
        if text.startswith('"night'):
            assert want == [0, 1, 6]
            plan = S.matching(df, q)._jdf.queryExecution().optimizedPlan().toString()
            assert "exists(" not in plan and plan.count("regexp_extract_all") <= 4
