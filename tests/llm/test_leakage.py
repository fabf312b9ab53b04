import random

import numpy as np
import pytest

from vellumine.llm import leakage
from vellumine.llm.leakage import build_index, leaked_phrases, near_passages, run_at
from vellumine.llm.words import normal_words


def brute(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            best = max(best, k)
    return best


def test_longest_run_equals_brute_force():
    r = random.Random(5)
    for _ in range(300):
        a, b = ([r.randrange(4) for _ in range(r.randrange(12))] for _ in range(2))
        at = [run_at(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), shift) for shift in range(-12, 13)]
        assert max(at) == brute(a, b)


def test_words_are_compared_after_normalisation():
    assert normal_words("Ｔｈｅ co­op's x_y ﬁ​n 1½") == ["the", "coop", "s", "x", "y", "fin", "11", "2"]


@pytest.mark.parametrize("probes,broadcast,hot", [(3, 1 << 20, 1 << 22), (1, 1 << 20, 1 << 22), (12, 0, 50), (2, 0, 1 << 22)])
def test_leaks_equal_brute_force(spark, monkeypatch, probes, broadcast, hot):
    monkeypatch.setattr(leakage, "MOST_BROADCAST", broadcast)
    monkeypatch.setattr(leakage, "HOT_POSTINGS", hot)
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 60)))) for i in range(30)] + [(90, None), (91, "")]
    items.append(items[0])
    documents = []
    for d in range(80):
        words = [r.choice(vocabulary) for _ in range(r.randrange(0, 40))]
        for _ in range(r.randrange(3)):
            item = items[r.randrange(30)][1].split()
            if item:
                at = r.randrange(len(item))
                words[len(words) // 2 : len(words) // 2] = item[at : at + r.choice([11, 12, 13, 30])]
        documents.append((d, r.choice([" ", ", ", "\n> "]).join(words).upper()))
    documents += [(500, None), (501, ""), documents[0], (None, documents[1][1])]
    want = {}
    for d, t in documents:
        for i, q in items:
            n = brute(normal_words(q or ""), normal_words(t or ""))
            if n >= 12:
                want[d, i] = n
    docs = spark.createDataFrame(documents, "doc_id long, text string").withColumn("term", docs_clash())
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.longest for x in leaked_phrases(docs, frame, probes=probes).collect()}
    assert got == {k: v for k, v in want.items() if k[0] is not None} and len(want) > 20
    assert leaked_phrases(docs.limit(0), frame).count() == 0 and leaked_phrases(docs, frame.limit(0)).count() == 0


def docs_clash():
    from pyspark.sql import functions as F

    return F.lit("a column whose name the operator also uses")


def test_proximity_finds_a_passage_with_words_put_in(spark):
    item = " ".join(f"rare{i}" for i in range(40))
    spaced = " ".join(f"rare{i}" + (" noise" if i % 10 == 0 else "") for i in range(40))
    docs = spark.createDataFrame([(1, spaced), (2, "quite another text " * 20), (3, "rare1 " * 50)], "doc_id long, text string")
    found = near_passages(build_index(docs), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(x.doc_id, x.item_id) for x in found] == [(1, 7)]


def test_proximity_counts_only_terms_that_the_corpus_has(spark):
    known = [f"rare{i}" for i in range(20)]
    mixed = " ".join(f"{w} absent{i}" for i, w in enumerate(known))
    docs = spark.createDataFrame([(1, " ".join(f"{w} other" for w in known)), (2, "one two three four five"), (3, "quite another text")], "doc_id long, text string")
    items = spark.createDataFrame([(7, mixed), (8, "one two three"), (9, "absent words"), (10, "three absent"), (11, None), (12, "")], "item_id long, text string")
    found = near_passages(build_index(docs), items).collect()
    assert sorted((x.doc_id, x.item_id, x.matched, x.terms) for x in found) == [(1, 7, 10, 10), (2, 8, 2, 2), (2, 10, 1, 1)]


def test_the_format_characters_are_unicodes():
    import unicodedata

    from vellumine.llm.words import _FORMAT

    assert all((unicodedata.category(chr(i)) == "Cf") == bool(_FORMAT.fullmatch(chr(i))) for i in range(0x110000))


def test_windows_of_stop_words_only(spark):
    """Every document is full of the item's words; only one has them in its order."""
    r = random.Random(8)
    stop = ["the", "of", "and", "to", "in", "a"]
    item = [r.choice(stop) for _ in range(14)]
    documents = [(i, " ".join(r.choice(stop) for _ in range(400))) for i in range(50)]
    documents.append((99, " ".join([*documents[0][1].split()[:100], *item[1:13], "end"])))
    want = {(d, 7): brute(item, t.split()) for d, t in documents if brute(item, t.split()) >= 12}
    got = leaked_phrases(spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"))
    assert {(x.doc_id, x.item_id): x.longest for x in got.collect()} == want and want[99, 7] >= 12


def test_runs_of_anchors_go_on_across_batches(spark):
    words = [f"w{i}" for i in range(3000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[10:21] + ["x"] + words[22:40]))], "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(words)), (6, " ".join(words[:25]))], "item_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = {(x.doc_id, x.item_id): x.longest for x in leaked_phrases(docs, items).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(1, 5): 3000, (1, 6): 25, (2, 5): 18}
