import random
from fractions import Fraction

import numpy as np
import pytest

from vellumine.llm.components import components
from vellumine.llm.neardup import duplicate_pairs, near_duplicate_groups, near_duplicates, shared_counts
from vellumine.llm.sketches import sketch
from vellumine.llm.words import RUN


def test_every_bin_is_filled_and_agreement_estimates_similarity():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = [base[:300], base[60:360], base[:1], base[:3], base]
    owner = np.repeat(np.arange(5), [len(s) for s in sets])
    got = sketch(np.concatenate(sets), owner, 5, 192)
    assert (got != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    true = 240 / 360
    assert abs((got[0] == got[1]).mean() - true) < 0.12


def texts(r):
    vocabulary = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randrange(2, 80))]
        for _ in range(r.randrange(1, 5)):
            changed = list(words)
            for _ in range(r.randrange(0, 4)):
                changed[r.randrange(len(changed))] = r.choice(vocabulary)
            rows.append((n, r.choice([None, "", "A title"]), r.choice([" ", ", "]).join(changed).upper()))
            n += 1
    return [*rows, (n, None, None), (n + 1, "t", ""), (n + 2, None, "one two"), rows[0], (None, None, "a b c d e f")]


@pytest.mark.parametrize("hot,tile", [(256, 1024), (1, 3), (2, 1000)])
def test_pairs_and_groups_equal_brute_force(spark, hot, tile):
    rows = texts(random.Random(9))
    sets = {}
    for i, title, text in rows:
        if i is not None and text:
            words = RUN.findall((f"{title}\n{text}" if title else text).lower())
            s = {tuple(words[k : k + 3]) for k in range(len(words) - 2)}
            if s:
                sets[i] = s
    want = {(i, j) for i in sets for j in sets if i < j and 10 * len(sets[i] & sets[j]) >= 7 * len(sets[i] | sets[j])}
    df = spark.createDataFrame(rows, "id long, extracted_title string, extracted_text string")
    df = df.withColumn("key", df.id).withColumn("bands", df.id)
    members, links = near_duplicates(df, words=3, threshold=Fraction(7, 10), hot=hot, tile=tile)
    got = [(x.id_a, x.id_b) for x in duplicate_pairs(members, links).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30
    groups = {x.id: x for x in near_duplicate_groups(df, words=3, threshold=Fraction(7, 10), hot=hot, tile=tile).collect()}
    assert set(groups) == set(sets)
    for i, j in want:
        assert groups[i].group_id == groups[j].group_id
    distinct = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    assert {i: g.class_id for i, g in groups.items()} == distinct
    assert {i: g.links for i, g in groups.items()} == {i: len({distinct[j] for p in want if i in p for j in p} - {distinct[i]}) for i in sets}
    leaders = {i: i for i in sets}
    for _ in sets:
        for i, j in want:
            leaders[i] = leaders[j] = min(leaders[i], leaders[j])
    assert {i: g.group_id for i, g in groups.items()} == leaders


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, extracted_title string, extracted_text string")
    members, links = near_duplicates(df)
    assert duplicate_pairs(members, links).count() == 0 and near_duplicate_groups(df).count() == 0


def test_components_of_chains_and_loops(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 100), (201, 200), (202, 201), (None, 5)]
    got = {x.node: x.component for x in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 200, 201: 200, 202: 200}


def test_shared_elements_are_counted():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 60, r.integers(0, 50))) for _ in range(40)] + [np.unique(r.integers(0, 10_000, 300)) for _ in range(5)]
    got = shared_counts(sets)
    want = np.array([[len(np.intersect1d(a, b)) if i != j else 0 for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    assert (got == want).all() and shared_counts([]).shape == (0, 0)


def test_a_template_of_many_records(spark):
    """20,000 records that differ by one word: 2e8 links, counted and grouped without a row each."""
    n = 20_000
    head, tail = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.range(n).selectExpr("id", "cast(null as string) as extracted_title", f"concat('{head} ', 'w', id, ' {tail}') as extracted_text")
    out = near_duplicate_groups(df, words=3, threshold=Fraction(7, 10))
    got = out.groupBy("links", "group_id").count().collect()
    assert [(x.links, x.group_id, x["count"]) for x in got] == [(n - 1, 0, n)]


def test_only_agreeing_pairs_leave_a_band(spark):
    """2,000 records of a common frame: bands that they share by chance give no candidates, in any number of rounds."""
    from vellumine.llm import neardup

    r = random.Random(4)
    frame = [f"f{i}" for i in range(24)]
    rows = [(i, None, " ".join([*frame, *(f"w{r.randrange(10**6)}" for _ in range(36))])) for i in range(2000)]
    rows += [(2000 + i, None, rows[i][2] + " end") for i in range(5)]
    df = spark.createDataFrame(rows, "id long, extracted_title string, extracted_text string")
    counted = []
    for round_rows in (1 << 23, 12 * 2005):
        stages = neardup._stages(df, "id", "extracted_title", "extracted_text", 3, Fraction(7, 10), 256, 1024, round_rows)
        assert stages.cells is None
        counted.append(sorted((x.class_a, x.class_b) for x in stages.pairs.collect()))
    assert counted == [[(i, 2000 + i) for i in range(5)]] * 2
    assert neardup.least_agreeing(Fraction(7, 10)) == 117
