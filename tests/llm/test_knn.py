import numpy as np

from vellumine.llm.knn import _best, footrule, nearest, pack_vector, unit, unpack_vector

SCHEMA = "id long, embedding array<float>, vector string, rank int"


def clusters(n, width, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(max(1, n // 12), width))
    v = centres[r.integers(0, len(centres), n)] + 0.4 * r.normal(size=(n, width))
    return v.astype(np.float32)


def brute(ids, v, k=5):
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = np.round(u @ u.T, 7)
    out = {}
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))
        out[ids[i]] = [ids[j] for j in order[:k]]
    return out


def frame(spark, ids, v, extra=()):
    return spark.createDataFrame([(int(i), [float(x) for x in row], "x", 1) for i, row in zip(ids, v)] + list(extra), SCHEMA)


def test_footrule_equals_its_definition():
    r = np.random.default_rng(3)
    ranks = np.array([r.permutation(20)[:6] for _ in range(15)], dtype=np.int16)
    got = footrule(ranks, 6)
    for i in range(15):
        for j in range(15):
            a, b = ranks[i].tolist(), ranks[j].tolist()
            want = sum(abs((a.index(p) if p in a else 6) - (b.index(p) if p in b else 6)) for p in {*a, *b})
            assert got[i, j] == want


def test_vectors_are_kept_without_loss():
    import zstandard

    for v in (np.array([0.5, -3, 1e-3], np.float32), np.arange(64, dtype=np.float32) / 128, np.array([1e30, 1], np.float32)):
        assert np.array_equal(unpack_vector(pack_vector(v, zstandard.ZstdCompressor()), zstandard.ZstdDecompressor()), v)


def test_recall_on_clusters_and_in_tiles(spark):
    v = clusters(600, 24, 4)
    ids = np.random.default_rng(5).permutation(5000)[:600]
    want = brute(ids.tolist(), v)
    for options in ({}, {"tile": 40}, {"rerank": 30}, {"most_pivots": 12, "split": 150}):
        got = {}
        for x in nearest(frame(spark, ids, v), width=24, **options).collect():
            got.setdefault(x.id, set()).add(x.neighbour)
        hits = sum(len(got.get(i, set()) & set(w)) for i, w in want.items())
        assert hits >= 0.9 * 5 * len(ids)


def test_unusable_equal_and_repeated_vectors(spark):
    v = clusters(40, 8, 6)
    v[5:17] = v[4]  # thirteen equal vectors
    v[20] = v[19]
    ids = np.arange(100, 140)
    nan, inf = float("nan"), float("inf")
    extra = [(1, None, None, None), (2, [0.0] * 8, None, None), (3, [1.0] * 7, None, None), (4, [nan] + [1.0] * 7, None, None), (5, [inf] + [1.0] * 7, None, None), (6, [None] + [1.0] * 7, None, None), (None, [1.0] * 8, None, None), (7, [], None, None)]
    extra += [(100, [float(x) for x in v[0]], "x", 2)]
    got = {}
    for x in nearest(frame(spark, ids, v, extra), width=8, files=8, prefix=8).collect():
        got.setdefault(x.id, []).append((x.rank, x.neighbour))
    want = brute(ids.tolist(), v)
    assert {i: [n for _, n in sorted(g)] for i, g in got.items()} == want
    assert nearest(frame(spark, ids, v).limit(0), width=8).count() == 0


def test_all_ties_reach_the_exact_rule(spark):
    r = np.random.default_rng(8)
    v = np.concatenate([clusters(60, 24, 9), r.normal(size=(1, 24)) * r.uniform(0.5, 9, size=(40, 1))]).astype(np.float32)  # forty scaled copies
    ids = r.permutation(1000)[: len(v)]
    want = brute(ids.tolist(), v)
    held = unit(v).astype(np.float32)
    for rerank in (160, 60):
        got = {}
        for q, c, _ in _best(ids, held, np.tile(np.arange(4, dtype=np.int16), (len(v), 1)), None, 5, rerank):
            for x, y in zip(q.tolist(), c.tolist()):
                got.setdefault(x, []).append(y)
        assert got == want
    one = {}  # pivots of every direction: all share a file
    for x in nearest(frame(spark, ids, v), width=24, files=100, prefix=100).collect():
        one.setdefault(x.id, []).append((x.rank, x.neighbour))
    assert {i: [n for _, n in sorted(g)] for i, g in one.items()} == want


def test_long_files_are_split_by_further_pivots():
    from vellumine.llm.knn import files_of

    name = lambda *p: np.array(p, dtype=np.int16).tobytes()
    ranks = np.array([7, 3, 9, 1], dtype=np.int16)
    assert files_of(ranks, 2, set()) == [name(7), name(3)]
    assert files_of(ranks, 2, {name(7)}) == [name(3, 7), name(7, 9), name(3)]
    assert files_of(ranks, 2, {name(7), name(3)}) == [name(3, 7), name(7, 9), name(3, 9)]
    assert files_of(ranks, 1, {name(7), name(3, 7), name(3, 7, 9), name(1, 3, 7), name(1, 3, 7, 9)}) == [name(1, 3, 7, 9), name(7, 9)]


def test_one_pivot_gives_the_exact_answer(spark):
    v = clusters(300, 16, 11)
    ids = np.random.default_rng(12).permutation(900)[:300]
    got = {}
    for x in nearest(frame(spark, ids, v), width=16, most_pivots=1, tile=70, split=100).collect():
        got.setdefault(x.id, []).append((x.rank, x.neighbour))
    assert {i: [n for _, n in sorted(g)] for i, g in got.items()} == brute(ids.tolist(), v)


def test_no_shortlist_cuts_a_large_cluster(spark):
    """700 vectors about as near to one another, all in the same files: the nearest are found among all of them."""
    r = np.random.default_rng(14)
    v = (r.normal(size=32) + 0.5 * r.normal(size=(700, 32))).astype(np.float32)
    ids = r.permutation(2000)[:700]
    got = {}
    for x in nearest(frame(spark, ids, v), width=32, most_pivots=6, files=6).collect():
        got.setdefault(x.id, []).append((x.rank, x.neighbour))
    assert {i: [n for _, n in sorted(g)] for i, g in got.items()} == brute(ids.tolist(), v)
