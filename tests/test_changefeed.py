import random

from vellumine.operators.changefeed import apply_changes, mark_applied

SCHEMA = "id long, did string, collection string, rkey string, action string, cid string, rev string, extra string"
BASE = "did string, collection string, rkey string, cid string, rev string, deleted boolean"
KEYS = ["did", "collection", "rkey"]


def fold(rows, base=()):
    state = {(d, c, k): (rev or None, None if gone else cid) for d, c, k, cid, rev, gone in base}
    applied = {}
    for i, d, c, k, action, cid, rev, _ in sorted(set(rows)):
        rev = rev or None
        old = state.get((d, c, k), (None, None))[0]
        applied[i] = not (rev and old and rev <= old)
        if applied[i]:
            state[d, c, k] = (rev, None if action == "delete" else (cid,))
    alive = {(*key, v[0] if isinstance(v, tuple) else v) for key, (_, v) in state.items() if v is not None}
    return alive, applied


def history(r, n, keys):
    rows = []
    for i in range(n):
        key = (f"d{r.randrange(keys)}", "c", None if r.random() < 0.1 else "r")
        rows.append((i * 3, *key, r.choice(["create", "update", "delete"]), f"cid{r.randrange(5)}", r.choice([None, "", *(f"3{r.randrange(30):02d}" for _ in range(6))]), "x"))
    rows += r.sample(rows, n // 5)
    r.shuffle(rows)
    return rows


def test_state_and_marks_equal_a_sequential_fold_at_any_block_size(spark):
    r = random.Random(1)
    rows = history(r, 600, 6)
    alive, applied = fold(rows)
    feed = spark.createDataFrame(rows, SCHEMA)
    for block in (7, 100, 1 << 18):
        got = apply_changes(feed, KEYS, ["cid"], block=block).collect()
        assert len(got) == len(alive) and {tuple(x) for x in got} == alive
        marks = {x.id: x.applied for x in mark_applied(feed, KEYS, block=block).collect()}
        assert marks == applied


def test_base_rows_and_tombstones_guard_their_keys(spark):
    r = random.Random(2)
    base = [("d0", "c", "r", "old0", "320", False), ("d1", "c", "r", "old1", "310", True), ("d9", "c", "r", "old9", None, False), ("d8", "c", None, "old8", "305", False)]
    for n in (0, 40, 200):
        rows = history(r, n, 4)
        alive, _ = fold(rows, base)
        feed = spark.createDataFrame(rows, SCHEMA)
        got = apply_changes(feed, KEYS, ["cid"], base=spark.createDataFrame(base, BASE), block=9).collect()
        assert len(got) == len(alive) and {tuple(x) for x in got} == alive


def test_empty_feed_gives_no_rows(spark):
    assert apply_changes(spark.createDataFrame([], SCHEMA), KEYS, ["cid"]).count() == 0
