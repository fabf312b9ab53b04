import os
import random

import numpy as np
import pytest

from vellumine.llm.packing import pack, pack_block, token_counts

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_no_container_overflows_and_fill_is_high():
    r = np.random.default_rng(2)
    for capacity, sizes in ((2048, r.integers(1, 2049, 5000)), (2048, np.maximum(1, r.lognormal(5, 0.8, 20000).astype(int) % 2048)), (10, r.integers(1, 11, 1)), (7, np.full(50, 7))):
        where, n = pack_block(sizes, capacity)
        held = np.bincount(where, weights=sizes, minlength=n)
        assert (where >= 0).all() and held.max() <= capacity and (held > 0).all()
        assert n <= 1.7 * np.ceil(sizes.sum() / capacity) + 20
    where, n = pack_block(np.zeros(0, dtype=np.int64), 10)
    assert n == 0


def test_every_token_has_one_place(spark):
    r = random.Random(3)
    rows = [(i, r.choice([0, 1, 50, 300, 2048, 2049, 9000, r.randrange(1, 2048)])) for i in range(3000)] + [(9001, None), (5, 77), (5, 77)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long").selectExpr("*", "doc_id as block", "1 as part")
    out = pack(df, block=500).collect()
    held, got = {}, {}
    for x in out:
        held[x.container] = held.get(x.container, 0) + x.token_end - x.token_start
        got[x.doc_id] = got.get(x.doc_id, 0) + x.token_end - x.token_start
        assert x.token_start == x.part * 2048 and x.token_end > x.token_start
    want = {}
    for i, n in rows:
        if n:
            want[i] = want.get(i, 0) + n
    assert got == want and max(held.values()) <= 2048
    assert sum(held.values()) > 0.85 * 2048 * len(held)
    assert pack(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.exists(RANKS), reason="no tokenizer files")
def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "a " * 50000)], "doc_id long, text string")
    got = {x.doc_id: x.tokens for x in token_counts(df, "doc_id", "text", RANKS).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] >= 50000
