import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumine.llm.chunking import cuts, pieces, split_texts


def prose(r, sentences):
    out = []
    for i in range(sentences):
        out.append(" ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(4, 18))).capitalize() + ".")
        out.append("\n\n" if r.random() < 0.15 else " ")
    return "".join(out).strip()


def whole(text, found, overlap):
    return "".join(text[a:b][(0 if i == 0 else found[i - 1][1] - a) :] for i, (a, b) in enumerate(found))


def test_pieces_restore_the_text_and_keep_size_and_overlap():
    r = random.Random(3)
    for n in (1, 5, 40, 400):
        text = prose(r, n)
        found = pieces(text)
        assert whole(text, found, 200) == text
        assert all(b - a <= 1800 for a, b in found)
        assert all(found[i][1] - found[i + 1][0] == 200 for i in range(len(found) - 1))
        assert len(found) == 1 or len(text) > 1800
        assert all(text[b - 1].isspace() for _, b in found[:-1])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n.。é𝄞", max_size=400), st.integers(2, 60), st.integers(0, 30))
def test_any_text(text, limit, overlap):
    if overlap >= limit:
        with pytest.raises(ValueError):
            cuts(text, limit, overlap)
        return
    text = text.strip()
    found = pieces(text, limit, overlap)
    assert whole(text, found, overlap) == text and all(0 < b - a <= limit for a, b in found if text)


def test_an_edit_alters_only_nearby_pieces():
    r = random.Random(4)
    kept = total = 0
    for _ in range(20):
        text = prose(r, 300)
        at = text.index(" ", len(text) // 3)
        changed = text[:at] + " some added words here" + text[at:]
        before = {text[a:b] for a, b in pieces(text)}
        after = {changed[a:b] for a, b in pieces(changed)}
        kept += len(before & after)
        total += len(before)
    assert kept > 0.7 * total


def test_split_texts_handles_every_kind_of_row(spark):
    rows = [(1, "short"), (2, " " * 3000), (3, None), (4, ""), (5, "　" + "x" * 5000), (6, "short"), (6, "short"), (None, "y z " * 900), (8, " " * 900 + "a b" + "\n" * 900)]
    df = spark.createDataFrame(rows, "id long, t string").withColumnRenamed("id", "piece")
    out = split_texts(df, "piece", "t").collect()
    by = {}
    for x in out:
        by.setdefault(x.item_id, []).append(x)
    assert set(by) == {1, 5, 6, 8, None} and len(by[6]) == 2 and by[8][0].piece_text == "a b" and by[8][0].pieces == 1
    assert len(by[5]) == by[5][0].pieces > 2 and all(len(x.piece_text) <= 1800 for x in out)
    assert split_texts(df.limit(0), "piece", "t").count() == 0
