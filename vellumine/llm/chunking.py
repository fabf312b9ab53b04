"""Splitting oversized texts at natural boundaries by content-defined chunking (problem 2).

A rolling hash over the last 32 characters marks landmarks at positions that depend only on the
characters around them.  From one cut the next landmark within the allowed sizes is taken and
snapped to the nearest paragraph, else sentence, else word boundary.  As landmarks move with the
text, an edit alters the pieces around it and the cuts beyond soon fall in the same places again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.functions.batches import by_batch
from vellumine.llm.words import mix

LIMIT, OVERLAP = 1800, 200
#: A landmark is a position whose hash has these bits clear: about one in 128.
_LANDMARK = np.uint64(0x7F)

_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
_SENTENCE = re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[」』”’)]*\s*|\n\s*")
_WORD = re.compile(r"\s+")


def landmarks(text: str) -> np.ndarray:
    """Positions (counts of characters before them) whose 32-character rolling hash is a landmark."""
    h = mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64))
    for step in (1, 2, 4, 8, 16):  # doubling: after these the hash covers 32 characters
        h[step:] = h[step:] + (h[:-step] << np.uint64(step))
    return np.flatnonzero((h >> np.uint64(40)) & _LANDMARK == 0) + 1


def _boundaries(text: str) -> list[np.ndarray]:
    """Cut positions by class: paragraphs, sentences, words (each after its white space)."""
    return [np.array([m.end() for m in p.finditer(text)], dtype=np.int64) for p in (_PARAGRAPH, _SENTENCE, _WORD)]


def _nearest(at: np.ndarray, goal: int, low: int, high: int) -> int | None:
    """The element of the sorted ``at`` in [low, high] nearest to ``goal``, the lower of two."""
    a, b = np.searchsorted(at, [low, high + 1])
    if a >= b:
        return None
    i = int(np.searchsorted(at[a:b], goal)) + a
    near = [int(at[j]) for j in (i - 1, i) if a <= j < b]
    return min(near, key=lambda x: (abs(x - goal), x))


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int | None = None) -> list[int]:
    """Where the pieces of ``text`` (already without outer white space) end."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    if len(text) <= limit:
        return [len(text)]
    least = (limit - overlap) * 5 // 8 if least is None else least
    least = max(1, min(least, limit - overlap))
    marks, classes = landmarks(text), _boundaries(text)
    ends, at = [], 0
    while len(text) - at > limit - (overlap if ends else 0):
        low, high = at + least, at + limit - (overlap if ends else 0)
        high = min(high, len(text) - 1)
        goal = _nearest(marks, low, low, high)
        goal = high if goal is None else goal
        for at_class in classes:
            cut = _nearest(at_class, goal, low, high)
            if cut is not None:
                break
        else:
            cut = goal
        ends.append(cut)
        at = cut
    return [*ends, len(text)]


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of each piece of ``text`` without outer white space, in code points."""
    ends = cuts(text, limit, overlap)
    return [(0 if i == 0 else max(0, ends[i - 1] - overlap), end) for i, end in enumerate(ends)]


def split_texts(items: DataFrame, id_column: str, text_column: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every text: ``item_id, piece, pieces, start, piece_text``.

    Outer white space is removed; a text of at most ``limit`` code points is its only piece.  Each
    later piece starts exactly ``overlap`` code points before the end of the one before it (or at
    the text's start if that is nearer), so that ``piece_text`` without those restores the text.
    Cuts fall at paragraphs, else sentences, else words, else between characters.  ``start`` is the
    offset in the text without outer white space.  Null, empty and blank texts give no rows;
    repeated rows repeat their pieces; other columns are not read.

    Only texts that may exceed the limit go to Python; the others pass through the JVM.
    """
    kind = items.schema[id_column].dataType
    schema = T.StructType(
        [
            T.StructField("item_id", kind),
            T.StructField("piece", T.IntegerType()),
            T.StructField("pieces", T.IntegerType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("piece_text", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for i, raw in enumerate(batch.column(1)):
                text = raw.as_py().strip()
                if not text:
                    continue
                found = pieces(text, limit, overlap)
                for k, (a, b) in enumerate(found):
                    for column, value in zip(rows, (i, k, len(found), a, text[a:b])):
                        column.append(value)
            columns = [batch.column(0).take(pa.array(rows[0], pa.int64())), *(pa.array(c, pa.int32()) for c in rows[1:4]), pa.array(rows[4], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    given = items.select(F.col(id_column).alias("item_id"), F.col(text_column).alias("t")).filter("t is not null")
    long = F.char_length("t") > limit
    # what str.strip removes
    blank = "[\\s\\p{Z}\\x{1c}-\\x{1f}\\x{85}]+"
    short = given.filter(~long).withColumn("t", F.regexp_replace("t", f"^{blank}|{blank}$", "")).filter("t <> ''")
    short = short.select("item_id", F.lit(0).alias("piece"), F.lit(1).alias("pieces"), F.lit(0).alias("start"), F.col("t").alias("piece_text"))
    return by_batch(given.filter(long), run, schema).unionByName(short)
