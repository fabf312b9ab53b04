"""Filling fixed-capacity containers with texts by harmonic packing (problem 8).

A text's size is its number of tokens.  Sizes are cut into classes by the reciprocals of the
capacity: class ``k`` holds sizes in (C/(k+1), C/k], and each of its containers takes exactly ``k``
texts.  Texts of at most C/M form the last class.  Every worker packs its own block of texts and
needs to know nothing of the others.

Containers of a class stand to lose up to C/(k+1) each.  So within a block the classes come in
descending order of size, and the texts of a class first go into the gaps that the containers of
the classes before it leave, largest text into the tightest gap it fits; the rest opens containers
of its own, of k texts each.  What is left of the last class is packed by next fit on descending
sizes.  Texts over the capacity are cut into full containers and a remainder that is packed.
"""

from __future__ import annotations

import base64
import bisect
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.functions.batches import by_batch, ship_package
from vellumine.session import as_table

CAPACITY = 2048
#: Sizes of at most capacity / SMALL form the last class.
SMALL = 16
#: Texts in a block on average; a block is one group of at most a few times this many small rows.
BLOCK = 1 << 16


#: How the byte-level BPE of 2019 cuts a text before merging (its published pattern).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _encoder(path: str, pattern: str):  # noqa: ANN202
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, id_column: str, text_column: str, ranks_path: str, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, tokens`` by the byte-level BPE whose ranks file lies at ``ranks_path`` on the driver;
    the workers get it through Spark's file server.  Null and empty texts have 0 tokens; strings of
    special tokens are ordinary text."""
    kind = documents.schema[id_column].dataType.simpleString()
    context = documents.sparkSession.sparkContext
    name = os.path.basename(ranks_path)
    if name not in {os.path.basename(f) for f in context.listFiles}:
        context.addFile(ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(SparkFiles.get(name), pattern).encode_ordinary
        for batch in batches:
            sizes = [0 if not t else len(encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "tokens"])

    return by_batch(documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("t")), run, f"doc_id {kind}, tokens long")


def pack_block(sizes: np.ndarray, capacity: int, small: int = SMALL) -> tuple[np.ndarray, int]:
    """(container of each item, number of containers) for sizes of 1 to ``capacity``."""
    where = np.full(len(sizes), -1, dtype=np.int64)
    classes = np.minimum(capacity // np.maximum(sizes, 1), small)
    opened, room = 0, np.zeros(0, dtype=np.int64)
    rest = np.zeros(0, dtype=np.int64)
    for k in range(1, small + 1):
        items = np.flatnonzero(classes == k)
        items = items[np.argsort(-sizes[items], kind="stable")]
        if len(room) and len(items):
            items, room = _fill(sizes, items, room, where)
        if k == small:
            rest = items
        elif len(items):
            # one of each stretch of sizes to a container, which evens their gaps out
            n = -(-len(items) // k)
            box = np.arange(len(items)) % n
            where[items] = opened + box
            room = np.concatenate((room, capacity - np.bincount(box, weights=sizes[items], minlength=n).astype(np.int64)))
            opened += n
    free = 0
    for i in rest.tolist():
        if sizes[i] > free:
            opened, free = opened + 1, capacity
        where[i], free = opened - 1, free - int(sizes[i])
    return where, opened


def _fill(sizes: np.ndarray, items: np.ndarray, room: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Put ``items`` (descending) into the tightest gaps they fit; returns those left over and the
    room that is left in each container."""
    room = room.copy()
    gaps = sorted((int(r), b) for b, r in enumerate(room.tolist()) if r > 0)
    left = []
    for i in items.tolist():
        s = int(sizes[i])
        at = bisect.bisect_left(gaps, (s, -1))
        if at == len(gaps):
            left.append(i)
            continue
        r, b = gaps.pop(at)
        where[i], room[b] = b, r - s
        if r > s:
            bisect.insort(gaps, (r - s, b))
    return np.array(left, dtype=np.int64), room


def pack(sizes: DataFrame, capacity: int = CAPACITY, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """``doc_id, part, token_start, token_end, container``: every text's place.

    ``sizes`` has ``doc_id, tokens``.  A text within the capacity is one part; a larger one has a
    part for each full container and one for the remainder, if any.  Texts of null or no tokens
    need no place and don't appear.  Repeated rows of a text are distinct texts, each packed.
    ``container`` is "block-number", "block-full-..." for full containers of oversized texts.
    Blocks are drawn by hash, so one id or source can't fill a block; for equal input the
    assignment is always the same.
    """
    kind = sizes.schema["doc_id"].dataType.simpleString()
    ship_package(sizes.sparkSession)
    # counting the texts and packing them both read the sizes: they are written once
    sizes = as_table(sizes.filter("tokens > 0").select("doc_id", F.col("tokens").cast("long").alias("tokens")), "sizes")
    n = max(1, -(-sizes.count() // block))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("tokens", "ascending"), ("doc_id", "ascending")])
        number = table["block"][0].as_py()
        tokens = table["tokens"].to_numpy()
        full, tail = tokens // capacity, tokens % capacity
        cut = np.repeat(np.arange(len(tokens)), full)
        cut_part = np.arange(len(cut)) - np.repeat(np.cumsum(full) - full, full)
        packed = np.flatnonzero(tail > 0)
        box, _ = pack_block(tail[packed], capacity, small)
        row = np.concatenate((cut, packed))
        part = np.concatenate((cut_part, full[packed]))
        names = [f"{number}-full-{i}" for i in range(len(cut))] + [f"{number}-{b}" for b in box.tolist()]
        return pa.table(
            {
                "doc_id": table["doc_id"].take(pa.array(row)),
                "part": pa.array(part),
                "token_start": pa.array(part * capacity),
                "token_end": pa.array(np.minimum((part + 1) * capacity, tokens[row])),
                "container": pa.array(names, pa.string()),
            }
        )

    placed = sizes.withColumn("block", F.pmod(F.xxhash64("doc_id", "tokens"), F.lit(n)))
    return placed.groupBy("block").applyInArrow(run, f"doc_id {kind}, part long, token_start long, token_end long, container string")
