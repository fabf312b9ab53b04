"""The most similar vectors of every vector, by a permutation index (problem 7).

Index: every vector is represented by its nearest pivots in order of nearness, and posted in the
inverted files of the first few.  The pivots are a bounded sample of the vectors; every vector is
indexed.  A file that grows too long is split by the next pivots of its members, again and again if
need be, so that a vector meets a bounded number of others however many there are.

Search: every vector is a query.  It meets the members of its own files there, so a file's vectors
travel once for all queries on it.  Within a file all members are ranked by exact cosine, by matrix
products, or, if ``rerank`` is given, only the nearest by Spearman's footrule between their prefixes
of pivots; the best of a query's files are merged.  The vectors alike grow in number with the
collection, so that a fixed number of reranked ones would leave out more and more of them.

Equal vectors stand for one another: a batch sends one of them to the files, and the answer for it
is spread over all their ids at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions.batches import by_batch
from vellumine.operators.joins import split_join
from vellumine.session import as_table, cut_lineage

#: Pivots: vectors to the power of PIVOT_POWER, within these bounds; the upper one bounds what is broadcast.
PIVOT_POWER, LEAST_PIVOTS, MOST_PIVOTS = 0.75, 64, 4096
#: Length of the pivot prefix; files that each vector is posted in.
PREFIX, FILES = 16, 3
#: Members of a file that one task holds at a time (25 MB); a longer file is cut into tiles that meet in pairs.
TILE = 8192
#: Members from which on a file is split by further pivots, and the files each of its members goes to.
SPLIT, SPREAD = 8192, 2
#: Files that are split at most, as their names (at most 2 * PREFIX bytes each) are broadcast; where there
#: would be more, files may be longer.
MOST_SPLIT = 1 << 20


def usable(embedding: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors) of the lists of ``width`` finite values that aren't all zero."""
    size = np.diff(embedding.offsets.to_numpy())
    fits = (size == width) & ~embedding.is_null().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(fits)
    if not len(rows):
        return rows, np.zeros((0, width), dtype=np.float32)
    start = embedding.offsets.to_numpy()[rows]
    values = embedding.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    vectors = values[start[:, None] + np.arange(width)] if len(rows) * width != len(values) else values.reshape(-1, width)
    good = np.isfinite(vectors).all(axis=1) & (vectors != 0).any(axis=1)
    return rows[good], vectors[good]


def pack_vector(v: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    """A float32 vector without loss: in half precision where that is exact, bytes by plane."""
    with np.errstate(over="ignore"):
        half = v.astype(np.float16)
    exact = np.array_equal(half.astype(np.float32), v)
    raw = (half if exact else v).view(np.uint8).reshape(len(v), -1)
    return (b"\x02" if exact else b"\x04") + press.compress(np.ascontiguousarray(raw.T).tobytes())


def unpack_vector(b: bytes, expand: zstandard.ZstdDecompressor) -> np.ndarray:
    raw = np.frombuffer(expand.decompress(b[1:]), dtype=np.uint8).reshape(b[0], -1)
    return np.ascontiguousarray(raw.T).view(np.float16 if b[0] == 2 else np.float32).ravel().astype(np.float32)


def unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def _key(v: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest((v + np.float32(0)).tobytes())  # -0 and 0 alike


def _pivots(vectors: DataFrame, width: int, most: int) -> np.ndarray:
    """The pivots: usable vectors of the least id hashes, distinct, at most ``most``."""
    n = vectors.count()
    wanted = int(min(most, max(LEAST_PIVOTS, n**PIVOT_POWER)))
    share = min(1.0, 1.5 * wanted / max(n, 1))
    h = F.xxhash64("id")
    near = vectors.filter(h < F.lit(int(-(2**63) + share * (2**64 - 1)))) if share < 1 else vectors
    rows = near.filter(F.size("embedding") == width).select("id", "embedding", h.alias("h")).orderBy("h", "id").limit(2 * wanted).toArrow()
    found, seen = [], set()
    _, usable_rows = usable(rows["embedding"].combine_chunks().cast(pa.list_(pa.float32())) if rows.num_rows else pa.array([], pa.list_(pa.float32())), width)
    for v in usable_rows:
        if (k := _key(v)) not in seen:
            seen.add(k)
            found.append(v)
    # half precision: only their order matters, and they are sent to every worker
    return unit(np.array(found[:wanted])).astype(np.float16) if found else np.zeros((0, width), dtype=np.float16)


def footrule(ranks: np.ndarray, prefix: int) -> np.ndarray:
    """Footrule distances between prefix permutations, rows of (members, prefix) pivot numbers.

    A pivot outside a prefix counts as placed right after it.  With weight w = prefix - place, the
    distance is the sum of both weights less twice the sum over shared pivots of the lesser one, so
    only the pairs that share a pivot are visited, pivot by pivot.
    """
    n = len(ranks)
    shared = np.zeros((n, n), dtype=np.int16)
    flat = ranks.ravel()
    order = np.argsort(flat, kind="stable")
    member, weight = (order // ranks.shape[1]), (prefix - order % ranks.shape[1]).astype(np.int16)
    ends = np.append(np.flatnonzero(np.diff(flat[order])) + 1, len(flat))
    at = 0
    for end in ends.tolist():
        if end - at > 1:
            m, w = member[at:end], weight[at:end]
            shared[np.ix_(m, m)] += np.minimum.outer(w, w)
        at = end
    shared *= -2
    shared += np.int16(prefix * (prefix + 1))
    return shared


def _best(ids: np.ndarray, vectors: np.ndarray, ranks: np.ndarray, sides: np.ndarray | None, k: int, rerank: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, neighbours, similarities) of a file: up to ``k`` for each member."""
    n = len(ids)
    far = footrule(ranks, ranks.shape[1]) if rerank and n - 1 > rerank else None
    for at in range(0, n, 512):
        rows = np.arange(at, min(at + 512, n))
        if far is None:
            sims = vectors[rows] @ vectors.T
        else:
            f = far[rows].copy()
            f[np.arange(len(rows)), rows] = np.iinfo(np.int16).max
            if sides is not None:
                f[sides[rows][:, None] == sides[None, :]] = np.iinfo(np.int16).max - 1
            # all that are as near as the last of the nearest are reranked too
            last = np.partition(f, rerank - 1, axis=1)[:, rerank - 1 : rerank]
            sims = np.full(f.shape, -2.0, dtype=np.float32)
            q, c = np.nonzero(f <= last)
            for s in range(0, len(q), 1 << 15):
                a, b = q[s : s + (1 << 15)], c[s : s + (1 << 15)]
                sims[a, b] = np.einsum("ij,ij->i", vectors[rows[a]], vectors[b])
        sims[np.arange(len(rows)), rows] = -2
        if sides is not None:
            sims[sides[rows][:, None] == sides[None, :]] = -2
        # all that may tie with the k-th go on: its similarity and theirs are wrong by width * 2^-24 at most
        # (unit vectors, any order of addition), and rounding makes 1e-7 equal
        last = np.partition(sims, n - k, axis=1)[:, n - k : n - k + 1] if k < n else np.float32(-2)
        q, c = np.nonzero((sims > -1.5) & (sims >= last - np.float32(2.1 * vectors.shape[1] * 2.0**-24 + 2e-7)))
        q = q + at
        exact = np.empty(len(q))
        for s in range(0, len(q), 1 << 12):
            x, y = q[s : s + (1 << 12)], c[s : s + (1 << 12)]
            exact[s : s + (1 << 12)] = np.round(np.einsum("ij,ij->i", vectors[x].astype(np.float64), vectors[y].astype(np.float64)), 7)
        order = np.lexsort((ids[c], -exact, q))
        q, c, exact = q[order], c[order], exact[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < k
        yield ids[q[keep]], ids[c[keep]], exact[keep]


def files_of(ranks: np.ndarray, files: int, split: frozenset[bytes] | set[bytes]) -> list[bytes]:
    """The files of a vector whose pivots, nearest first, are ``ranks`` (int16): those named by each of
    the first ``files``; one that is split gives way to those with one of the next SPREAD pivots more.
    A name is the sorted numbers of its pivots."""
    out: dict[bytes, None] = {}
    todo = [(int(p),) for p in ranks[:files]][::-1]
    while todo:
        held = todo.pop()
        name = np.array(sorted(held), dtype=np.int16).tobytes()
        further = [int(p) for p in ranks if p not in held][:SPREAD] if name in split else []
        if further:
            todo += [(*held, p) for p in further[::-1]]
        else:
            out[name] = None
    return list(out)


def _split_files(index: DataFrame, files: int, most: int) -> frozenset[bytes]:
    """The names of the files that are too long, level by level."""
    split: set[bytes] = set()
    most = max(most, files * index.count() // MOST_SPLIT)
    while True:
        now = frozenset(split)

        def run(batches: Iterator[pa.RecordBatch], now: frozenset = now) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = [f for r in batch.column(0).to_pylist() for f in files_of(np.frombuffer(r, dtype=np.int16), files, now)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary())], names=["file"])

        long = by_batch(index.select("ranks"), run, "file binary").groupBy("file").count().filter(F.col("count") > most)
        # a file with all pivots of the prefixes can't be split further; the others are at most MOST_SPLIT a level
        found = {bytes(x) for x in long.toArrow()["file"].to_pylist()} - split
        if not found:
            return now
        split |= found


def nearest(vectors: DataFrame, k: int = 5, width: int = 768, files: int = FILES, prefix: int = PREFIX, most_pivots: int = MOST_PIVOTS, rerank: int | None = None, tile: int = TILE, split: int = SPLIT) -> DataFrame:
    """``id, neighbour, similarity, rank``: for every usable vector its ``k`` most similar others.

    ``vectors`` has ``id`` (long) and ``embedding`` (list of float).  Vectors that are null, not
    ``width`` wide, all zero, or hold a null, NaN or infinite value take no part.  Repeated rows
    count once.  Equal similarity (to seven decimals) goes to the smaller id; equal vectors have
    similarity 1.  Other columns are not read.  The answer is approximate in that a neighbour is
    found only if it shares one of the first ``files`` pivots, and further ones in files that are
    split, and with ``rerank`` only if it is among so many nearest by footrule; similarities are exact.  With ``most_pivots=1`` all vectors are in one file, whose tiles
    meet in pairs: the exact answer, by a number of comparisons that grows with the square of the
    number of vectors.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("id", F.col("embedding").cast("array<float>").alias("embedding")).filter("id is not null and embedding is not null")
    pivots = _pivots(vectors, width, most_pivots)
    if not len(pivots):
        return spark.createDataFrame([], "id long, neighbour long, similarity double, rank int")
    shared = spark.sparkContext.broadcast(pivots)
    depth = min(prefix, len(pivots))
    files = min(files, depth)

    def represent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1, write_content_size=True)
        given = shared.value.astype(np.float32)
        for batch in batches:
            rows, found = usable(batch.column(1), width)
            ids = batch.column(0).to_numpy()[rows]
            first = {}
            keys = [_key(v) for v in found]
            for i in np.argsort(ids, kind="stable").tolist():
                first.setdefault(keys[i], i)
            heads = np.array(sorted(first.values()), dtype=np.int64)
            for at in range(0, len(heads), 1024):
                part = heads[at : at + 1024]
                sims = unit(found[part]).astype(np.float32) @ given.T
                near = np.argpartition(-sims, depth - 1, axis=1)[:, :depth] if depth < len(given) else np.broadcast_to(np.arange(depth), (len(part), depth))
                own = np.take_along_axis(sims, near, axis=1)
                near = np.take_along_axis(near, np.argsort(-own, axis=1, kind="stable"), axis=1).astype(np.int16)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[part]),
                        pa.array([keys[i] for i in part.tolist()], pa.binary()),
                        pa.array([pack_vector(found[i] + np.float32(0), press) for i in part.tolist()], pa.binary()),  # -0 is 0
                        pa.array([x.tobytes() for x in near], pa.binary()),
                    ],
                    names=["id", "key", "vector", "ranks"],
                )

    index = as_table(by_batch(vectors, represent, "id long, key binary, vector binary, ranks binary"), "permutation-index")
    long = spark.sparkContext.broadcast(_split_files(index, files, split))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = long.value
        for batch in batches:
            names = [files_of(np.frombuffer(r, dtype=np.int16), files, given) for r in batch.column(batch.schema.get_field_index("ranks")).to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(names)), [len(f) for f in names]))
            yield pa.RecordBatch.from_arrays([pa.array([f for n in names for f in n], pa.binary()), *(c.take(rows) for c in batch.columns)], names=["file", *batch.schema.names])

    def posted(*columns: str) -> DataFrame:
        kinds = {"id": "long"}
        return by_batch(index.select(*columns), post, "file binary, " + ", ".join(f"{c} {kinds.get(c, 'binary')}" for c in columns))

    # the lengths of the files that take several tiles
    lengths = posted("ranks").groupBy("file").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")).filter("tiles > 1")
    lengths = cut_lineage(lengths)
    lengths = F.broadcast(lengths) if lengths.count() <= MOST_SPLIT else lengths
    posts = posted("id", "key", "vector", "ranks")
    posts = posts.join(lengths, "file", "left").withColumn("tile", F.when(F.col("tiles") > 1, F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int")).otherwise(F.lit(0)))
    others = F.when(F.col("tiles") > 1, F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(F.lit(0)))
    posts = posts.withColumn("other", F.explode(others))
    posts = posts.select("file", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "id", "vector", "ranks")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, rows in _cells(batches):
            by_key: dict[bytes, int] = {}
            for i in sorted(range(len(rows)), key=lambda i: rows[i][1]):
                by_key.setdefault(rows[i][2], i)  # equal vectors are packed alike
            members = [rows[i] for i in by_key.values()]
            if len(members) < 2:
                continue
            expand = zstandard.ZstdDecompressor()
            ids = np.array([m[1] for m in members], dtype=np.int64)
            held = unit(np.array([unpack_vector(m[2], expand) for m in members])).astype(np.float32)
            ranks = np.array([np.frombuffer(m[3], dtype=np.int16) for m in members])
            sides = np.array([m[0] for m in members]) if cell[1] != cell[2] else None
            for q, c, s in _best(ids, held, ranks, sides, k, rerank):
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(c), pa.array(s)], names=["q", "c", "s"])

    found = by_batch(posts.repartition("file", "a", "b").sortWithinPartitions("file", "a", "b"), search, "q long, c long, s double").distinct()
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.col("s").desc(), "c"))).filter(F.col("r") <= k).drop("r")
    return _spread(vectors, found, width, k)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows of equal (file, a, b), which are sorted so."""
    now, rows = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for file, a, b, *rest in zip(*columns):
            if (file, a, b) != now:
                if rows:
                    yield now, rows
                now, rows = (file, a, b), []
            rows.append(tuple(rest))
    if rows:
        yield now, rows


def _spread(vectors: DataFrame, found: DataFrame, width: int, k: int) -> DataFrame:
    """Answers between heads of equal vectors, spread over all ids that have those vectors."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = usable(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([_key(v) for v in held], pa.binary())], names=["id", "key"])

    # read several times below: the vectors are keyed once
    ids = cut_lineage(by_batch(vectors, keyed, "id long, key binary").distinct())
    heads = ids.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("n")).filter("n > 1")
    # the few least ids of a class can be anyone's neighbours; the limit is applied before the shuffle
    few = ids.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).filter(F.col("r") <= k + 1)
    few = few.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("few"))
    classes = heads.join(few, "key")
    few = classes.select(F.col("head").alias("c"), "few")
    # a class of more than k has its neighbours within; a smaller one is wholly in its few
    small = classes.filter(F.col("n") <= k).select(F.col("head").alias("q"), "few")

    other = found.join(few, "c", "left").withColumn("c", F.explode(F.coalesce("few", F.array("c")))).drop("few")
    other = other.join(small, "q", "left").withColumn("q", F.explode(F.coalesce("few", F.array("q")))).drop("few")
    own = split_join(ids, classes.select("key", "few"), ["key"]).filter("few is not null")
    own = own.select(F.col("id").alias("q"), F.explode("few").alias("c"), F.lit(1.0).alias("s")).filter("q <> c")
    ranked = other.unionByName(own).withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.col("s").desc(), "c")))
    return ranked.filter(F.col("rank") <= k).select(F.col("q").alias("id"), F.col("c").alias("neighbour"), F.col("s").alias("similarity"), "rank")
