"""Near-duplicate records by fast similarity sketching, banding and an exact check (problem 6).

1. Every text becomes its set of hashed word sequences.  Records with equal sets form a class; only
   the class's least record goes on.
2. Each class is sketched, and the sketch cut into bands; classes that share a band, whose sizes
   allow the similarity and whose sketches agree in enough bins are candidates.  Two bits of each
   bin travel with a band, and only the pairs that agree leave its task: those that share a band by
   chance grow with the square of the collection.  Large collections take their bands in rounds.
3. Candidates are checked on their whole sets with integers.

In a band that many classes share (records of one template that differ by a word) nearly all may
agree.  The classes that agree with many others there form a family instead: its members are cut
into tiles, every two tiles meet once, and all their pairs are counted at once from the elements
they share.  The sets travel once a tile, not once a pair, and where only groups are asked for no
pair leaves its tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import reduce
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vellumine.functions.batches import by_batch
from vellumine.llm.components import components
from vellumine.llm.sketches import bands, sketch
from vellumine.llm.words import RUN, Hasher, sequence_hashes
from vellumine.operators.joins import split_join
from vellumine.session import as_table, cut_lineage, free_shuffles

#: 48 bands of 4 bins: a pair at similarity 0.7 is missed with probability 2e-6, at 0.8 with 1e-11.
BANDS, ROWS = 48, 4
#: Probability at most that a pair at the threshold agrees in fewer bins than asked for.
MISSED = 1e-7
#: Rows of bands that a round shuffles at about 80 bytes each; the bands of smaller collections take one round.
ROUND_ROWS = 1 << 23
#: Sets sketched at once (their bins take about 4 MB).
_AT_ONCE = 2048
#: Classes in a band from which on those with a quarter as many that agree with them are a family, members of
#: a tile, and elements of a tile (32 MB).
HOT, TILE, TILE_ELEMENTS = 256, 1024, 1 << 22
#: Rows of a class that one task expands into pairs.
_PAIR_ROWS = 1 << 12


def _sets(batch: pa.RecordBatch, words: int, hasher: Hasher) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct sequence hashes) of the rows that have any."""
    for i, (title, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
        whole = (f"{title}\n{text}" if title else text).lower()
        found = np.unique(sequence_hashes(hasher(RUN.findall(whole)), words))
        if len(found):
            yield i, found


def _texts(records: DataFrame, id_column: str, title_column: str | None, text_column: str) -> DataFrame:
    title = F.col(title_column) if title_column else F.lit(None).cast("string")
    return records.select(F.col(id_column).alias("id"), title.alias("title"), F.col(text_column).alias("t")).filter("id is not null and t <> ''")


def sketched(records: DataFrame, id_column: str, title_column: str | None, text_column: str, words: int) -> DataFrame:
    """``id, key, n, bands, marks``: a 128-bit key of the record's set, its size, its band hashes and two
    bits of each bin of its sketch, first those of all bins, then the others."""
    kind = records.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            found = list(_sets(batch, words, hasher))
            for at in range(0, len(found), _AT_ONCE):
                part = found[at : at + _AT_ONCE]
                sizes = np.array([len(s) for _, s in part], dtype=np.int64)
                bins = sketch(np.concatenate([s for _, s in part]), np.repeat(np.arange(len(part)), sizes), len(part), BANDS * ROWS)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([i for i, _ in part])),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for _, s in part], pa.binary()),
                        pa.array(sizes.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * BANDS), pa.array(bands(bins, ROWS).astype(np.int32).ravel())),
                        pa.array([x.tobytes() for x in np.concatenate([np.packbits((bins & np.uint64(bit)) != 0, axis=1) for bit in (1, 2)], axis=1)], pa.binary()),
                    ],
                    names=["id", "key", "n", "bands", "marks"],
                )

    return by_batch(_texts(records, id_column, title_column, text_column), run, f"id {kind}, key binary, n int, bands array<int>, marks binary")


def _sequences(records: DataFrame, id_column: str, title_column: str | None, text_column: str, words: int) -> DataFrame:
    """``id, seqs``: the whole sets of the given records."""
    kind = records.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            found = list(_sets(batch, words, hasher))
            sizes = np.array([0, *(len(s) for _, s in found)], dtype=np.int64)
            flat = np.concatenate([s for _, s in found]).view(np.int64) if found else np.zeros(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in found], pa.int64())), lists], names=["id", "seqs"])

    return by_batch(_texts(records, id_column, title_column, text_column), run, f"id {kind}, seqs array<long>")


class _Stages(NamedTuple):
    members: DataFrame  # id, class_id
    pairs: DataFrame  # class_a, class_b, shared, size_a, size_b: checked pairs outside of families
    cells: DataFrame | None  # family, a, b, tile, id, seqs: the tiles of families that meet


def _stages(records: DataFrame, id_column: str, title_column: str | None, text_column: str, words: int, threshold: Fraction, hot: int, tile: int, round_rows: int) -> _Stages:
    given = id_column, title_column, text_column, words
    marked = as_table(sketched(records, *given), "sketches")
    named = marked.groupBy("key").agg(F.min("id").alias("class_id"))
    # one row per class: the band hashes stay with the row of the least id
    heads = marked.join(named.select(F.col("class_id").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    heads = as_table(heads.select("id", "n", "bands", "marks"), "heads")
    members = cut_lineage(split_join(marked.select("id", "key").distinct(), named, ["key"]).select("id", "class_id"))

    least = int(threshold.numerator), int(threshold.denominator)
    per = max(1, min(BANDS, round_rows // max(1, heads.count())))
    rounds = []
    for at in range(0, BANDS, per):
        rounds.append(as_table(_met(heads, at, per, threshold, hot), "candidates"))
        if per < BANDS:
            free_shuffles(records.sparkSession)
    met = reduce(DataFrame.unionByName, rounds)
    families = _families(met.filter("tied").select("x", "y"), heads)
    pairs = met.filter("not tied").select(F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b")).distinct()
    if families is not None:
        for end in ("class_a", "class_b"):
            pairs = pairs.join(families.select(F.col("id").alias(end), F.col("family").alias(f"{end}_family")), end, "left")
        pairs = pairs.filter(~F.coalesce(F.col("class_a_family") == F.col("class_b_family"), F.lit(False))).select("class_a", "class_b")
    pairs = cut_lineage(pairs)

    wanted = pairs.select(F.explode(F.array("class_a", "class_b")).alias("id"))
    wanted = wanted if families is None else wanted.unionByName(families.select("id"))
    source = records.join(wanted.distinct().withColumnRenamed("id", id_column), id_column, "left_semi")
    sets = _sequences(source, *given).dropDuplicates(["id"])
    sets = sets if families is None else cut_lineage(sets)
    left, right = sets.select(F.col("id").alias("class_a"), F.col("seqs").alias("_a")), sets.select(F.col("id").alias("class_b"), F.col("seqs").alias("_b"))
    both = pairs.join(left, "class_a").join(right, "class_b")
    sized = both.select("class_a", "class_b", F.size(F.array_intersect("_a", "_b")).cast("long").alias("shared"), F.size("_a").cast("long").alias("size_a"), F.size("_b").cast("long").alias("size_b"))
    checked = cut_lineage(sized.filter(F.col("shared") * least[1] >= (F.col("size_a") + F.col("size_b") - F.col("shared")) * least[0]))
    return _Stages(members, checked, None if families is None else _cells(families, sets, tile))


def least_agreeing(threshold: Fraction, missed: float = MISSED) -> int:
    """The most bins of a sketch, by two bits of each, in which a pair at the threshold fails to agree with
    a probability of at most ``missed``; bins that differ agree in their bits in a quarter of cases."""
    bins, p = BANDS * ROWS, float(threshold) + (1 - float(threshold)) / 4
    fewer = k = 0
    while k < bins and (fewer := fewer + comb(bins, k) * p**k * (1 - p) ** (bins - k)) <= missed:
        k += 1
    return k


def _met(heads: DataFrame, at: int, bands_: int, threshold: Fraction, hot: int) -> DataFrame:
    """``x, y, tied``: the classes that share one of ``bands_`` bands from ``at`` on and agree there; if
    ``tied``, x is in a family with y, and y's links to others of its family are left out."""
    kind, arrow = heads.schema["id"].dataType.simpleString(), to_arrow_type(heads.schema["id"].dataType)
    up, down, apart = int(threshold.numerator), int(threshold.denominator), BANDS * ROWS - least_agreeing(threshold)
    dense = max(1, hot // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_bands(batches):
            band, sizes = table["band"].to_numpy(), table["n"].to_numpy().astype(np.int64)
            marks = np.frombuffer(b"".join(table["marks"].to_pylist()), dtype=np.uint64).reshape(len(band), -1).T.copy()
            half = len(marks) // 2

            def agree(x: np.ndarray | int, y: np.ndarray, sizes: np.ndarray = sizes, marks: np.ndarray = marks, half: int = half) -> np.ndarray:
                unlike = sum(np.bitwise_count((marks[k][x] ^ marks[k][y]) | (marks[half + k][x] ^ marks[half + k][y])) for k in range(half))
                return (unlike <= apart) & (sizes[x] * down >= sizes[y] * up) & (sizes[y] * down >= sizes[x] * up)

            for x, y, tied in _agreeing(band, agree, hot, dense):
                if len(x):
                    ids = table["id"].combine_chunks()
                    columns = [ids.take(pa.array(i)).cast(arrow) for i in (x, y)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(x), tied))], names=["x", "y", "tied"])

    posts = heads.select("id", "n", "marks", F.posexplode(F.slice("bands", at + 1, bands_)).alias("place", "band"))
    posts = posts.select((F.shiftleft(F.col("place").cast("long"), 32) + F.col("band")).alias("band"), "id", "n", "marks")
    return by_batch(posts.repartition("band").sortWithinPartitions("band"), run, f"x {kind}, y {kind}, tied boolean").distinct()


def _whole_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches, sorted by their first column, put together so that its equal values aren't parted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        band = batch.column(0).to_numpy()
        first = int(np.searchsorted(band, band[-1]))
        if held and (first or held[-1].column(0)[0].as_py() != band[-1]):
            yield pa.Table.from_batches([*held, batch.slice(0, first)])
            held = []
        elif first:
            yield pa.Table.from_batches([batch.slice(0, first)])
        held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held)


def _agreeing(band: np.ndarray, agree: Callable[..., np.ndarray], hot: int, dense: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, rows, tied) of equal ``band`` (sorted) that agree: all pairs of runs up to ``hot``; in longer
    ones rows with ``dense`` others that agree are tied to them, and those that a chain of ties connects
    aren't compared with each other."""
    first = np.flatnonzero(np.append(True, band[1:] != band[:-1]))
    held = np.diff(np.append(first, len(band)))
    after = np.repeat(first + held, held) - np.arange(len(band))  # rows of the run from this one on
    rows, step = np.flatnonzero((after > 1) & (np.repeat(held, held) <= hot)), 1
    while len(rows):
        found = rows[agree(rows, rows + step)]
        yield found, found + step, False
        step += 1
        rows = rows[after[rows] > step]
    for start, size in zip(first[held > hot].tolist(), held[held > hot].tolist()):
        rest, todo = np.arange(start, start + size), []
        while len(rest):
            if todo:
                i = todo.pop()
            else:
                i, rest = int(rest[0]), rest[1:]
            like = agree(i, rest)
            found = rest[like]
            tied = len(found) >= dense
            yield found, np.full(len(found), i), tied
            if tied:
                todo += found.tolist()
                rest = rest[~like]


def _families(ties: DataFrame, heads: DataFrame) -> DataFrame | None:
    """``id, family, n``: what ties connect, named by its least class; None if there are none."""
    if ties.isEmpty():
        return None
    families = components(ties, "x", "y").select(F.col("node").alias("id"), F.col("component").alias("family"))
    return cut_lineage(families.join(heads.select("id", "n"), "id"))


def _cells(families: DataFrame, sets: DataFrame, tile: int) -> DataFrame:
    """``family, a, b, tile, id, seqs``: every member in each pair of tiles that its own is in."""
    tiles = families.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("n") / TILE_ELEMENTS)).cast("int").alias("tiles"))
    placed = split_join(families.select("id", "family"), tiles, ["family"]).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    placed = placed.join(sets, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return placed.select("family", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "id", "seqs")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """The matrix of how many elements each two of the sets share.

    Elements of many sets are counted by matrix products, those of a few by their pairs.
    """
    n = len(sets)
    out = np.zeros((n, n), dtype=np.int32)
    flat = np.concatenate([np.zeros(0, dtype=np.int64), *sets])
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, dtype=np.int64)
    held = np.diff(np.append(first, len(flat)))
    for size in range(2, _FEW + 1):
        runs = first[held == size]
        i, j = np.triu_indices(size, 1)
        step = max(1, (1 << 20) // len(i))
        for at in range(0, len(runs), step):
            who = owner[runs[at : at + step, None] + np.arange(size)]
            np.add.at(out, (who[:, i].ravel(), who[:, j].ravel()), 1)
    runs, sizes = first[held > _FEW], held[held > _FEW]
    for at in range(0, len(runs), 2048):
        part, size = runs[at : at + 2048], sizes[at : at + 2048]
        x = np.zeros((n, len(part)), dtype=np.float32)
        column = np.repeat(np.arange(len(part)), size)
        x[owner[np.repeat(part - (np.cumsum(size) - size), size) + np.arange(size.sum())], column] = 1
        out += np.triu(x @ x.T, 1).astype(np.int32)
    return out + out.T


#: Elements that so many sets share at most are counted by pairs.
_FEW = 12


def _family_pairs(cells: DataFrame, threshold: Fraction, grouped: bool) -> DataFrame:
    """The links within families: each as a row, or, if ``grouped``, ``id, links, tied``: how many
    links a class has in a cell, and the least class there that they connect it with."""
    kind, arrow = cells.schema["id"].dataType.simpleString(), to_arrow_type(cells.schema["id"].dataType)
    up, down = int(threshold.numerator), int(threshold.denominator)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, a, b), tile, ids, sets in _runs(batches):
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            shared = shared_counts(sets).astype(np.int64)
            linked = shared * down >= (sizes[:, None] + sizes[None, :] - shared) * up
            np.fill_diagonal(linked, False)
            if a != b:
                linked &= tile[:, None] != tile[None, :]
            if grouped:
                least = _least_connected(linked)
                some = np.flatnonzero(linked.any(axis=1))
                columns = [pa.array([ids[i] for i in some], arrow), pa.array(linked.sum(axis=1)[some]), pa.array([ids[i] for i in least[some]], arrow)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "links", "tied"])
                continue
            for at in range(0, len(ids), 256):
                x, y = np.nonzero(linked[at : at + 256])
                x = x + at
                x, y = x[x < y], y[x < y]
                columns = [pa.array([ids[i] for i in x], arrow), pa.array([ids[i] for i in y], arrow), *map(pa.array, (shared[x, y], sizes[x], sizes[y]))]
                yield pa.RecordBatch.from_arrays(columns, names=["class_a", "class_b", "shared", "size_a", "size_b"])

    spread = cells.repartition("family", "a", "b").sortWithinPartitions("family", "a", "b", "id")
    if grouped:
        return by_batch(spread, run, f"id {kind}, links long, tied {kind}")
    return by_batch(spread, run, f"class_a {kind}, class_b {kind}, shared long, size_a long, size_b long")


def _least_connected(linked: np.ndarray) -> np.ndarray:
    """The least row that each row of a symmetric matrix is connected with."""
    least = np.arange(len(linked))
    while len(linked):
        near = np.where(linked, least[None, :], len(linked)).min(axis=1)
        now = np.minimum(least, near)
        now = now[now]
        if (now == least).all():
            break
        least = now
    return least


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, list, list[np.ndarray]]]:
    """Runs of rows of equal (family, a, b), which are sorted so."""
    now, tile, ids, sets = None, [], [], []
    for batch in batches:
        flat, ends = batch.column(5).values.to_numpy(), batch.column(5).offsets.to_numpy()
        for i, (family, a, b, t, own) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(5)))):
            if (family, a, b) != now:
                if ids:
                    yield now, np.array(tile), ids, sets
                now, tile, ids, sets = (family, a, b), [], [], []
            tile.append(t)
            ids.append(own)
            sets.append(flat[ends[i] : ends[i + 1]])
    if ids:
        yield now, np.array(tile), ids, sets


def near_duplicates(
    records: DataFrame,
    id_column: str = "id",
    title_column: str | None = "extracted_title",
    text_column: str = "extracted_text",
    words: int = 5,
    threshold: Fraction = Fraction(4, 5),
    hot: int = HOT,
    tile: int = TILE,
    round_rows: int = ROUND_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Classes and links: ``(members, links)``.

    ``members`` has ``id, class_id``: the records whose sets of ``words``-word sequences are equal,
    named by the least of their ids.  ``links`` has ``class_a < class_b, shared, size_a, size_b``:
    classes whose sets have a Jaccard similarity of at least ``threshold``.  Words are runs of
    letters and digits of the lower-case title (if any), a line break, and the text.  Records with
    a null id, a null or empty text, or fewer than ``words`` words have no set and don't appear.
    Repeated rows count once.  Other columns are not read.
    """
    stages = _stages(records, id_column, title_column, text_column, words, threshold, hot, tile, round_rows)
    links = stages.pairs
    return stages.members, links if stages.cells is None else links.unionByName(_family_pairs(stages.cells, threshold, False))


def near_duplicate_groups(
    records: DataFrame,
    id_column: str = "id",
    title_column: str | None = "extracted_title",
    text_column: str = "extracted_text",
    words: int = 5,
    threshold: Fraction = Fraction(4, 5),
    hot: int = HOT,
    tile: int = TILE,
    round_rows: int = ROUND_ROWS,
) -> DataFrame:
    """One row per record with a set: ``id, class_id, links`` (of its class to other classes) and
    ``group_id``, the least record of all that links connect.  As :func:`near_duplicates`, but no
    pair of a family leaves its tile."""
    stages = _stages(records, id_column, title_column, text_column, words, threshold, hot, tile, round_rows)
    pairs = stages.pairs.select("class_a", "class_b")
    ends = F.explode(F.array(F.struct(F.col("class_a").alias("class_id"), F.col("class_b").alias("tied")), F.struct(F.col("class_b").alias("class_id"), F.col("class_a").alias("tied"))))
    known = pairs.select(ends.alias("e")).select("e.class_id", F.lit(1).cast("long").alias("links"), "e.tied")
    if stages.cells is not None:
        known = known.unionByName(_family_pairs(stages.cells, threshold, True).withColumnRenamed("id", "class_id"))
    known = cut_lineage(known)
    counts = known.groupBy("class_id").agg(F.sum("links").alias("links"))
    groups = components(known, "class_id", "tied").select(F.col("node").alias("class_id"), F.col("component").alias("group_id"))
    out = split_join(stages.members, counts.join(groups, "class_id"), ["class_id"])
    return out.select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group_id", "class_id").alias("group_id"))


def duplicate_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Every pair of records (``id_a < id_b``) within a class or across a link; large classes are
    expanded tile by tile."""
    tiles = members.groupBy("class_id").agg(F.count("*").alias("rows")).filter("rows > 1")
    tiles = cut_lineage(tiles.select("class_id", F.ceil(F.col("rows") / _PAIR_ROWS).cast("int").alias("tiles")))
    placed = split_join(members, tiles, ["class_id"]).withColumn("tiles", F.coalesce("tiles", F.lit(0)))
    placed = placed.withColumn("tile", F.when(F.col("tiles") > 1, F.pmod(F.xxhash64("id"), F.col("tiles"))).otherwise(0).cast("int"))
    several = placed.filter("tiles > 0").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    several = several.select("class_id", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "id")
    one, two = several.alias("one"), several.alias("two")
    meet = (F.col("one.class_id") == F.col("two.class_id")) & (F.col("one.a") == F.col("two.a")) & (F.col("one.b") == F.col("two.b")) & (F.col("one.id") < F.col("two.id"))
    within = one.join(two, meet & ((F.col("one.a") == F.col("one.b")) | (F.col("one.tile") != F.col("two.tile")))).select(F.col("one.id").alias("x"), F.col("two.id").alias("y"))

    # a class may have any number of links: its ids come tile by tile, and the links to them are split
    lists = placed.groupBy("class_id", "tile").agg(F.collect_list("id").alias("ids"))
    lists = cut_lineage(lists)
    fan = tiles.filter("tiles > 1").select("class_id", F.col("tiles").alias("fan"))
    large = not fan.isEmpty()
    across = links.select("class_a", "class_b")
    for end, name in (("class_a", "x"), ("class_b", "y")):
        fanned = across.withColumn("tile", F.lit(0))
        if large:
            fanned = split_join(across, fan.withColumnRenamed("class_id", end), [end])
            fanned = fanned.withColumn("tile", F.explode(F.sequence(F.lit(0), F.coalesce("fan", F.lit(1)) - 1))).drop("fan")
        held = lists.select(F.col("class_id").alias(end), F.col("tile").cast("int").alias("tile"), "ids")
        across = split_join(fanned, held, [end, "tile"]).withColumn(name, F.explode("ids")).drop("ids", "tile")
        across = cut_lineage(across) if name == "x" else across
    return within.unionByName(across.select("x", "y")).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
