"""Evaluation passages in training text, by a distributed positional inverted index (problem 9).

Index: a segment is what one batch of documents makes.  It has one row for each of its terms, with
the number of its postings and the postings themselves (documents and positions), sorted by term.
Building needs no shuffle, no term's list is ever in one place, how frequent terms are is read from
the numbers alone, and a lookup opens only the lists it asks for.

Search: a test item's windows of ``k`` words are answered from their rarest terms, the anchors.
Every posting of an anchor is adjusted by its offset in the item.  Where a document has consecutive
anchors of an item at one shift, the words from behind the last anchor missed to before the next one
may be shared; if those are ``k`` or more the shift is a candidate.  A word that the corpus lacks is
an anchor that is always missed.  Candidates are checked word by word, at their shifts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions.batches import by_batch, ship_package
from vellumine.llm.words import Hasher, normal_words
from vellumine.session import as_table, cut_lineage

WORDS = 12
PROBES = 3
#: Anchors, or terms, of test items that are broadcast at most.
MOST_BROADCAST = 1 << 20
#: Postings of a term that one task looks up where anchors aren't broadcast.
HOT_POSTINGS = 1 << 22


def _terms(texts: pa.Array, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, row, position) of every word of the texts, in order."""
    found = [hasher(normal_words(text)) for text in texts.to_pylist()]
    sizes = np.array([len(x) for x in found], dtype=np.int64)
    terms = np.concatenate([np.zeros(0, dtype=np.int64), *found])
    return terms, np.repeat(np.arange(len(sizes)), sizes), np.arange(len(terms)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _named(rows: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return rows.select(F.col(id_column).alias("id"), F.col(text_column).alias("t")).filter("t is not null and id is not null")


def build_index(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The positional index of ``documents``, written once to the shared checkpoint folder: ``term, n,
    docs, pos`` for each term of each segment.  Terms are 64-bit hashes of normalised words.  Null
    texts and rows with a null id have no postings."""
    kind = documents.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            terms, owner, pos = _terms(batch.column(1), hasher)
            order = np.argsort(terms, kind="stable")
            terms = terms[order]
            first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, dtype=np.int64)
            ends = pa.array(np.append(first, len(terms)).astype(np.int32))
            docs = pa.ListArray.from_arrays(ends, batch.column(0).take(pa.array(owner[order])))
            places = pa.ListArray.from_arrays(ends, pa.array(pos[order].astype(np.int32)))
            counts = np.diff(np.append(first, len(terms))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(terms[first]), pa.array(counts), docs, places], names=["term", "n", "docs", "pos"])

    index = by_batch(_named(documents, id_column, text_column), run, f"term long, n int, docs array<{kind}>, pos array<int>")
    return as_table(index, "positional-index")


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term, ipos`` for every word of every item, repeated items once."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            terms, owner, pos = _terms(batch.column(1), hasher)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(terms), pa.array(pos.astype(np.int32))], names=["item_id", "term", "ipos"])

    return by_batch(_named(items, "item_id", "text"), run, f"item_id {kind}, term long, ipos int").distinct()


def _frequency(index: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, n`` of the given terms that the corpus has, from the index's numbers alone."""
    terms = terms.select("term").distinct()
    small = terms.count() <= MOST_BROADCAST
    return index.select("term", "n").join(F.broadcast(terms) if small else terms, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))


def _looked_up(index: DataFrame, asked: DataFrame, frequency: DataFrame) -> DataFrame:
    """The postings of ``asked`` (with ``term``), as ``doc_id, pos`` beside its other columns.

    Up to MOST_BROADCAST rows, which are counted, go to the index; beyond that both are shuffled by
    term, the lists of hot terms over several tasks.
    """
    if asked.count() <= MOST_BROADCAST:
        met = index.join(F.broadcast(asked), "term")
    else:
        hot = frequency.filter(F.col("n") > HOT_POSTINGS).select("term", F.ceil(F.col("n") / HOT_POSTINGS).cast("int").alias("_fan"))
        salted = index.join(hot, "term", "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("docs"), F.col("_fan")), F.lit(0)).cast("int")).drop("_fan")
        spread = asked.join(hot, "term", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_fan"), F.lit(1)) - 1))).drop("_fan")
        met = salted.join(spread, ["term", "_salt"])
    others = [c for c in asked.columns if c != "term"]
    return met.select(*others, F.inline(F.arrays_zip(F.col("docs").alias("doc_id"), F.col("pos").alias("pos"))))


def _anchors(items: DataFrame, frequency: DataFrame, words: int, probes: int) -> DataFrame:
    """``item_id, term, ipos, k, behind, ahead``: the anchors of the items, numbered, with the
    distances to the anchors next to them (or to just outside of the item)."""
    known = items.join(frequency, "term", "left")
    # runs are bounded by an item's length
    by_item = Window.partitionBy("item_id").orderBy("ipos")
    known = known.withColumn("length", F.count("*").over(Window.partitionBy("item_id")))
    starts = known.filter(F.col("ipos") <= F.col("length") - words).select("item_id", F.col("ipos").alias("window"))
    inside = starts.withColumn("ipos", F.explode(F.sequence(F.col("window"), F.col("window") + words - 1)))
    inside = inside.join(known.select("item_id", "ipos", "term", "n"), ["item_id", "ipos"])
    rank = F.row_number().over(Window.partitionBy("item_id", "window").orderBy(F.col("n").asc_nulls_first(), "term", "ipos"))
    # a window with a word that the corpus lacks needs no other anchor
    lacking = F.max(F.col("n").isNull()).over(Window.partitionBy("item_id", "window"))
    chosen = inside.withColumns({"rank": rank, "lacking": lacking}).filter(F.col("n").isNull() | (~F.col("lacking") & (F.col("rank") <= probes)))
    anchors = known.join(chosen.select("item_id", "ipos").distinct(), ["item_id", "ipos"])
    anchors = anchors.select(
        "item_id", "term", "ipos", "n",
        F.row_number().over(by_item).alias("k"),
        (F.col("ipos") - F.lag("ipos", 1, -1).over(by_item)).alias("behind"),
        (F.coalesce(F.lead("ipos").over(by_item), F.col("length")) - F.col("ipos")).cast("int").alias("ahead"),
    )
    return anchors.filter("n is not null").drop("n")


def candidates(index: DataFrame, items: DataFrame, words: int = WORDS, probes: int = PROBES) -> DataFrame:
    """(doc_id, item_id, shift) where consecutive anchors of the item leave room for a window.

    ``items`` has ``item_id, term, ipos``.
    """
    frequency = cut_lineage(_frequency(index, items))
    anchors = cut_lineage(_anchors(items, frequency, words, probes))
    hits = _looked_up(index, anchors, frequency).select("doc_id", "item_id", (F.col("pos") - F.col("ipos")).alias("shift"), "k", "behind", "ahead")
    kinds = [f"{c} {hits.schema[c].dataType.simpleString()}" for c in ("doc_id", "item_id", "shift")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a run of anchors may go on in the next batch, so its last (doc, item, shift) waits for that
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            table = pa.Table.from_batches([*rest, batch]).combine_chunks()
            new = _changes(table)
            if not new.any():
                rest = table.to_batches()
                continue
            cut = int(np.flatnonzero(new)[-1]) + 1
            yield from _roomy(table.slice(0, cut), words)
            rest = table.slice(cut).to_batches()
        if rest:
            yield from _roomy(pa.Table.from_batches(rest), words)

    # sorted so, the anchors that a document has of an item at one shift follow one another
    spread = hits.repartition("doc_id", "item_id").sortWithinPartitions("doc_id", "item_id", "shift", "k")
    return by_batch(spread, run, ", ".join(kinds))


def _changes(table: pa.Table) -> np.ndarray:
    """Where a row's (doc_id, item_id, shift) isn't that of the row before; one entry less than rows."""
    out = np.zeros(max(0, table.num_rows - 1), dtype=bool)
    for c in ("doc_id", "item_id", "shift"):
        column = table[c].combine_chunks()
        column = column.dictionary_encode().indices.to_numpy()
        out |= column[1:] != column[:-1]
    return out


def _roomy(table: pa.Table, words: int) -> Iterator[pa.RecordBatch]:
    if not table.num_rows:
        return
    table = table.combine_chunks()
    k, behind, ahead = (table[c].to_numpy().astype(np.int64) for c in ("k", "behind", "ahead"))
    new = np.append(True, _changes(table) | (k[1:] > k[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(k)) - 1
    inner = np.append(0, np.cumsum(np.where(k[1:] == k[:-1], 0, behind[1:])))
    room = behind[first] + (inner[last] - inner[first]) + ahead[last] - 1
    keep = first[room >= words]
    found = table.select(["doc_id", "item_id", "shift"]).take(pa.array(keep))
    yield from found.to_batches()


def leaked_phrases(documents: DataFrame, items: DataFrame, index: DataFrame | None = None, words: int = WORDS, probes: int = PROBES) -> DataFrame:
    """``doc_id, item_id, longest``: documents that share at least ``words`` consecutive words with
    an item, and the length of the longest shared run.

    ``documents`` has ``doc_id, text``; ``items`` has ``item_id, text``.  Words are runs of letters
    and digits after NFKC, removal of format characters and lower-casing.  Repeated rows count
    once; null, empty and short texts share nothing; rows with a null id take no part.
    Columns beyond these are not read.
    """
    documents = documents.select("doc_id", "text")
    index = build_index(documents) if index is None else index
    asked = cut_lineage(item_terms(items))
    found = candidates(index, asked, words, min(probes, words))
    found = found.groupBy("doc_id", "item_id").agg(F.collect_set("shift").alias("shifts"))
    return _verified(documents, items.select("item_id", F.col("text").alias("item_text")).filter("item_text is not null").distinct(), found, words)


def _verified(documents: DataFrame, items: DataFrame, found: DataFrame, words: int) -> DataFrame:
    """The exact check: the longest run of words that the texts of each candidate pair share at one of
    its shifts."""
    ship_package(documents.sparkSession)

    @F.pandas_udf("int")
    def longest(a, b, shifts):  # noqa: ANN001, ANN202
        import pandas as pd

        hasher, kept, out = Hasher(), {}, []
        for x, y, at in zip(a, b, shifts):
            if x not in kept:
                kept[x] = hasher(normal_words(x))
            item, text = kept[x], hasher(normal_words(y))
            out.append(max(run_at(item, text, int(s)) for s in at))
        return pd.Series(out, dtype="int32")

    pairs = documents.filter("text is not null").join(found, "doc_id").join(items, "item_id")
    scored = pairs.select("doc_id", "item_id", longest("item_text", "text", "shifts").alias("longest"))
    return scored.filter(F.col("longest") >= words).groupBy("doc_id", "item_id").agg(F.max("longest").alias("longest"))


def run_at(a: np.ndarray, b: np.ndarray, shift: int) -> int:
    """Length of the longest run of ``a[i] == b[i + shift]``."""
    low, high = max(0, -shift), min(len(a), len(b) - shift)
    if high <= low:
        return 0
    breaks = np.flatnonzero(a[low:high] != b[low + shift : high + shift])
    return int(np.diff(np.concatenate(([-1], breaks, [high - low]))).max()) - 1


def near_passages(index: DataFrame, items: DataFrame, span: int = 8, share: float = 0.6) -> DataFrame:
    """Proximity matches: ``doc_id, item_id, matched, terms`` where at least ``share`` of an item's
    distinct rare terms (those of all its windows), and 4 of them or all, lie in the document, each
    within ``span`` words of its place in the item relative to the others.  Rare is the rarer half of
    the item's terms that the corpus has; terms it lacks count nowhere.

    Shifts are gathered in overlapping bins of ``2 * span``, so agreement within ``span`` always
    falls into one bin.  ``items`` has ``item_id, text``.
    """
    asked = cut_lineage(item_terms(items))
    frequency = cut_lineage(_frequency(index, asked))
    by_rarity = Window.partitionBy("item_id").orderBy("n", "term")
    ranked = asked.join(frequency, "term").withColumns({"rank": F.percent_rank().over(by_rarity), "t": F.dense_rank().over(by_rarity)})
    rare = ranked.filter("rank <= 0.5").select("item_id", "term", "t", "ipos")
    terms = rare.groupBy("item_id").agg(F.max("t").alias("terms"))
    # of each item only those with as many rare terms as it takes are binned
    rare = cut_lineage(rare.join(terms, "item_id").withColumn("least", F.greatest(F.least(F.lit(4), "terms"), F.ceil(F.col("terms") * share))))
    hits = _looked_up(index, rare, frequency).select("doc_id", "item_id", "terms", "least", "t", F.floor((F.col("pos") - F.col("ipos")) / span).cast("int").alias("b"))
    several = hits.groupBy("doc_id", "item_id", "terms", "least").agg(F.collect_set(F.struct("t", "b")).alias("h"))
    several = several.filter(F.size(F.array_distinct("h.t")) >= F.col("least")).select("doc_id", "item_id", "terms", "least", F.inline("h"))
    binned = several.withColumn("b", F.explode(F.array(F.col("b"), F.col("b") + 1)))
    near = binned.groupBy("doc_id", "item_id", "terms", "least", "b").agg(F.count_distinct("t").alias("m"))
    near = near.groupBy("doc_id", "item_id", "terms", "least").agg(F.max("m").alias("matched"))
    return near.filter(F.col("matched") >= F.col("least")).select("doc_id", "item_id", "matched", "terms")
