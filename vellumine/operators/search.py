"""Keyword, vector and fused search.

Analysis: words in lower case, without the stop words of the row's language; English words go
through Harman's S-stemmer (1991), others stay as they are.  All of it is built-in expressions, so
the term arrays can be stored once with the records or computed within the query.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.errors import InvalidRequest, ServiceUnavailable
from vellumine.functions.batches import by_batch, ship_package
from vellumine.operators.paging import FUSED_LEG, clamp
from vellumine.operators.records import filtered

TEXT_CAP = 200_000
TITLE_WEIGHT, TEXT_WEIGHT, SATURATION = 1.0, 0.2, 1.2
RRF = 60

# Language tags to analyzers; none is English, unknown ones are simple.
ANALYZERS = {
    "en": "english", "english": "english", "es": "spanish", "spanish": "spanish", "fr": "french", "french": "french", "de": "german", "german": "german",
    "pt": "portuguese", "portuguese": "portuguese", "it": "italian", "italian": "italian", "nl": "dutch", "dutch": "dutch", "ru": "russian", "russian": "russian",
    "sv": "swedish", "da": "danish", "no": "norwegian", "fi": "finnish", "tr": "turkish",
}
# Words too common in English to search for.
STOP_WORDS = tuple("a an and are as at be but by for from has have he her his i if in into is it its no not of on or she so such that the their then there these they this to was we were will with you".split())


def analyzer_of(lang: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ANALYZERS.items() for x in pair])
    return F.when(lang.isNull(), "english").otherwise(F.coalesce(known[F.lower(lang)], F.lit("simple")))


def stem_english(word: str) -> str:
    """Harman's S-stemmer, on the driver."""
    if len(word) > 3 and word.endswith("ies") and word[-4] not in "ea":
        return word[:-3] + "y"
    if len(word) > 3 and word.endswith("es") and word[-3] not in "aeo":
        return word[:-1]
    if len(word) > 2 and word.endswith("s") and word[-2] not in "us":
        return word[:-1]
    return word


def _stemmed(w: Column) -> Column:
    return (
        F.when(w.rlike("[^ea]ies$"), F.regexp_replace(w, "ies$", "y"))
        .when(w.rlike("[^aeo]es$"), F.regexp_replace(w, "s$", ""))
        .when(w.rlike(".[^us]s$"), F.regexp_replace(w, "s$", ""))
        .otherwise(w)
    )


def terms(text: Column, analyzer: Column | None = None) -> Column:
    """Terms of a text in order (an array, empty for null)."""
    words = F.regexp_extract_all(F.lower(F.left(F.coalesce(text, F.lit("")), F.lit(TEXT_CAP))), F.lit(r"([\p{L}\p{N}]+)"))
    english = F.transform(F.filter(words, lambda w: ~w.isin(*STOP_WORDS)), _stemmed)
    return english if analyzer is None else F.when(analyzer == "english", english).otherwise(words)


def searchable(records: DataFrame) -> DataFrame:
    """``records`` with ``title_terms`` and ``text_terms``."""
    a = analyzer_of(F.col("lang"))
    return records.withColumns({"title_terms": terms(F.col("extracted_title"), a), "text_terms": terms(F.col("extracted_text"), a)})


def postings(indexed: DataFrame) -> DataFrame:
    """The inverted index of :func:`searchable` rows: ``term, id, title_tf, text_tf``.  Written
    sorted by term it answers a query from the row groups of its terms."""
    parts = [indexed.select("id", F.explode(c).alias("term"), F.lit(int(c == "title_terms")).alias("t")) for c in ("title_terms", "text_terms")]
    return parts[0].unionByName(parts[1]).groupBy("term", "id").agg(F.sum("t").alias("title_tf"), F.sum(1 - F.col("t")).alias("text_tf"))


@dataclass
class Query:
    """A parsed query: groups of alternatives that must all match, and what must not occur."""

    groups: list[list[list[str]]] = field(default_factory=list)
    excluded: list[list[str]] = field(default_factory=list)

    def words(self) -> list[str]:
        return list(dict.fromkeys(w for g in self.groups for phrase in g for w in phrase))


def query_terms(text: str) -> list[str]:
    return [stem_english(w) for w in re.findall(r"[^\W_]+", text.lower()) if w not in STOP_WORDS]


def parse_query(text: str) -> Query:
    """Free words must all occur, ``"..."`` as a phrase, ``or`` joins alternatives, ``-`` excludes.
    Stop words are dropped."""
    query, join = Query(), False
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        if word.lower() == "or" and not minus:
            join = bool(query.groups)
            continue
        found = query_terms(phrase or word)
        if not found:
            continue
        if minus:
            query.excluded.append(found)
        elif join:
            query.groups[-1].append(found)
        else:
            query.groups.append([found])
        join = False
    return query


def _has(phrase: list[str], title: str, text: str) -> Column:
    def within(c: str) -> Column:
        if len(phrase) == 1:
            return F.array_contains(c, phrase[0])
        # terms are runs of letters and digits: put together by spaces, a phrase is a part of the text
        return F.contains(F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" ")), F.lit(f" {' '.join(phrase)} "))

    return within(title) | within(text)


def may_match(query: Query, title: str = "extracted_title", text: str = "extracted_text") -> Column:
    """Whether a row's words as they are written can match: false only where :func:`matches` is on
    its terms.  A term is its word up to the ending that the stemmer changes."""

    def occurs(word: str) -> Column:
        stem = F.lit(word.removesuffix("y"))
        return reduce(lambda a, b: a | b, [F.contains(F.lower(F.left(F.coalesce(F.col(c), F.lit("")), F.lit(TEXT_CAP))), stem) for c in (title, text)])

    every = lambda phrase: reduce(lambda a, b: a & b, map(occurs, phrase))
    tests = [reduce(lambda a, b: a | b, map(every, g)) for g in query.groups]
    return reduce(lambda a, b: a & b, tests, F.lit(bool(query.groups or query.excluded)))


def matching(records: DataFrame, query: Query) -> DataFrame:
    """:func:`searchable` rows that match; terms are only made of texts that may, once a row."""
    made = searchable(records.filter(may_match(query)))
    terms_ = F.array(F.struct("title_terms", "text_terms"))
    # a generator keeps the optimizer from making the terms anew at each mention in the filter
    made = made.select(*records.columns, F.explode(terms_).alias("_terms")).select(*records.columns, "_terms.title_terms", "_terms.text_terms")
    return made.filter(matches(query))


def matches(query: Query, title: str = "title_terms", text: str = "text_terms") -> Column:
    """Whether a row matches; a query of nothing but stop words matches nothing."""
    if not query.groups and not query.excluded:
        return F.lit(False)
    tests = [reduce(lambda a, b: a | b, [_has(p, title, text) for p in g]) for g in query.groups]
    tests += [~_has(p, title, text) for p in query.excluded]
    return reduce(lambda a, b: a & b, tests)


def rank(query: Query, title: str = "title_terms", text: str = "text_terms") -> Column:
    """Sum over the query's terms of a saturating weighted frequency, title terms counting more."""
    out = F.lit(0.0)
    for w in query.words():
        tf = TITLE_WEIGHT * F.size(F.filter(title, _is(w))) + TEXT_WEIGHT * F.size(F.filter(text, _is(w)))
        out = out + tf / (tf + SATURATION)
    return out


def _is(word: str):  # noqa: ANN202
    return lambda x: x == word


def keyword_search(records: DataFrame, q: str, limit: Any = None, **filters: Any) -> DataFrame:
    """``id, rank`` and the record's columns, best first; cold records are hidden by default."""
    query = parse_query(q)
    kept = filtered(records, exclude_cold=filters.pop("exclude_cold", True), **filters)
    return searchable(kept).filter(matches(query)).withColumn("rank", rank(query)).drop("title_terms", "text_terms").orderBy(F.col("rank").desc(), F.col("id").desc()).limit(clamp(limit, "records"))


def cosine_distance(embedding: Column, vector: Sequence[float]) -> Column:
    """1 - cosine, by built-ins; null for a null or zero vector."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    add = lambda a, x: a + x
    dot = F.aggregate(F.zip_with(embedding, q, lambda a, b: a.cast("double") * b), F.lit(0.0), add)
    size = F.sqrt(F.aggregate(F.transform(embedding, lambda a: a.cast("double") * a.cast("double")), F.lit(0.0), add))
    return 1 - F.try_divide(dot, size * float(np.linalg.norm(np.asarray(vector, dtype=np.float64))))


def chunk_distances(embeddings: DataFrame, vector: Sequence[float]) -> DataFrame:
    """``id, record_id, distance`` of every chunk with a usable vector of the query's width, by
    matrix products on Arrow batches."""
    q = np.asarray(vector, dtype=np.float64)
    q = q / np.linalg.norm(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            size = np.diff(lists.offsets.to_numpy())
            rows = np.flatnonzero((size == len(q)) & ~lists.is_null().to_numpy(zero_copy_only=False))
            values = lists.values.to_numpy(zero_copy_only=False)
            start = lists.offsets.to_numpy()[rows]
            v = values[start[:, None] + np.arange(len(q))].astype(np.float64) if len(rows) else np.zeros((0, len(q)))
            with np.errstate(invalid="ignore", divide="ignore"):
                d = 1 - (v @ q) / np.linalg.norm(v, axis=1)
            good = np.isfinite(d)
            rows = pa.array(rows[good])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(d[good])], names=["id", "record_id", "distance"])

    return by_batch(embeddings.select("id", "record_id", "embedding"), run, "id long, record_id long, distance double")


def best_chunks(embeddings: DataFrame, vector: Sequence[float], legs: int = FUSED_LEG) -> DataFrame:
    """``record_id, distance``: the nearest chunks over all records, then each record's best."""
    near = chunk_distances(embeddings, vector).orderBy("distance", "id").limit(legs)
    return near.groupBy("record_id").agg(F.min("distance").alias("distance"))


def semantic_search(records: DataFrame, embeddings: DataFrame, vector: Sequence[float] | None, limit: Any = None, prefilter: bool = False, **filters: Any) -> DataFrame:
    """Records by their best chunk, nearest first.  The nearest chunks are taken over all records
    and filtered then, or with ``prefilter`` among the matching records only."""
    if vector is None:
        raise ServiceUnavailable("no embedding for the query")
    kept = filtered(records, **filters)
    if prefilter:
        embeddings = embeddings.join(kept.select(F.col("id").alias("record_id")), "record_id", "left_semi")
    best = best_chunks(embeddings, vector)
    # at most FUSED_LEG rows
    return kept.join(F.broadcast(best.withColumnRenamed("record_id", "id")), "id").orderBy("distance", F.col("id").desc()).limit(clamp(limit, "records"))


def hybrid_search(records: DataFrame, embeddings: DataFrame, q: str, vector: Sequence[float] | None, limit: Any = None, **filters: Any) -> DataFrame:
    """``id, score`` and the record's columns: reciprocal rank fusion of the best of both legs."""
    if vector is None:
        raise ServiceUnavailable("no embedding for the query")
    query = parse_query(q)
    kept = filtered(records, **filters)
    words = searchable(kept.select("id", "lang", "extracted_title", "extracted_text")).filter(matches(query)).select("id", rank(query).alias("rank")).orderBy(F.col("rank").desc(), F.col("id").desc()).limit(FUSED_LEG)
    words = words.withColumn("fts_rank", F.row_number().over(Window.orderBy(F.col("rank").desc(), F.col("id").desc())))
    near = best_chunks(embeddings, vector).withColumnRenamed("record_id", "id")
    near = kept.select("id").join(F.broadcast(near), "id").withColumn("vec_rank", F.row_number().over(Window.orderBy("distance", F.col("id").desc())))
    part = lambda c: F.coalesce(1.0 / (F.lit(float(RRF)) + F.col(c)), F.lit(0.0))
    fused = words.select("id", "fts_rank").join(near.select("id", "vec_rank"), "id", "full_outer").select("id", (part("fts_rank") + part("vec_rank")).alias("score"))
    return kept.join(F.broadcast(fused), "id").orderBy(F.col("score").desc(), F.col("id").desc()).limit(clamp(limit, "records"))


def highlighted(page: DataFrame, q: str, fragments: int = 2, least: int = 8, most: int = 30) -> DataFrame:
    """``page`` (after its limit) with ``highlight``: up to ``fragments`` excerpts of the title and
    text, of at most ``most`` words, with the query's words marked."""
    ship_package(page.sparkSession)
    wanted = set(parse_query(q).words())

    @F.pandas_udf("string")
    def mark(text):  # noqa: ANN001, ANN202
        return text.map(lambda t: headline(t, wanted, fragments, least, most))

    whole = F.concat(F.coalesce("extracted_title", F.lit("")), F.lit(" "), F.coalesce("extracted_text", F.lit("")))
    return page.withColumn("highlight", mark(whole))


def headline(text: str, wanted: set[str], fragments: int = 2, least: int = 8, most: int = 30) -> str:
    tokens = [(m.start(), m.end(), stem_english(m[0].lower()) in wanted) for m in re.finditer(r"[^\W_]+", text)]
    hits = [i for i, t in enumerate(tokens) if t[2]]
    if not hits:
        return text[: tokens[least - 1][1]] if len(tokens) >= least else text.strip()
    out, at = [], -1
    for i in hits:
        if i <= at or len(out) == fragments:
            continue
        first = max(at + 1, i - least // 2)
        at = min(len(tokens) - 1, first + most - 1)
        piece, last = [], tokens[first][0]
        for s, e, hit in tokens[first : at + 1]:
            piece += [text[last:s], f"<mark>{text[s:e]}</mark>" if hit else text[s:e]]
            last = e
        out.append("".join(piece))
    return " … ".join(out)


MODES = ("fts", "semantic", "hybrid")


def search(records: DataFrame, q: str, mode: str = "fts", embeddings: DataFrame | None = None, embed: Any = None, ranking: Mapping | None = None, **options: Any) -> DataFrame:
    """Dispatch by mode.  ``embed`` turns the query into a vector; if it fails only the vector
    modes are unavailable.  A ranking goes with keywords only and is applied by the caller."""
    if not isinstance(q, str) or not q.strip():
        raise InvalidRequest("q must be a non-empty string")
    if mode not in MODES:
        raise InvalidRequest(f"unknown mode {mode!r}")
    if mode == "fts":
        return keyword_search(records, q, **options)
    if ranking is not None:
        raise InvalidRequest("ranking can't be combined with vector modes")
    try:
        vector = embed(q) if embed else None
    except Exception as e:  # noqa: BLE001
        raise ServiceUnavailable(f"embedding failed: {e}") from e
    run = semantic_search if mode == "semantic" else hybrid_search
    return run(records, embeddings, vector, **options) if mode == "semantic" else run(records, embeddings, q, vector, **options)
