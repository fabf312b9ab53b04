"""Languages of texts and of their segments by Bayesian evidence fusion (problem 3).

Evidence for a segment's language, all as log-likelihoods that add up:

* its words, by a naive Bayes model fitted here on a bounded sample of labelled records and
  refitted once on its own confident sentences, which sheds the wrong labels;
* the language declared for the record, by how declarations and text agree over all records;
* the suffix of the author's address, for country domains;
* the host: how often each language occurs there, smoothed towards its collection and that towards
  the whole archive, all three by grouped aggregation over all records.

A segment is a sentence, heading or list item.  It counts for a language if it has enough words
that tell languages apart; what stands between quotation marks doesn't count if the rest suffices,
so a quoted phrase doesn't make a text bilingual.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.functions.batches import by_batch
from vellumine.operators.joins import split_join
from vellumine.session import as_table, cut_lineage

# The languages, in order, and country suffixes that speak for one of them.
LANGUAGES = ("de", "en", "es", "fr", "it", "ja", "nl", "pt")
SUFFIXES = {"de": "de", "at": "de", "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en", "es": "es", "mx": "es", "ar": "es", "fr": "fr", "it": "it", "jp": "ja", "nl": "nl", "pt": "pt", "br": "pt"}
#: About so many labelled records are sampled to fit the word model, by hash of their id.
SAMPLE_ROWS = 20_000
#: Weight of the words' log-likelihood (naive Bayes is overconfident) and of a telling suffix.
WORD_WEIGHT, SUFFIX_GAIN = 0.7, 2.0
#: Pseudo-records with which a host leans on its collection, and a collection on the archive.
LEAN = 20.0
#: A segment counts with so many telling words and this confidence.
LEAST_WORDS, CONFIDENT = 3, 0.95

_FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)")
_CODE = re.compile(r"`[^`\n]*`|[!-~]{32,}|https?://\S+|at://\S+")
_LINE = re.compile(r"[^\r\n]+")
_STOP = re.compile(r"[.!?…]+[\"'”’»)\]]*\s+(?=\S)|[。！？]+[」』]*")
_QUOTED = re.compile(r"“[^“”]*”|„[^„“”]*[“”]|«[^«»]*»|(?<!\w)‘[^‘]*?’(?!\w)|\"[^\"]*\"|「[^「」]*」|『[^『』]*』")
_WORD = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")


def segments(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences, headings and list items of ``text``; code is left out."""
    text = _FENCE.sub(lambda m: " " * len(m[0]), text)
    out = []
    for line in _LINE.finditer(text):
        at = line.start()
        for stop in _STOP.finditer(text, line.start(), line.end()):
            out.append((at, stop.end()))
            at = stop.end()
        out.append((at, line.end()))
    return [(a, b) for a, b in out if text[a:b].strip()]


def words(text: str) -> list[str]:
    """Lower-case words; of scripts without spaces, single characters."""
    out: list[str] = []
    for w in _WORD.findall(_CODE.sub(" ", text).lower()):
        out += w if _CJK.search(w) else [w]
    return out


class Model:
    """Log-probabilities of words by language, and which words tell languages apart."""

    def __init__(self, counts: dict[str, np.ndarray]) -> None:
        table = np.array(list(counts.values())) if counts else np.zeros((0, len(LANGUAGES)))
        total = np.maximum(table.sum(axis=0), 1.0)
        logs = np.log((table + 0.05) / (total + 0.05 * max(len(table), 1)))
        self.row = {w: i for i, w in enumerate(counts)}
        self.logs = logs
        self.telling = (logs.max(axis=1) - logs.min(axis=1) > 2.5) if len(table) else np.zeros(0, dtype=bool)

    def score(self, found: list[str]) -> tuple[np.ndarray, int]:
        rows = [self.row[w] for w in set(found) if w in self.row]
        return self.logs[rows].sum(axis=0), int(self.telling[rows].sum())

    def segment(self, text: str) -> tuple[np.ndarray, int]:
        """Scores and telling words of a segment, without its quoted phrases if the rest suffices."""
        rest = _QUOTED.sub(" ", text)
        if rest != text:
            logs, telling = self.score(words(rest))
            if telling >= LEAST_WORDS:
                return logs, telling
        return self.score(words(text))


def declared(label: Column) -> Column:
    """The language a label names: its trimmed lower-case part before ``-`` or ``_``, or null."""
    base = F.lower(F.regexp_extract(F.regexp_replace(label, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), "^([^-_]*)", 1))
    return F.when(base.isin(*LANGUAGES), base)


def _counts(rows: DataFrame) -> dict[str, np.ndarray]:
    """Sentences by word and language; a word must occur in two."""
    summed = rows.groupBy("w", "l").agg(F.sum("n").alias("n"))
    out: dict[str, np.ndarray] = {}
    for w, l, n in zip(*(c.to_pylist() for c in summed.toArrow().columns)):
        out.setdefault(w, np.zeros(len(LANGUAGES)))[l] = n
    return {w: v for w, v in sorted(out.items()) if v.sum() >= 2}


def fit(records: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """The word model, from about ``rows`` of the labelled records, or all if there are fewer.

    The first fit counts every sentence under its record's label.  The second counts the sentences
    of which the first is sure under the language it finds.  The vocabulary that comes to the
    driver is that of the sample, whatever the archive's size.
    """
    labelled = records.filter("label is not null")
    share = min(1.0, rows / max(1, labelled.count()))
    drawn = labelled.filter(F.xxhash64("record_id") <= F.lit(int(-(2**63) + share * (2**64 - 2**11)))) if share < 1 else labelled

    def sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, list[str], list[str]]] = []
            for text, label in zip(*(c.to_pylist() for c in batch.columns)):
                for a, b in segments(text):
                    whole = text[a:b]
                    rest = _QUOTED.sub(" ", whole)
                    found = sorted(set(words(whole)))
                    rows.append((LANGUAGES.index(label), found, found if rest == whole else sorted(set(words(rest)))))
            kinds = pa.int32(), pa.list_(pa.string()), pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["l", "words", "unquoted"])

    # the texts are read and cut into words once, for both fits
    drawn = drawn.select("text", "label")
    cut = as_table(by_batch(drawn, sentences, "l int, words array<string>, unquoted array<string>"), "sentences")

    def sure(model: Model):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                whole, best = batch.column(0), []
                for found, rest in zip(whole.to_pylist(), batch.column(1).to_pylist()):
                    logs, telling = model.score(rest)
                    if telling < LEAST_WORDS and rest != found:
                        logs, telling = model.score(found)
                    order = np.sort(logs)
                    best.append(int(logs.argmax()) if telling >= LEAST_WORDS and order[-1] - order[-2] >= 4 else None)
                yield pa.RecordBatch.from_arrays([pa.array(best, pa.int32()), whole], names=["l", "words"])

        return run

    def counted(rows: DataFrame) -> dict[str, np.ndarray]:
        return _counts(rows.select("l", F.explode("words").alias("w")).groupBy("w", "l").agg(F.count("*").alias("n")))

    model = Model(counted(cut.select("l", "words")))
    return Model(counted(by_batch(cut.select("words", "unquoted"), sure(model), "l int, words array<string>").filter("l is not null")))


def segment_scores(records: DataFrame, model: Model) -> DataFrame:
    """``record_id, host, collection, label, suffix, segs``: the telling segments of each text as
    (start, end, scores by language)."""
    shared = records.sparkSession.sparkContext.broadcast(model)
    kind = records.schema["record_id"].dataType.simpleString()
    seg = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("logs", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = shared.value
        for batch in batches:
            out = []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                found = []
                for a, b in segments(text):
                    logs, telling = given.segment(text[a:b])
                    if telling >= LEAST_WORDS:
                        found.append({"start": a, "end": b, "logs": (WORD_WEIGHT * (logs - logs.max())).astype(np.float32)})
                out.append(found)
            keep = pa.array([bool(f) for f in out])
            columns = [batch.column(i).filter(keep) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([f for f in out if f], pa.list_(seg))], names=["record_id", "host", "collection", "label", "suffix", "segs"])

    given = records.select("record_id", "host", "collection", "label", "suffix", "text")
    return by_batch(given, run, f"record_id {kind}, host string, collection string, label string, suffix string, segs array<struct<start int, end int, logs array<float>>>")


def _best(logs: Column) -> Column:
    return F.array_position(logs, F.array_max(logs)).cast("int") - 1


def identify(records: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``record_id, label, start, end, lang, confidence``: every segment that counts.

    ``records`` has ``record_id, host, collection, label`` (a language or null), ``suffix`` (a
    country suffix or null) and ``text``.  Null, empty and wordless texts give no rows; repeated
    rows repeat their segments; nulls in any other column are no evidence.  If no record is
    labelled the word model is empty and nothing is identified.
    """
    records = records.filter("text <> ''")
    scored = segment_scores(records, fit(records, sample_rows))
    scored = cut_lineage(scored.withColumn("guesses", F.array_distinct(F.transform("segs", lambda s: _best(s["logs"])))))
    n = len(LANGUAGES)
    first = scored.select("host", "collection", "label", F.explode("guesses").alias("l"))
    by_host = first.groupBy("host", "collection", "label", "l").count()
    by_host = cut_lineage(by_host)

    # 9 x 8 and 8 numbers, whatever the archive's size
    agree = np.ones((n + 1, n)) / n
    for x in by_host.groupBy("label", "l").agg(F.sum("count").alias("c")).collect():
        agree[LANGUAGES.index(x.label) if x.label else n, x.l] += x.c
    says = np.log(agree / agree.sum(axis=0))
    archive = (agree.sum(axis=0) / agree.sum()).tolist()

    def wide(keys: list[str], name: str) -> DataFrame:
        return by_host.groupBy(*keys).agg(F.array(*[F.sum(F.when(F.col("l") == i, F.col("count")).otherwise(0)).cast("double") for i in range(n)]).alias(name))

    whole = F.array(*map(F.lit, archive))
    sums = [F.aggregate(c, F.lit(0.0), lambda a, x: a + x) for c in ("hc", "cc")]
    hosts = wide(["host", "collection"], "hc").join(wide(["collection"], "cc"), "collection").withColumns(dict(zip(("hn", "cn"), sums)))

    def leaning(c: str, total: str, i: int, on: Column) -> Column:
        # what a record's own text tells is no evidence of its host
        own = F.array_contains("guesses", i).cast("double")
        return (F.col(c)[i] - own + LEAN * on) / (F.col(total) - F.size("guesses") + LEAN)

    ph = F.array(*[leaning("hc", "hn", i, leaning("cc", "cn", i, F.lit(archive[i]))) for i in range(n)])
    ph = F.when(F.col("hc").isNull(), whole).otherwise(ph)

    table = F.create_map(*[x for i, l in enumerate((*LANGUAGES, "")) for x in (F.lit(l), F.array(*map(F.lit, says[i].tolist())))])
    known = [(s, LANGUAGES.index(l)) for s, l in SUFFIXES.items()]
    hint = F.create_map(*[x for s, i in known for x in (F.lit(s), F.array(*[F.lit(SUFFIX_GAIN if k == i else 0.0) for k in range(n)]))])
    none = F.array(*[F.lit(0.0)] * n)
    joined = split_join(scored, hosts, ["host", "collection"])
    # the prior and the declaration speak once per record, its segments share them
    prior = F.zip_with(F.transform(ph, lambda p: F.log(p)), table[F.coalesce("label", F.lit(""))], lambda a, b: a + b)
    prior = F.zip_with(prior, F.coalesce(hint[F.coalesce("suffix", F.lit(""))], none), lambda a, b: a + b)
    # computed below the explosion, once a record
    fused = joined.select("record_id", "label", prior.alias("prior"), "segs").select("record_id", "label", "prior", F.explode("segs").alias("s"))
    fused = fused.select("record_id", "label", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.zip_with("s.logs", "prior", lambda a, b: a.cast("double") + b).alias("logs"))
    top = F.array_max("logs")
    fused = fused.withColumns({"best": _best(F.col("logs")), "confidence": 1.0 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - top))})
    lang = F.get(F.array(*map(F.lit, LANGUAGES)), F.col("best"))
    return fused.filter(F.col("confidence") >= CONFIDENT).select("record_id", "label", "start", "end", lang.alias("lang"), "confidence")


def language_sets(found: DataFrame) -> DataFrame:
    """``record_id, label, lang, confidence, segments``: each language of each text, with the
    probability that at least one of its segments is in it."""
    # long texts: the product of doubts underflows to 0, which is what it should tell
    doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-12)))))
    return found.groupBy("record_id", "label", "lang").agg((1 - doubt).alias("confidence"), F.count("*").alias("segments"))


def mislabelled(found: DataFrame) -> DataFrame:
    """``record_id, lang`` for texts whose label is missing or isn't one of their languages, or
    that have several languages: a row for each."""
    each = found.groupBy("record_id").agg(F.max("label").alias("label"), F.collect_set("lang").alias("langs"))
    wrong = F.col("label").isNull() | ~F.array_contains("langs", F.col("label")) | (F.size("langs") > 1)
    return each.filter(F.coalesce(wrong, F.lit(True))).select("record_id", F.explode("langs").alias("lang"))
