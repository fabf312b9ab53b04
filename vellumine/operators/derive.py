"""Tables derived from record bodies: links, types, prose, languages and text chunks.

Every body becomes, through the structural index, the list of its strings with the way to each
(:func:`body_strings`).  Links, types and prose are column expressions over that list: no body is
walked twice, nothing is shuffled, and rules are plain filters.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.functions.batches import by_batch
from vellumine.functions.jsonpath import extract_text
from vellumine.functions.text import BARE_DID, NAMED_TYPE, RECORD_URI, base_language, strip_html, trimmed
from vellumine.operators import structural

# Keys whose strings are prose, keys whose strings never are, keys of titles.
PROSE_KEYS = frozenset(["plaintext", "text", "markdown", "html", "caption", "alt"])
NON_PROSE_KEYS = frozenset(
    ["did", "uri", "atURI", "id", "src", "url", "href", "ref", "cid", "rev", "align", "role", "level", "lang", "mimeType", "path", "slug", "color", "icon"]
)
TITLE_KEYS = ("title", "name", "subject", "headline", "displayName")
# Kinds of schema properties that hold nested content; references followed at most.
NESTED_KINDS = frozenset(["union", "ref", "object", "unknown"])
MOST_HOPS = 5

_LEAF = pa.struct([("path", pa.string()), ("steps", pa.list_(pa.string())), ("own", pa.bool_()), ("blob", pa.bool_()), ("text", pa.string())])
_LEAF_SQL = "array<struct<path string, steps array<string>, own boolean, blob boolean, text string>>"


def body_strings(records: DataFrame, *extra: str) -> DataFrame:
    """``record_id, strings`` and the ``extra`` columns, for each readable body in ``record``.

    ``strings`` has every string of the body in its order: ``path`` (keys joined by ``.``, ``[]`` for
    list levels), ``steps`` (the keys alone), ``own`` (an object holds it under the last key, not a
    list), ``blob`` (some enclosing object is a blob) and ``text``.  Null and unreadable bodies give
    no row, bodies without strings an empty list.
    """
    kinds = {c: records.schema[c].dataType.simpleString() for c in ("id", *extra)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            found = structural.strings(texts)
            readable = pa.array([f is not None for f in found])
            lists = pa.array([f for f in found if f is not None], pa.list_(_LEAF))
            kept = [batch.column(i).filter(readable) for i in (0, *range(2, batch.num_columns))]
            yield pa.RecordBatch.from_arrays([kept[0], lists, *kept[1:]], names=["record_id", "strings", *extra])

    given = records.select("id", "record", *extra).filter("record is not null")
    return by_batch(given, run, ", ".join([f"record_id {kinds['id']}", f"strings {_LEAF_SQL}", *(f"{c} {kinds[c]}" for c in extra)]))


def _whole(pattern: str) -> str:
    """``pattern`` whose end is the text's very end, not that before a last line break."""
    return pattern.removesuffix("$") + r"\z"


def _among(steps: Column, names: Sequence[str] | frozenset[str]) -> Column:
    return F.arrays_overlap(steps, F.array(*map(F.lit, sorted(names))))


def extract_links(records: DataFrame) -> DataFrame:
    """``record_id, path, target_uri, target_did, target_collection, target_rkey``: each record
    address and bare account in a body, once for each path; blobs and types hold none."""
    within = F.filter("strings", lambda s: ~s.blob & ~_among(s.steps, ["$type"]) & (s.text.rlike(_whole(RECORD_URI)) | s.text.rlike(_whole(BARE_DID))))
    each = body_strings(records).select("record_id", F.explode(F.array_distinct(F.transform(within, lambda s: F.struct(s.path.alias("path"), s.text.alias("target_uri"))))).alias("l")).select("record_id", "l.*")
    part = lambda i: F.nullif(F.regexp_extract("target_uri", RECORD_URI, i), F.lit(""))
    return each.select("record_id", "path", "target_uri", F.coalesce(part(1), F.col("target_uri")).alias("target_did"), part(2).alias("target_collection"), part(3).alias("target_rkey"))


def extract_types(records: DataFrame) -> DataFrame:
    """``record_id, path, nsid``: each named type in a body, once for each path; blobs count too."""
    named = F.filter("strings", lambda s: s.own & (F.array_position(s.steps, "$type") == F.size(s.steps)) & s.text.rlike(_whole(NAMED_TYPE)))
    once = F.array_distinct(F.transform(named, lambda s: F.struct(s.path.alias("path"), s.text.alias("nsid"))))
    return body_strings(records).select("record_id", F.explode(once).alias("t")).select("record_id", "t.*")


@dataclass
class Extraction:
    """Where a collection's prose lies."""

    title_fields: list[str] = field(default_factory=list)
    text_fields: list[str] = field(default_factory=list)
    rich_fields: list[str] = field(default_factory=list)


def _texts(values: Column) -> Column:
    """Texts that aren't blank, joined by a blank line."""
    return F.concat_ws("\n\n", F.filter(values, lambda x: x.isNotNull() & (x != "")))


def _flat(strings: Column, names: Column) -> Column:
    """The trimmed texts of the given top-level fields, in the order of ``names``."""
    held = lambda name: F.filter(strings, lambda s: s.own & (F.size(s.steps) == 1) & (s.steps[0] == name))
    return _texts(F.transform(names, lambda name: trimmed(F.get(held(name), F.lit(0)).text)))


def _rich(strings: Column, names: Column, keys_for: Mapping[str, set[str]]) -> Column:
    """The prose within the given top-level fields, each field's strings together.  ``keys_for`` has
    the prose keys of content types; types it lacks, or has none for, use PROSE_KEYS."""
    usual = F.array(*map(F.lit, sorted(PROSE_KEYS)))
    known = {t: keys for t, keys in keys_for.items() if keys}
    by_type = F.create_map(*[x for t, keys in known.items() for x in (F.lit(t), F.array(*map(F.lit, sorted(keys))))]) if known else None

    def section(name: Column) -> Column:
        inside = F.filter(strings, lambda s: (F.get(s.steps, F.lit(0)) == name) & ~(s.own & (F.size(s.steps) == 1)))
        kind = F.get(F.filter(inside, lambda s: s.path == F.concat(name, F.lit(".$type"))), F.lit(0)).text
        keys = F.coalesce(F.try_element_at(by_type, kind), usual) if by_type is not None else usual
        hidden = sorted(NON_PROSE_KEYS | {"$type"})
        prose = F.filter(inside, lambda s: s.own & F.array_contains(keys, F.element_at(s.steps, -1)) & ~_among(F.slice(s.steps, 2, F.size(s.steps)), hidden) & (trimmed(s.text) != ""))
        return trimmed(F.concat_ws("\n\n", F.transform(prose, lambda s: F.when(F.element_at(s.steps, -1) == "html", strip_html(s.text)).otherwise(trimmed(s.text)))))

    return _texts(F.transform(names, section))


def extract_documents(records: DataFrame, extraction: Mapping[str, Extraction], keys_for: Mapping[str, set[str]] | None = None) -> DataFrame:
    """``record_id, title, text`` by each collection's extraction: the text is the flat fields, then
    the rich ones; what is empty is null.  Collections that ``extraction`` lacks have no prose."""
    names = F.array().cast("array<string>")
    fields = {part: names for part in asdict(Extraction())}
    for collection, how in extraction.items():
        for part, listed in asdict(how).items():
            fields[part] = F.when(F.col("collection") == collection, F.array(*map(F.lit, listed)).cast("array<string>")).otherwise(fields[part])
    strings = F.col("strings")
    title = _flat(strings, fields["title_fields"])
    text = _texts(F.array(_flat(strings, fields["text_fields"]), _rich(strings, fields["rich_fields"], keys_for or {})))
    return body_strings(records, "collection").select("record_id", F.nullif(title, F.lit("")).alias("title"), F.nullif(text, F.lit("")).alias("text"))


# --- what schemas tell


def _outline(definition: Any) -> list[tuple[str, str | None]]:
    """The ends of a definition in order: (path below it, None) of a string and (path, reference)."""
    ends, open_nodes = [], [("", definition)]
    while open_nodes:
        path, node = open_nodes.pop()
        if not isinstance(node, dict):
            continue
        kind, inner = node.get("type"), []
        if kind == "string":
            ends.append((path, None))
        elif kind in ("ref", "union"):
            refs = node.get("refs") if kind == "union" else [node.get("ref")]
            ends += [(path, r) for r in refs or [] if r]
        elif kind == "array":
            inner = [(f"{path}[]", node.get("items"))]
        elif kind == "record":
            inner = [(path, node.get("record"))]
        else:
            inner = [(f"{path}.{name}", p) for name, p in (node.get("properties") or {}).items()]
        open_nodes += inner[::-1]
    return ends


def text_fields(schema: Mapping[str, Any], resolve: Callable[[str], Mapping[str, Any] | None] = lambda _: None, hops: int = MOST_HOPS) -> list[str]:
    """Sorted paths of the string properties that a schema declares, its own definitions in their
    order and what they refer to, here or in other schemas, at most ``hops`` references away.  Each
    definition is entered by reference once."""
    found: set[str] = set()
    entered: set[tuple[str, str]] = set()
    own = schema.get("defs") if isinstance(schema.get("defs"), dict) else {}
    for name in own:
        entered.add((schema.get("id", "unknown"), name))
        # a table of what is reached: home schema, definition, path so far, references taken
        reached = [(schema, name, "" if name == "main" else f"#{name}", 0)]
        while reached:
            home, at, path, taken = reached.pop()
            steps = []
            for below, ref in _outline((home.get("defs") or {}).get(at)):
                whole = f"{path}{below}" if path or not below.startswith(".") else below[1:]
                if ref is None:
                    found.add(whole)
                    continue
                other, _, part = ref.partition("#")
                steps.append((resolve(other) if other else home, part or "main", whole, taken + 1))
            # the first reference with all that it leads to comes before the next
            for step in steps[::-1]:
                reached.append(step)
            while reached:
                home, at, _, taken = reached[-1]
                mark = (home.get("id", "unknown"), at) if home else None
                if mark and mark not in entered and at in (home.get("defs") or {}) and taken <= hops:
                    entered.add(mark)
                    break
                if mark and taken > hops:
                    entered.add(mark)
                reached.pop()
    return sorted(found - {""})


def text_keys(paths: Sequence[str]) -> set[str]:
    """The prose keys that a schema's string paths end in."""
    return {p.rsplit(".", 1)[-1].replace("[]", "") for p in paths} - NON_PROSE_KEYS


def derived_extraction(schema: Mapping[str, Any] | None, override: Mapping[str, list[str]] | None = None) -> Extraction:
    """Where a collection's prose lies by its schema, any part of which ``override`` may replace."""
    body = reduce(lambda node, key: (node or {}).get(key), ("defs", "main"), schema) or {}
    body = (body.get("record") or {}) if body.get("type") == "record" else body
    kinds = {name: _kind(prop) for name, prop in (body.get("properties") or {}).items()}
    flat = [name for name, kind in kinds.items() if kind == ("string", False) and name not in NON_PROSE_KEYS]
    parts = {
        "title_fields": [n for n in flat if n in TITLE_KEYS],
        "text_fields": [n for n in flat if n not in TITLE_KEYS],
        "rich_fields": [n for n, (kind, _) in kinds.items() if kind in NESTED_KINDS],
    }
    return Extraction(**(parts | {k: list(v) for k, v in (override or {}).items()}))


def _kind(prop: Any) -> tuple[str | None, bool]:
    """The innermost kind of a property and whether lists enclose it."""
    listed = False
    while isinstance(prop, dict) and prop.get("type") == "array":
        prop, listed = prop.get("items"), True
    return (prop.get("type") if isinstance(prop, dict) else None), listed


# --- chunks

#: Places to cut, best first: before a blank line, after a sentence's full stop, before a space.
_STOPS = [(re.compile(r"(?=\n\n)"), 2, 0), (re.compile(r"\.(?=[ \n])"), 1, 1), (re.compile(r"(?= )"), 1, 0)]


def chunk_spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a trimmed text: at most ``size`` characters each, cut at the last
    place of the best kind in the latter half, else hard; each next one starts ``overlap`` back.

    Places are found once for the whole text and looked up by bisection.
    """
    if len(text) <= size:
        return [(0, len(text))] if text else []
    # per kind: where it matches, what must still be in the chunk after that, where the chunk ends
    places = [([m.start() for m in pattern.finditer(text)], after + shift, shift) for pattern, after, shift in _STOPS]
    out, at = [], 0
    while at + size < len(text):
        end = at + size
        cut = end
        for where, need, shift in places:
            k = bisect_right(where, end - need) - 1
            if k >= 0 and 2 * (where[k] - at) > size:
                cut = where[k] + shift
                break
        out.append((at, cut))
        at += max(cut - at - overlap, 1)
    return [*out, (at, len(text))]


def chunk_text(text: str, size: int, overlap: int) -> list[str]:
    text = text.strip()
    return [c for a, b in chunk_spans(text, size, overlap) if (c := text[a:b].strip())]


def extract_chunks(documents: DataFrame, size: int = 1800, overlap: int = 200) -> DataFrame:
    """``record_id, chunk_index, chunk_text`` of ``record_id, text``; short texts stay in the JVM.
    Null and blank texts have none."""
    kind = documents.schema["record_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [chunk_text(t, size, overlap) for t in batch.column(1).to_pylist()]
            counts = np.array([len(f) for f in found], dtype=np.int64)
            index = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            columns = [batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), counts))), pa.array(index.astype(np.int32)), pa.array([c for f in found for c in f], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["record_id", "chunk_index", "chunk_text"])

    given = documents.select("record_id", trimmed(F.col("text")).alias("text")).filter("text <> ''")
    short = given.filter(F.char_length("text") <= size).select("record_id", F.lit(0).alias("chunk_index"), F.col("text").alias("chunk_text"))
    long = given.filter(F.char_length("text") > size)
    return by_batch(long, run, f"record_id {kind}, chunk_index int, chunk_text string").unionByName(short)


def record_language(body: Column) -> Column:
    """The language a body declares."""
    return base_language(extract_text(body, "langs.0"), extract_text(body, "lang"))
