"""Text helpers: escaping, globs, markup, language tags, name authorities."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of names and addresses in the archive's network.
RECORD_URI = r"^at:\/\/(did:[a-z0-9]+:[a-zA-Z0-9._:%-]+)\/([a-zA-Z0-9.-]+)\/([a-zA-Z0-9._~:-]+)$"
BARE_DID = r"^did:(?:plc|web):[a-zA-Z0-9._:%-]+$"
NAMED_TYPE = r"^[a-z][a-z0-9-]*(\.[a-z0-9-]+)+(\.[a-zA-Z][a-zA-Z0-9]*)$"
# What becomes of markup, in this order; then the ends are trimmed.
MARKUP = [
    (r"(?i)<(script|style)[\s\S]*?<\/\1>", " "),
    (r"<[^>]+>", " "),
    (r"(?i)&nbsp;", " "),
    (r"(?i)&amp;", "&"),
    (r"(?i)&lt;", "<"),
    (r"(?i)&gt;", ">"),
    (r"&#?\w+;", " "),
    (r"[\s\p{Z}\x{feff}]+", " "),
]
_EDGES = r"^[\s\p{Z}\x{feff}]+|[\s\p{Z}\x{feff}]+$"


def trimmed(text: Column) -> Column:
    """``text`` without white space at its ends."""
    return F.regexp_replace(text, _EDGES, "")


def escaped_like(text: str) -> str:
    """``text`` with the wildcards of LIKE escaped by a backslash."""
    return re.sub(r"([\\%_])", r"\\\1", text)


def contains_ignoring_case(column: Column, text: str) -> Column:
    return column.ilike(f"%{escaped_like(text)}%")


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob whose one wildcard is ``*``: anchored, any case, without
    final slashes."""
    return "(?i)^" + ".*".join(re.escape(p) for p in glob.rstrip("/").split("*")) + "$"


def matches_any_glob(column: Column, globs: list[str]) -> Column:
    """Whether the column, without final slashes, matches one of the globs; null matches none."""
    plain = F.regexp_replace(column, "/+$", "")
    out = F.lit(False)
    for g in globs:
        out = out | plain.rlike(glob_pattern(g))
    return F.coalesce(out, F.lit(False))


def strip_html(html: Column) -> Column:
    """Text of HTML: script and style blocks go, tags become spaces, the four commonest entities
    their characters and others spaces, white space collapses."""
    for pattern, by in MARKUP:
        html = F.regexp_replace(html, pattern, by)
    return trimmed(html)


def base_language(langs_first: Column, lang: Column) -> Column:
    """The primary subtag, in lower case and at most 20 characters, of the first of ``langs`` or
    else of ``lang``; null if there is none."""
    tag = F.lower(F.get(F.split(F.coalesce(langs_first, lang), "-"), F.lit(0)))
    return F.when(tag != "", F.substring(tag, 1, 20))


def authority(name: str) -> str:
    """The domain that governs a dotted name: all but the last part, reversed."""
    return ".".join(reversed(name.split(".")[:-1]))
