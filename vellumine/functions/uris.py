"""Record addresses: ``at://<did>/<collection>/<rkey>`` and bare account identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = "^[\\s\\p{Z}\\x{85}\\x{feff}]+|[\\s\\p{Z}\\x{85}\\x{feff}]+$"


def percent_decoded(text: Column) -> Column:
    """UTF-8 percent-decoding; a plus sign stays, and malformed input stays as it is."""
    return F.when(text.contains("%"), F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)).otherwise(text)


def canonical_uri(uri: Column) -> Column:
    """What ``uri`` names: no surrounding white space, query, fragment or final slash; scheme in
    lower case; percent-decoded.  Null stays null."""
    text = F.regexp_replace(F.regexp_replace(uri, _EDGE, ""), "/?(?:[?#].*)?$", "")
    return F.regexp_replace(percent_decoded(text), "^(?i)at://", "at://")


def uri_parts(uri: Column) -> Column:
    """Array of the parts (did, collection, rkey) of a canonical uri, null where empty; an empty
    array if it names neither a record nor an account."""
    body = F.regexp_extract(uri, "^(?:at://)?(did:[^/]+(?:/[^/]*){0,2})$", 1)
    return F.transform(F.filter(F.split(body, "/"), lambda _, i: body != ""), lambda p: F.when(p != "", p))
