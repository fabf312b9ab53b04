"""The archive's own queries, each over whole tables, with their SQL.

Where a query asks about one account, record or vector, it takes the commonest one in the data
(ties by the least name), so that it means something on any input.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.functions.text import matches_any_glob, strip_html
from vellumine.operators import aggregate as A
from vellumine.operators import archive as AR
from vellumine.operators import derive as D
from vellumine.operators import graph as G
from vellumine.operators import ranking as RK
from vellumine.operators import records as RC
from vellumine.operators import search as S
from vellumine.operators.where import compile_sort
from vellumine.sources.tables import table

NOW = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
DOCUMENT, SUBSCRIPTION, RECOMMEND, PUBLICATION = "site.standard.document", "site.standard.graph.subscription", "site.standard.graph.recommend", "site.standard.publication"
WORDS, PHRASE = "library catalogue", '"night train" or "winter timetable" -glossary'
GLOB = "https://pds1.*"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The tables of a folder with repeated rows counted once."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base

    @property
    def records(self) -> DataFrame:
        return RC.unique_records(table(self.spark, self.base, "records"))

    @property
    def links(self) -> DataFrame:
        return RC.unique_links(table(self.spark, self.base, "record_links"))

    @property
    def events(self) -> DataFrame:
        return table(self.spark, self.base, "change_events").filter("event_type = 'record'").dropDuplicates(["id"])

    @property
    def chunks(self) -> DataFrame:
        return table(self.spark, self.base, "record_embeddings").dropDuplicates(["id"])

    @property
    def hosts(self) -> DataFrame:
        return table(self.spark, self.base, "did_pds")

    def commonest(self, rows: DataFrame, column: str) -> str:
        """The commonest value, one row: a query's parameter."""
        counted = rows.filter(F.col(column).isNotNull()).groupBy(column).count()
        return counted.orderBy(F.col("count").desc(), column).first()[0]


_BASE = """WITH r AS (SELECT id, first(did) AS did, first(collection) AS collection, first(rkey) AS rkey, first(uri) AS uri, first(cid) AS cid, first(rev) AS rev,
  first(record) AS raw, first(CASE WHEN json_valid(record) THEN record END) AS record, first(lang) AS lang, first(embed_status) AS embed_status, first(cold) AS cold,
  first(extracted_title) AS extracted_title, first(extracted_text) AS extracted_text, min(indexed_at) AS indexed_at, first(deleted_at) AS deleted_at FROM records GROUP BY id),
l AS (SELECT DISTINCT * FROM record_links),
e AS (SELECT DISTINCT * FROM change_events WHERE event_type = 'record'),
fan AS (SELECT did AS v FROM r WHERE collection = 'site.standard.graph.subscription' AND deleted_at IS NULL GROUP BY did ORDER BY count(*) DESC, did LIMIT 1),
star AS (SELECT target_uri AS v FROM l WHERE target_uri IS NOT NULL GROUP BY target_uri ORDER BY count(*) DESC, target_uri LIMIT 1)
"""


def query(sql: str | None = None, name: str | None = None):  # noqa: ANN201
    """Register a query and, if it has one, its SQL after the common definitions."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or f.__name__
        QUERIES[key] = lambda spark, base: f(Tables(spark, base))
        if sql:
            ORACLE[key] = _BASE + sql if sql.startswith(("SELECT", ",")) else sql
        return f

    return register


def _time(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


def _sql_time(c: str) -> str:
    return f"strftime({c} AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S.%f') AS {c.split('.')[-1]}"


# --- events

_EVENT = f"e.id, r.uri, e.did, e.collection, e.rkey, e.action, CASE WHEN e.action <> 'delete' THEN r.cid END AS cid, e.rev, e.live, {_sql_time('e.created_at')}"
_OWN = "r.did = e.did AND r.collection = e.collection AND r.rkey = e.rkey"


@query(f"SELECT {_EVENT} FROM e JOIN r ON {_OWN} WHERE e.id > 100 ORDER BY e.id LIMIT 200")
def event_page_asc(t: Tables) -> DataFrame:
    return G.event_page(t.events, t.records, cursor=100).withColumn("created_at", _time("created_at"))


@query(f"SELECT {_EVENT} FROM e JOIN r ON {_OWN} WHERE e.action = 'delete' ORDER BY e.id DESC LIMIT 500")
def event_page_desc(t: Tables) -> DataFrame:
    return G.event_page(t.events, t.records, limit=900, order="desc", actions=["delete"]).withColumn("created_at", _time("created_at"))


@query(f"SELECT {_EVENT} FROM e JOIN r ON {_OWN} WHERE e.created_at >= TIMESTAMPTZ '2025-03-01 00:00:00+00' AND e.created_at <= TIMESTAMPTZ '2025-03-31 12:00:00+00' ORDER BY e.id LIMIT 500")
def event_since_until(t: Tables) -> DataFrame:
    page = G.event_page(t.events, t.records, limit=500, since="2025-03-01T00:00:00Z", until="2025-03-31T12:00:00Z")
    return page.withColumn("created_at", _time("created_at"))


@query("SELECT max(id) AS head FROM e")
def event_head(t: Tables) -> DataFrame:
    return t.events.agg(F.max("id").alias("head"))


@query("SELECT r.id AS record_id, r.did, r.collection, r.rkey, CASE WHEN r.deleted_at IS NULL THEN 'create' ELSE 'delete' END AS action, r.rev FROM r WHERE NOT EXISTS (SELECT 1 FROM e WHERE r.did = e.did AND r.collection = e.collection AND r.rkey = e.rkey)")
def event_backfill_missing(t: Tables) -> DataFrame:
    return AR.missing_events(t.records, t.events).select("record_id", "did", "collection", "rkey", "action", "rev")


# --- aggregation

for _bucket in A.BUCKETS:

    @query(
        f"SELECT strftime(date_trunc('{_bucket}', e.created_at AT TIME ZONE 'UTC'), '%Y-%m-%d %H:%M:%S') AS k0, e.collection AS k1, count(*) AS \"count\" FROM e JOIN r ON {_OWN} GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 500",
        f"agg_bucket_{_bucket}",
    )
    def _agg_bucket(t: Tables, bucket: str = _bucket) -> DataFrame:
        rows = A.joined_source("events", t.records, events=t.events)
        return A.aggregate(rows, "events", [f"createdAt:{bucket}", "collection"], limit=500).withColumn("k0", F.date_format("k0", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT collection AS k0, count(DISTINCT did) AS \"count\" FROM r WHERE deleted_at IS NULL GROUP BY 1 ORDER BY 2 DESC, 1")
def agg_count_distinct(t: Tables) -> DataFrame:
    return A.aggregate(t.records, "records", ["collection"], "count_distinct:did")


@query("SELECT json_extract_string(record, '$.content.\"$type\"') AS k0, count(*) AS \"count\" FROM r WHERE deleted_at IS NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
def agg_json_path(t: Tables) -> DataFrame:
    return A.aggregate(t.records, "records", ["record.content.$type"])


@query("SELECT target_collection AS k0, path AS k1, count(*) AS \"count\" FROM l JOIN r ON r.id = l.record_id WHERE r.deleted_at IS NULL GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 100")
def agg_links_by_target_collection(t: Tables) -> DataFrame:
    rows = A.joined_source("links", t.records, links=t.links)
    return A.aggregate(rows, "links", ["targetCollection", "path"])


@query("SELECT count(*) AS \"count\" FROM r WHERE collection IN ('site.standard.document', 'site.standard.publication')")
def agg_total(t: Tables) -> DataFrame:
    return A.aggregate(t.records, "records", where={"collection": {"in": [DOCUMENT, PUBLICATION]}}, include_deleted=True)


for _field, _column in (("embedStatus", "embed_status"), ("did", "did"), ("collection", "collection")):

    @query(f"SELECT {_column} AS value, count(*) AS \"count\" FROM r WHERE deleted_at IS NULL GROUP BY 1 ORDER BY 2 DESC, 1 NULLS LAST LIMIT 20", f"facet_{_column}")
    def _facet(t: Tables, field: str = _field) -> DataFrame:
        return A.facets(RC.filtered(t.records), [field])[field]


@query("SELECT did, collection, count(*) AS \"count\", count(deleted_at) AS deleted FROM r GROUP BY ALL")
def footprint_counts(t: Tables) -> DataFrame:
    return A.footprint(t.records)


@query("SELECT count(*) FILTER (WHERE embed_status = 'pending') AS pending, count(*) FILTER (WHERE embed_status = 'failed') AS failed FROM r")
def queue_gauges(t: Tables) -> DataFrame:
    return A.queue_gauges(t.records)


@query(
    """, w AS (SELECT collection, count(DISTINCT did) AS repos_seen, count(DISTINCT CASE WHEN live THEN did END) AS repos_live,
  count(*) FILTER (WHERE created_at > TIMESTAMPTZ '2025-12-20 00:00:00+00' - INTERVAL 3600 SECOND AND NOT live) AS recent_backfill FROM e GROUP BY 1),
h AS (SELECT collection, count(*) FILTER (WHERE deleted_at IS NULL) AS records_live, count(*) AS records FROM r GROUP BY 1)
SELECT collection, coalesce(repos_seen, 0) AS repos_seen, coalesce(repos_live, 0) AS repos_live, coalesce(recent_backfill, 0) AS recent_backfill, coalesce(records_live, 0) AS records_live,
  coalesce(records, 0) AS records, round(coalesce(recent_backfill, 0) / 3600.0::DOUBLE, 2) AS rate, round(coalesce(recent_backfill, 0) / 3600.0::DOUBLE, 2) > 0 AS backfilling FROM w FULL JOIN h USING (collection)"""
)
def progress(t: Tables) -> DataFrame:
    rows = A.progress(t.events, t.records, dt.datetime(2025, 12, 20, tzinfo=dt.timezone.utc), 99999)
    return rows.select("collection", "repos_seen", "repos_live", "recent_backfill", "records_live", "records", "rate", "backfilling")


# --- derived tables

_TREE = "SELECT r.id AS record_id, r.collection, r.deleted_at, t.* FROM r, json_tree(r.record) AS t"
_PATH = "regexp_replace(regexp_replace(substr({0}, 3), '\\[[0-9]+\\]', '[]', 'g'), '\"', '', 'g')"
_TYPES = f", types AS (SELECT DISTINCT record_id, collection, deleted_at, {_PATH.format('fullkey')} AS path, json_extract_string(value, '$') AS nsid FROM ({_TREE}) WHERE key = '$type' AND type = 'VARCHAR'),\nt AS (SELECT * FROM types WHERE regexp_full_match(nsid, '[a-z][a-z0-9-]*(\\.[a-z0-9-]+)+(\\.[a-zA-Z][a-zA-Z0-9]*)'))\n"


@query(_TYPES + "SELECT record_id, path, nsid FROM t")
def extract_types(t: Tables) -> DataFrame:
    return D.extract_types(t.records)


@query(_TYPES + "SELECT path, nsid, count(*) AS \"count\" FROM t WHERE deleted_at IS NULL GROUP BY ALL")
def type_inventory(t: Tables) -> DataFrame:
    return A.type_inventory(D.extract_types(t.records), t.records)


@query(_TYPES + "SELECT path, collection, count(*) AS \"count\" FROM t WHERE deleted_at IS NULL AND nsid = 'blog.quire.text' GROUP BY ALL")
def type_usage(t: Tables) -> DataFrame:
    return A.type_usage(D.extract_types(t.records), t.records, "blog.quire.text")


@query(_TYPES + "SELECT c.nsid, count(*) AS \"count\" FROM t p JOIN t c ON p.record_id = c.record_id AND p.path <> c.path AND starts_with(c.path, regexp_replace(p.path, '\\.?\\$type$', '')) WHERE p.nsid = 'blog.quire.content' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def observed_members(t: Tables) -> DataFrame:
    return A.observed_members(D.extract_types(t.records), "blog.quire.content")


_LINKS = f", v AS (SELECT record_id, {_PATH.format('fullkey')} AS path, key, json_extract_string(value, '$') AS s FROM ({_TREE}) WHERE type = 'VARCHAR'),\nx AS (SELECT DISTINCT record_id, path, s AS target_uri, regexp_extract(s, '^at://(did:[a-z0-9]+:[a-zA-Z0-9._:%-]+)/([a-zA-Z0-9.-]+)/([a-zA-Z0-9._~:-]+)$', ['d', 'c', 'k']) AS m FROM v WHERE key IS DISTINCT FROM '$type')\n"


@query(_LINKS + "SELECT record_id, path, target_uri, CASE WHEN m.d <> '' THEN m.d ELSE target_uri END AS target_did, nullif(m.c, '') AS target_collection, nullif(m.k, '') AS target_rkey FROM x WHERE m.d <> '' OR regexp_full_match(target_uri, 'did:(plc|web):[a-zA-Z0-9._:%-]+')")
def extract_links(t: Tables) -> DataFrame:
    return D.extract_links(t.records)


@query("SELECT id, substr(lower(split_part(coalesce(json_extract_string(record, '$.langs[0]'), json_extract_string(record, '$.lang')), '-', 1)), 1, 20) AS lang FROM r WHERE coalesce(json_extract_string(record, '$.langs[0]'), json_extract_string(record, '$.lang')) <> ''")
def lang_norm(t: Tables) -> DataFrame:
    return t.records.select("id", D.record_language(F.col("record")).alias("lang")).filter("lang is not null")


_EXTRACTION = {DOCUMENT: D.Extraction(["title"], ["description"], ["content"]), PUBLICATION: D.Extraction(["name"], ["description"], [])}


_BLANK = "^[\\s\\pZ\\x{feff}]+|[\\s\\pZ\\x{feff}]+$"


def _trim_sql(text: str) -> str:
    return f"regexp_replace({text}, '{_BLANK}', '', 'g')"


def _strip_sql(html: str) -> str:
    """Markup rules in SQL; RE2 has no back-references, so scripts and styles go one after the other."""
    for pattern, by in (("(?is)<script.*?</script>|<style.*?</style>", " "), ("<[^>]+>", " "), ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("&#?\\w+;", " "), ("[\\s\\pZ\\x{feff}]+", " ")):
        html = f"regexp_replace({html}, '{pattern}', '{by}', 'g')"
    return _trim_sql(html)


_HIDDEN = "|".join(sorted(D.NON_PROSE_KEYS))
_PROSE = ", ".join(f"'{k}'" for k in sorted(D.PROSE_KEYS))
def _flat(name: str) -> str:
    return f"CASE WHEN json_type(record, '$.{name}') = 'VARCHAR' THEN {_trim_sql(f"json_extract_string(record, '$.{name}')")} END"


def _joined(a: str, b: str) -> str:
    return f"nullif(concat_ws(chr(10) || chr(10), nullif({a}, ''), nullif({b}, '')), '')"


@query(
    f""", rich AS (SELECT record_id, string_agg(CASE WHEN key = 'html' THEN {_strip_sql('s')} ELSE {_trim_sql('s')} END, chr(10) || chr(10) ORDER BY n) AS prose FROM
  (SELECT r.id AS record_id, t.key, t.id AS n, t.fullkey, json_extract_string(t.value, '$') AS s FROM r, json_tree(r.record) AS t
   WHERE r.collection = '{DOCUMENT}' AND t.type = 'VARCHAR' AND t.key IN ({_PROSE}) AND regexp_matches(t.fullkey, '^\\$\\.content[.\\[]')
     AND NOT regexp_matches(t.fullkey, '\\.("\\$type"|{_HIDDEN})([.\\[]|$)')) WHERE {_trim_sql('s')} <> '' GROUP BY 1)
SELECT r.id AS record_id, nullif(CASE WHEN collection = '{DOCUMENT}' THEN {_flat('title')} WHEN collection = '{PUBLICATION}' THEN {_flat('name')} END, '') AS title,
  CASE WHEN collection = '{DOCUMENT}' THEN {_joined(_flat('description'), _trim_sql('prose'))} WHEN collection = '{PUBLICATION}' THEN nullif({_flat('description')}, '') END AS text
FROM r LEFT JOIN rich ON rich.record_id = r.id WHERE r.record IS NOT NULL"""
)
def extract_documents(t: Tables) -> DataFrame:
    """Title and text of every record by its collection's fields."""
    return D.extract_documents(t.records, _EXTRACTION)


def _last(pattern: str) -> str:
    """The last place of ``pattern`` in the window ``w``, or -1."""
    return f"CASE WHEN regexp_matches(w, '(?s){pattern}') THEN length(regexp_extract(w, '(?s)^(.*){pattern}', 1)) ELSE -1 END"


_STOPS = [(_last(r"\n\n"), 0), (_last(r"[.][ \n]"), 1), (_last(" "), 0)]
_CUT = "CASE " + " ".join(f"WHEN {place} > 900 THEN {place} + {more}" for place, more in _STOPS) + " ELSE length(w) END"


@query(
    f"""WITH RECURSIVE t AS (SELECT DISTINCT id, {_trim_sql('extracted_text')} AS x FROM records),
c AS (SELECT id, x, 0 AS k, 0 AS o, substr(x, 1, 1800) AS w FROM t WHERE x <> ''
  UNION ALL SELECT id, x, k + 1, o + greatest(s - 200, 1), substr(x, o + greatest(s - 200, 1) + 1, 1800) FROM (SELECT c.*, {_CUT} AS s FROM c WHERE o + 1800 < length(x)))
SELECT id AS record_id, CAST(row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS INTEGER) AS chunk_index, p AS chunk_text
FROM (SELECT id, k, {_trim_sql(f'substr(w, 1, CASE WHEN o + 1800 < length(x) THEN {_CUT} ELSE 1800 END)')} AS p FROM c) WHERE p <> ''"""
)
def chunk_text(t: Tables) -> DataFrame:
    return D.extract_chunks(t.records.select(F.col("id").alias("record_id"), F.col("extracted_text").alias("text")))


#: Markup put into plain texts: (what, by what).
_MADE = [("&", "&AMP;"), ("<", "&lt;"), ("\n", "<br/>"), (", ", ",&nbsp;"), (". ", ".&amp;lt;i&amp;gt; &eacute;<script>x < y</script> ")]


def _made_sql(text: str) -> str:
    for what, by in _MADE:
        text = f"replace({text}, {'chr(10)' if what == chr(10) else repr(what)}, '{by}')"
    return f"'<p class=\"x\">' || {text} || '</p>'"


@query("SELECT doc_id, " + _strip_sql("html") + " AS plain FROM (SELECT doc_id, " + _made_sql("text") + " AS html FROM documents)")
def strip_html_text(t: Tables) -> DataFrame:
    """Every document's text, first made into markup with entities, tags and scripts, stripped again;
    null for a null text."""
    html = F.col("text")
    for what, by in _MADE:
        html = F.replace(html, F.lit(what), F.lit(by))
    docs = table(t.spark, t.base, "documents")
    return docs.select("doc_id", strip_html(F.concat(F.lit('<p class="x">'), html, F.lit("</p>"))).alias("plain"))


# --- records plane

_PUBLIC = "id, uri, cid"


def _ids(df: DataFrame) -> DataFrame:
    return df.select("id", "uri", "cid")


@query(f"SELECT {_PUBLIC} FROM r WHERE uri = (SELECT min(uri) FROM r WHERE collection = 'site.standard.document' AND deleted_at IS NULL) AND deleted_at IS NULL")
def get_record(t: Tables) -> DataFrame:
    uri = RC.filtered(t.records, DOCUMENT).agg(F.min("uri")).first()[0]
    RC.get_record(t.records, DOCUMENT, uri)
    return _ids(t.records.filter((F.col("uri") == uri) & F.col("deleted_at").isNull()))


@query("SELECT count(*) AS \"count\" FROM r WHERE deleted_at IS NULL AND collection = 'site.standard.document' AND record IS NOT NULL AND json_extract_string(record, '$.title') IS NOT NULL AND json_type(record, '$.content') = 'OBJECT' AND json_extract_string(record, '$.content.\"$type\"') = 'blog.quire.content'")
def count_records(t: Tables) -> DataFrame:
    return RC.count_records(t.records.filter(D.extract_text(F.col("record"), "title").isNotNull()), DOCUMENT, {"content.$type": {"eq": "blog.quire.content"}})


_WHERES = {
    "where_eq_column": ({"embedStatus": {"eq": "pending"}}, "embed_status = 'pending'"),
    "where_neq_column": ({"cid": {"neq": "x"}, "rev": {"neq": "y"}}, "cid IS DISTINCT FROM 'x' AND rev IS DISTINCT FROM 'y'"),
    "where_in_column": ({"embedStatus": {"in": ["failed", "skipped"]}, "cold": {"eq": False}}, "embed_status IN ('failed', 'skipped') AND coalesce(CAST(cold AS VARCHAR) = 'false', false)"),
    "where_nin_column": ({"embedStatus": {"nin": ["done", "pending"]}}, "coalesce(embed_status NOT IN ('done', 'pending'), true)"),
    "where_contains_column": ({"uri": {"contains": "WEB:"}}, "uri ILIKE '%web:%'"),
    "where_neq_path": ({"content.$type": {"neq": "blog.quire.content"}}, "NOT coalesce(json_contains(record, '{\"content\":{\"$type\":\"blog.quire.content\"}}'), false)"),
    "where_in_path": ({"langs": {"in": [["fr"], ["de"]]}}, "coalesce(json_type(record, '$.langs') = 'ARRAY' AND (json_contains(record, '{\"langs\":[\"fr\"]}') OR json_contains(record, '{\"langs\":[\"de\"]}')), false)"),
    "where_nin_path": ({"prefs.notify": {"nin": [True, None]}}, "NOT coalesce(json_extract(record, '$.prefs.notify')::VARCHAR IN ('true', 'null'), false)"),
    "where_contains_path": ({"title": {"contains": "ARCHIVE"}}, "coalesce(json_extract_string(record, '$.title') ILIKE '%archive%', false)"),
    "where_json_text": ({"json": {"contains": "blog.quire.image"}}, "coalesce(raw ILIKE '%blog.quire.image%', false)"),
}
for _name, (_where, _sql) in _WHERES.items():

    @query(f"SELECT {_PUBLIC} FROM r WHERE deleted_at IS NULL AND {_sql}", _name)
    def _filtered(t: Tables, where: dict = _where) -> DataFrame:
        return _ids(RC.filtered(t.records, where=where))


_TITLED = "json_type(record, '$.title') = 'VARCHAR'"


@query(f"SELECT {_PUBLIC} FROM r WHERE deleted_at IS NULL AND {_TITLED} AND json_extract_string(record, '$.title') = (SELECT json_extract_string(record, '$.title') FROM r WHERE {_TITLED} AND json_extract_string(record, '$.title') <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
def where_eq_path(t: Tables) -> DataFrame:
    titles = D.extract_text(F.when(F.schema_of_variant(F.try_variant_get(F.try_parse_json("record"), "$.title", "variant")) == "STRING", F.col("record")), "title")
    title = t.commonest(t.records.select(titles.alias("title")).filter("title <> ''"), "title")
    return _ids(RC.filtered(t.records, where={"title": {"eq": title}}))


@query(f"SELECT {_PUBLIC} FROM r WHERE deleted_at IS NULL AND collection = 'site.standard.document' ORDER BY cid ASC NULLS LAST, rkey DESC NULLS FIRST, id DESC LIMIT 100 OFFSET 50")
def sort_paging_offset(t: Tables) -> DataFrame:
    return _ids(RC.get_records(t.records, DOCUMENT, sort_by=[{"field": "cid"}, {"field": "rkey", "direction": "desc"}], limit=100, cursor="50"))


@query(f"SELECT {_PUBLIC} FROM r ORDER BY json_extract_string(record, '$.title') DESC NULLS FIRST, id DESC LIMIT 100")
def sort_json_path(t: Tables) -> DataFrame:
    return _ids(t.records.orderBy(*compile_sort([{"field": "title", "direction": "desc"}])).limit(100))


# --- fold

@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT id, did, collection, rkey, action, cid, nullif(rev, '') AS rev FROM change_events WHERE event_type = 'record'),
n AS (SELECT *, row_number() OVER (PARTITION BY did, collection, rkey ORDER BY id) AS k FROM e),
s AS (SELECT did, collection, rkey, k, action, CASE WHEN action <> 'delete' THEN cid END AS cid, rev FROM n WHERE k = 1
  UNION ALL
  SELECT n.did, n.collection, n.rkey, n.k, CASE WHEN v THEN n.action ELSE s.action END, CASE WHEN v AND n.action <> 'delete' THEN n.cid ELSE s.cid END, CASE WHEN v THEN n.rev ELSE s.rev END
  FROM s JOIN n ON n.did = s.did AND n.collection = s.collection AND n.rkey = s.rkey AND n.k = s.k + 1, LATERAL (SELECT n.rev IS NULL OR s.rev IS NULL OR n.rev > s.rev AS v))
SELECT did, collection, rkey, 'at://' || did || '/' || collection || '/' || rkey AS uri, cid, rev, action = 'delete' AS deleted FROM s QUALIFY row_number() OVER (PARTITION BY did, collection, rkey ORDER BY k DESC) = 1"""
)
def latest_state_fold(t: Tables) -> DataFrame:
    raw = table(t.spark, t.base, "change_events").filter("event_type = 'record'")
    return AR.fold(raw).select("did", "collection", "rkey", "uri", "cid", "rev", F.col("deleted_at").isNotNull().alias("deleted"))


# --- graph

def _star(t: Tables) -> str:
    return t.commonest(t.links, "target_uri")


def _fan(t: Tables) -> str:
    return t.commonest(RC.filtered(t.records, SUBSCRIPTION), "did")


_EDGE = "l.id, r.uri AS source_uri, r.did, r.collection, l.path"


@query(f"SELECT {_EDGE} FROM l JOIN r ON r.id = l.record_id WHERE r.deleted_at IS NULL AND (l.target_uri = (SELECT v FROM star) OR l.target_did = (SELECT v FROM star)) ORDER BY l.id LIMIT 200")
def backlinks(t: Tables) -> DataFrame:
    return G.backlinks(t.links, t.records, _star(t))


@query(", top AS (SELECT uri FROM r JOIN l ON r.id = l.record_id GROUP BY uri ORDER BY count(*) DESC, uri LIMIT 1)\nSELECT path, target_uri, target_did, target_collection, target_rkey FROM l WHERE record_id IN (SELECT id FROM r WHERE uri = (SELECT uri FROM top))")
def outlinks(t: Tables) -> DataFrame:
    uri = t.commonest(t.links.join(t.records.withColumnRenamed("id", "record_id"), "record_id"), "uri")
    return G.out_links(t.links, t.records, uri)


@query("SELECT id, uri, cid FROM r WHERE deleted_at IS NULL AND id IN (SELECT record_id FROM l WHERE path = 'publication' AND target_uri = (SELECT v FROM star))")
def link_filter(t: Tables) -> DataFrame:
    return _ids(G.linking_to(RC.filtered(t.records), t.links, {"publication": _star(t)}))


_FOLLOWED = "SELECT f.target_uri FROM l f JOIN r s ON s.id = f.record_id WHERE f.path = 'publication' AND s.deleted_at IS NULL AND s.collection = 'site.standard.graph.subscription' AND s.did = (SELECT v FROM fan)"


@query(f"SELECT id, uri, cid FROM r WHERE deleted_at IS NULL AND collection = 'site.standard.document' AND id IN (SELECT record_id FROM l WHERE target_uri IN ({_FOLLOWED}))")
def following_feed(t: Tables) -> DataFrame:
    return _ids(G.following_feed(RC.filtered(t.records, DOCUMENT), t.links, t.records, f"following:{_fan(t)}"))


@query("SELECT DISTINCT r.did FROM l JOIN r ON r.id = l.record_id WHERE r.deleted_at IS NULL AND l.target_uri = (SELECT v FROM star) AND l.path = 'publication'")
def audience_backlink(t: Tables) -> DataFrame:
    return G.members({"kind": "backlink", "target": _star(t), "path": "publication"}, t.records, t.links)


@query("SELECT DISTINCT l.target_did AS did FROM l JOIN r ON r.id = l.record_id WHERE r.deleted_at IS NULL AND l.target_did IS NOT NULL AND r.did = (SELECT v FROM fan)")
def audience_outlink(t: Tables) -> DataFrame:
    return G.members({"kind": "outlink", "did": _fan(t)}, t.records, t.links)


@query("SELECT DISTINCT did FROM r WHERE deleted_at IS NULL AND collection = 'site.standard.document' AND coalesce(json_contains(record, '{\"content\":{\"$type\":\"blog.quire.content\"}}'), false)")
def audience_collection(t: Tables) -> DataFrame:
    return G.members({"kind": "collection", "collection": DOCUMENT, "matchers": {"content.$type": "blog.quire.content"}}, t.records, t.links)


@query("SELECT did, collection, count(*) AS \"count\" FROM r WHERE did IN (SELECT v FROM fan) GROUP BY ALL")
def audience_static(t: Tables) -> DataFrame:
    fan = _fan(t)
    return G.in_audience(t.records, {"kind": "static", "dids": [fan, fan]}, t.records, t.links).groupBy("did", "collection").agg(F.count("*").alias("count"))


# --- ranking

_SPECS = (RK.Link(SUBSCRIPTION, "publication", 2.0), RK.Link(RECOMMEND, "document", 1.0))
_PROFILE = RK.Profile("engaged", (RK.Signal("interactions", 1.5, _SPECS, "log1p"), RK.Signal("recency", 3.0, field="indexedAt", half_life_hours=720.0))).check()
_ROLLUP = "i AS (SELECT l.target_uri, concat_ws(':', r.collection, l.path) AS kind, count(*) AS n FROM l JOIN r ON r.id = l.record_id WHERE r.deleted_at IS NULL AND ((r.collection = 'site.standard.graph.subscription' AND l.path = 'publication') OR (r.collection = 'site.standard.graph.recommend' AND l.path = 'document')) GROUP BY ALL)"
_SCORED = f""", {_ROLLUP},
c AS (SELECT target_uri, sum(CASE WHEN kind = 'site.standard.graph.subscription:publication' THEN 2.0::DOUBLE * n ELSE 1.0::DOUBLE * n END) AS x FROM i GROUP BY 1),
s AS (SELECT r.*, 1.5::DOUBLE * ln(1 + coalesce(c.x, 0.0::DOUBLE)) + 3.0::DOUBLE * exp(-ln(2.0::DOUBLE) * ((epoch_us(TIMESTAMPTZ '2026-01-01 00:00:00+00') - epoch_us(r.indexed_at)) / 3.6e9::DOUBLE) / 720.0::DOUBLE) AS score
  FROM r LEFT JOIN c ON c.target_uri = r.uri WHERE r.deleted_at IS NULL)
"""


@query(f", {_ROLLUP}\nSELECT target_uri, kind, n AS \"count\" FROM i")
def interaction_rollup(t: Tables) -> DataFrame:
    return RK.rollup(t.links, t.records, _SPECS)


def _ranked(t: Tables, **more) -> DataFrame:  # noqa: ANN003
    return RK.ranked_page(RC.filtered(t.records), _PROFILE, RK.rollup(t.links, t.records, _SPECS), NOW, limit=100, **more)


@query(_SCORED + "SELECT id, uri, round(score, 6) AS score FROM s ORDER BY s.score DESC, id DESC LIMIT 100")
def rank_linear(t: Tables) -> DataFrame:
    return _ranked(t).select("id", "uri", F.round("score", 6).alias("score"))


@query(_SCORED + "SELECT id, uri, round(score, 6) AS score FROM s ORDER BY s.score DESC, id DESC LIMIT 100 OFFSET 100")
def rank_page2(t: Tables) -> DataFrame:
    first = _ranked(t).select("score", "id").collect()
    return _ranked(t, cursor=RK.next_cursor(first, NOW)).select("id", "uri", F.round("score", 6).alias("score"))


@query(_SCORED + f"SELECT uri, id, round(score, 6) AS score FROM s WHERE collection = 'site.standard.document' AND id IN (SELECT record_id FROM l WHERE target_uri IN ({_FOLLOWED})) ORDER BY s.score DESC, id DESC LIMIT 50")
def ranked_feed(t: Tables) -> DataFrame:
    counts = RK.rollup(t.links, t.records, _SPECS)
    feed = G.ranked_feed(t.records, t.links, counts, NOW, _PROFILE, DOCUMENT, feed=f"following:{_fan(t)}")
    return feed.select("uri", "id", F.round("score", 6).alias("score"))


# --- search

_TERMS = "regexp_extract_all(lower(left(coalesce({0}, ''), 200000)), '[\\pL\\pN]+')"
_STEM = "CASE WHEN regexp_matches(w, '[^ea]ies$') THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '[^aeo]es$') THEN regexp_replace(w, 's$', '') WHEN regexp_matches(w, '.[^us]s$') THEN regexp_replace(w, 's$', '') ELSE w END"
_STOPS = ", ".join(f"'{w}'" for w in S.STOP_WORDS)
_ENGLISH = f"list_transform(list_filter({_TERMS}, lambda w: w NOT IN ({_STOPS})), lambda w: {_STEM})"
_ANALYZED = ", ".join(f"'{k}'" for k, v in S.ANALYZERS.items() if v == "english")
_SEARCHABLE = f", q AS (SELECT *, CASE WHEN lang IS NULL OR lower(lang) IN ({_ANALYZED}) THEN {_ENGLISH.format('extracted_title')} ELSE {_TERMS.format('extracted_title')} END AS a, CASE WHEN lang IS NULL OR lower(lang) IN ({_ANALYZED}) THEN {_ENGLISH.format('extracted_text')} ELSE {_TERMS.format('extracted_text')} END AS c FROM r WHERE deleted_at IS NULL)"
_TF = "(1.0::DOUBLE * len(list_filter(a, lambda x: x = '{0}')) + 0.2::DOUBLE * len(list_filter(c, lambda x: x = '{0}')))"
_RANK = " + ".join(f"{_TF.format(w)} / ({_TF.format(w)} + 1.2::DOUBLE)" for w in S.parse_query(WORDS).words())
_MATCH = " AND ".join(f"(list_contains(a, '{w}') OR list_contains(c, '{w}'))" for w in S.parse_query(WORDS).words())
_WARM = "NOT coalesce(cold, false)"


@query(f"{_SEARCHABLE}\nSELECT id, uri, cid FROM q WHERE {_MATCH}")
def fts_and_match(t: Tables) -> DataFrame:
    query_ = S.parse_query(WORDS)
    return _ids(S.searchable(RC.filtered(t.records)).filter(S.matches(query_)))


@query(f"{_SEARCHABLE}\nSELECT id, uri, round({_RANK}, 9) AS rank FROM q WHERE {_MATCH} AND {_WARM} ORDER BY {_RANK} DESC, id DESC LIMIT 50")
def fts_rank(t: Tables) -> DataFrame:
    return S.keyword_search(t.records, WORDS).select("id", "uri", F.round("rank", 9).alias("rank"))


def _phrase_sql(words: list[str]) -> str:
    one = "list_bool_or(list_transform(range(1, len({0}) - {1} + 2), lambda i: list_slice({0}, i, i + {1} - 1) = {2}))"
    wanted = "[" + ", ".join(f"'{w}'" for w in words) + "]"
    return "(" + " OR ".join(f"coalesce({one.format(c, len(words), wanted)}, false)" for c in ("a", "c")) + ")"


_PARSED = S.parse_query(PHRASE)
_PHRASES = " AND ".join(["(" + " OR ".join(_phrase_sql(p) for p in g) + ")" for g in _PARSED.groups] + [f"NOT {_phrase_sql(p)}" for p in _PARSED.excluded])


@query(f"{_SEARCHABLE}\nSELECT id, uri, cid FROM q WHERE {_PHRASES}")
def fts_phrase_or_not(t: Tables) -> DataFrame:
    return _ids(S.matching(RC.filtered(t.records), _PARSED))


@query(f"{_SEARCHABLE}\nSELECT collection AS value, count(*) AS \"count\" FROM q WHERE {_MATCH} AND {_WARM} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def cold_hidden_search(t: Tables) -> DataFrame:
    """Facets of a keyword search's matches, cold records hidden."""
    query_ = S.parse_query(WORDS)
    matched = S.searchable(RC.filtered(t.records, exclude_cold=True)).filter(S.matches(query_))
    return A.facets(matched, ["collection"])["collection"]


@query(f"{_SEARCHABLE}, p AS (SELECT id, 'a' AS f, unnest(a) AS term FROM q UNION ALL SELECT id, 'c', unnest(c) FROM q)\nSELECT term, count(DISTINCT id) AS documents, count(*) FILTER (WHERE f = 'a') AS title_tf, count(*) FILTER (WHERE f = 'c') AS text_tf FROM p GROUP BY 1")
def inverted_index_terms(t: Tables) -> DataFrame:
    """Terms of the inverted index with their document and term frequencies."""
    posted = S.postings(S.searchable(RC.filtered(t.records)))
    return posted.groupBy("term").agg(F.count("*").alias("documents"), F.sum("title_tf").alias("title_tf"), F.sum("text_tf").alias("text_tf"))


@query()
def highlight(t: Tables) -> DataFrame:
    return S.highlighted(S.keyword_search(t.records, WORDS), WORDS).select("id", "uri", "highlight")


_USABLE = "m AS (SELECT id, record_id, CAST(embedding AS DOUBLE[]) AS v FROM (SELECT id, first(record_id) AS record_id, first(embedding) AS embedding FROM record_embeddings GROUP BY id) WHERE len(embedding) = 768 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)))"
_QV = "qv AS (SELECT v AS q FROM m ORDER BY id LIMIT 1)"
_NEAR = f"{_USABLE}, {_QV}, d AS (SELECT id, record_id, list_cosine_distance(v, q) AS distance FROM m, qv)"
_BEST = "b AS (SELECT record_id, min(distance) AS distance FROM (SELECT * FROM d ORDER BY distance, id LIMIT 100) GROUP BY 1)"


def _query_vector(t: Tables) -> list[float]:
    from vellumine.operators.search import chunk_distances

    usable = chunk_distances(t.chunks.filter(F.size("embedding") == 768), [1.0] * 768)
    first = usable.agg(F.min("id")).first()[0]
    return t.chunks.filter(F.col("id") == first).first()["embedding"]


@query(f", {_NEAR}\nSELECT id, record_id, round(distance, 6) AS distance FROM d ORDER BY d.distance, id LIMIT 10")
def knn_top10(t: Tables) -> DataFrame:
    near = S.chunk_distances(t.chunks, _query_vector(t))
    return near.orderBy("distance", "id").limit(10).select("id", "record_id", F.round("distance", 6).alias("distance"))


@query(f", {_NEAR}, {_BEST}\nSELECT r.id, r.uri, round(b.distance, 6) AS distance FROM b JOIN r ON r.id = b.record_id WHERE r.deleted_at IS NULL ORDER BY b.distance, r.id DESC LIMIT 50")
def knn_best_chunk(t: Tables) -> DataFrame:
    return S.semantic_search(t.records, t.chunks, _query_vector(t)).select("id", "uri", F.round("distance", 6).alias("distance"))


@query(
    f"""{_SEARCHABLE}, {_NEAR}, {_BEST},
f AS (SELECT id, row_number() OVER (ORDER BY k DESC, id DESC) AS n FROM (SELECT id, {_RANK} AS k FROM q WHERE {_MATCH} ORDER BY 2 DESC, 1 DESC LIMIT 100)),
g AS (SELECT r.id, row_number() OVER (ORDER BY b.distance, r.id DESC) AS n FROM b JOIN r ON r.id = b.record_id WHERE r.deleted_at IS NULL),
u AS (SELECT coalesce(f.id, g.id) AS id, coalesce(1.0::DOUBLE / (60.0::DOUBLE + f.n), 0.0::DOUBLE) + coalesce(1.0::DOUBLE / (60.0::DOUBLE + g.n), 0.0::DOUBLE) AS s FROM f FULL JOIN g ON f.id = g.id)
SELECT r.id, r.uri, round(u.s, 9) AS score FROM u JOIN r ON r.id = u.id ORDER BY u.s DESC, r.id DESC LIMIT 50"""
)
def hybrid_rrf(t: Tables) -> DataFrame:
    return S.hybrid_search(t.records, t.chunks, WORDS, _query_vector(t)).select("id", "uri", F.round("score", 9).alias("score"))


# --- lists

@query("SELECT e.id, e.did, e.collection, e.rkey, e.action FROM e WHERE e.did NOT IN (SELECT did FROM did_pds WHERE pds ILIKE 'https://pds1.%')")
def glob_block(t: Tables) -> DataFrame:
    return AR.blocked(t.events, hosts=t.hosts, globs=[GLOB]).select("id", "did", "collection", "rkey", "action")


@query("SELECT r.id, CASE WHEN h.did IS NOT NULL THEN 'skipped' WHEN coalesce(r.cold, false) AND r.deleted_at IS NULL THEN 'pending' ELSE r.embed_status END AS embed_status, h.did IS NOT NULL AS cold FROM r LEFT JOIN (SELECT DISTINCT did FROM did_pds WHERE pds ILIKE 'https://pds1.%') h ON h.did = r.did")
def cold_lists(t: Tables) -> DataFrame:
    return AR.cooled(t.records, hosts=t.hosts, globs=[GLOB]).select("id", "embed_status", "cold")


@query("SELECT did, regexp_matches(coalesce(pds, ''), '^https://pds1\\..*$') AS listed FROM did_pds")
def host_decisions(t: Tables) -> DataFrame:
    return t.hosts.select("did", matches_any_glob(F.col("pds"), [GLOB]).alias("listed"))
