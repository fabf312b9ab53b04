"""Queries of the subpackage's operators over an archive's tables, and their SQL."""

from __future__ import annotations

import os
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm.chunking import LIMIT, OVERLAP, split_texts
from vellumine.llm.garble import garbled_texts
from vellumine.llm.knn import nearest
from vellumine.llm.langid import declared, identify, language_sets, mislabelled
from vellumine.llm.leakage import WORDS, build_index, leaked_phrases, near_passages
from vellumine.llm.neardup import duplicate_pairs, near_duplicate_groups, near_duplicates
from vellumine.llm.packing import CAPACITY, pack, token_counts
from vellumine.sources.tables import table


def _pieces(spark: SparkSession, base: str, name: str, text: str, once: bool) -> DataFrame:
    items = table(spark, base, name).select("id", text)
    items = items.dropDuplicates(["id"]) if once else items
    return split_texts(items, "id", text).withColumn("item_table", F.lit(name))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """Items that come out of the splitter in more than one piece."""
    parts = [_pieces(spark, base, n, c, False).filter("pieces > 1") for n, c in (("records", "extracted_text"), ("record_embeddings", "chunk_text"))]
    return parts[0].unionByName(parts[1]).select("item_table", "item_id").distinct()


def p2_pieces(spark: SparkSession, base: str) -> DataFrame:
    """All pieces of all items, with their place and length."""
    parts = [_pieces(spark, base, n, c, True) for n, c in (("records", "extracted_text"), ("record_embeddings", "chunk_text"))]
    out = parts[0].unionByName(parts[1])
    return out.select("item_table", "item_id", "piece", "pieces", "start", F.char_length("piece_text").alias("chars"), "piece_text")


def _segments(spark: SparkSession, base: str) -> DataFrame:
    records = table(spark, base, "records").select(
        F.col("id").alias("record_id"),
        F.col("did").alias("host"),
        "collection",
        declared(F.col("lang")).alias("label"),
        F.regexp_extract("did", r"^did:web:.*\.([a-z]{2})$", 1).alias("suffix"),
        F.col("extracted_text").alias("text"),
    )
    return identify(records)


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return mislabelled(_segments(spark, base))


def p3_segments(spark: SparkSession, base: str) -> DataFrame:
    """Every segment of every text with its language and confidence."""
    return _segments(spark, base).distinct()


def p3_texts(spark: SparkSession, base: str) -> DataFrame:
    """Every text's languages, with confidence and the number of their segments."""
    return language_sets(_segments(spark, base).distinct())


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    members, links = near_duplicates(table(spark, base, "records"), words=3, threshold=Fraction(7, 10))
    return duplicate_pairs(members, links).select(F.col("id_a").alias("record_id_a"), F.col("id_b").alias("record_id_b"))


def p6_groups(spark: SparkSession, base: str) -> DataFrame:
    """Every record's class, its number of links to other classes and its group."""
    return near_duplicate_groups(table(spark, base, "records"), words=3, threshold=Fraction(7, 10)).withColumnRenamed("id", "record_id")


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    near = nearest(table(spark, base, "record_embeddings"))
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def _tokens(spark: SparkSession, base: str) -> DataFrame:
    folder = os.environ.get("VELLUMINE_TOKENIZERS", "/opt/tokenizers")
    return token_counts(table(spark, base, "documents"), "doc_id", "text", f"{folder}/byte_bpe_50k.tiktoken")


def p8_containers(spark: SparkSession, base: str) -> DataFrame:
    """Every document's place in containers of 2,048 tokens."""
    return pack(_tokens(spark, base))


def p8_fill(spark: SparkSession, base: str) -> DataFrame:
    """Containers, tokens and the share of space used, over all containers."""
    held = pack(_tokens(spark, base)).groupBy("container").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("held"))
    return held.agg(F.count("*").alias("containers"), F.sum("held").alias("tokens"), (F.sum("held") / (F.count("*") * CAPACITY)).alias("fill"))


def p8_audit(spark: SparkSession, base: str) -> DataFrame:
    """Texts placed, containers over the capacity, and texts whose parts don't cover their tokens once."""
    placed = pack(_tokens(spark, base))
    over = placed.groupBy("container").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("held")).agg(F.count_if(F.col("held") > CAPACITY).alias("over_capacity"))
    parts = placed.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("part").alias("last"), F.sum(F.col("token_end") - F.col("token_start")).alias("held"), F.max("token_end").alias("end"))
    texts = parts.agg(F.count("*").alias("texts"), F.count_if((F.col("n") != F.col("last") + 1) | (F.col("held") != F.col("end"))).alias("not_covered"))
    return texts.withColumn("one", F.lit(1)).join(over.withColumn("one", F.lit(1)), "one").drop("one")


def p2_restored(spark: SparkSession, base: str) -> DataFrame:
    """Every item's text put together again from its pieces, and how many of them exceed the limit."""
    own = F.expr(f"struct(piece, if(piece = 0, piece_text, substring(piece_text, least({OVERLAP}, start_before - start) + 1)) AS own)")
    pieces = p2_pieces(spark, base)
    # each piece's overlap is what lies before the end of the one before it
    before = pieces.select("item_table", "item_id", (F.col("piece") + 1).alias("piece"), (F.col("start") + F.col("chars")).alias("start_before"))
    joined = pieces.join(before, ["item_table", "item_id", "piece"], "left").withColumn("own", own)
    put = joined.groupBy("item_table", "item_id").agg(F.sort_array(F.collect_list("own")).alias("o"), F.count_if(F.col("chars") > LIMIT).alias("over_limit"))
    return put.select("item_table", "item_id", F.concat_ws("", F.transform("o", lambda x: x["own"])).alias("text"), "over_limit")


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return leaked_phrases(table(spark, base, "documents"), table(spark, base, "eval_items")).select("doc_id", "item_id")


def p9_near(spark: SparkSession, base: str) -> DataFrame:
    return near_passages(build_index(table(spark, base, "documents").select("doc_id", "text")), table(spark, base, "eval_items"))


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return garbled_texts(table(spark, base, "documents")).select("doc_id").distinct()


def p10_restored(spark: SparkSession, base: str) -> DataFrame:
    """The garbled documents' spans and texts put right."""
    return garbled_texts(table(spark, base, "documents"))


_RUNS = [p2_found, p2_pieces, p2_restored, p3_found, p3_segments, p3_texts, p6_found, p6_groups, p7_found, p8_containers, p8_fill, p8_audit, p9_found, p9_near, p10_found, p10_restored]
QUERIES = {f.__name__: f for f in _RUNS}

_ITEMS = "(SELECT 'records' AS item_table, id AS item_id, extracted_text AS t FROM records UNION SELECT 'record_embeddings', id, chunk_text FROM record_embeddings)"
_STRIPPED = r"regexp_replace(t, '^[\s\pZ\x1c-\x1f\x85]+|[\s\pZ\x1c-\x1f\x85]+$', '', 'g')"
_SEQUENCES = r"""WITH t AS (SELECT DISTINCT id, regexp_extract_all(lower(CASE WHEN extracted_title <> '' THEN extracted_title || chr(10) ELSE '' END || extracted_text), '[\pL\pN]+') AS w FROM records WHERE extracted_text <> ''),
s AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) > 2)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS x, b.id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
"""
_GROUPS = _SEQUENCES.replace("WITH t", "WITH RECURSIVE t") + """, k AS (SELECT x, y, p.k = a.n AND p.k = b.n AS same FROM p JOIN n a ON a.id = x JOIN n b ON b.id = y WHERE 10 * p.k >= 7 * (a.n + b.n - p.k)),
c AS (SELECT id, least(id, coalesce((SELECT min(x) FROM k WHERE y = id AND same), id)) AS class_id FROM n),
e AS (SELECT DISTINCT a.class_id AS u, b.class_id AS v FROM (SELECT x, y FROM k UNION ALL SELECT y, x FROM k) JOIN c a ON a.id = x JOIN c b ON b.id = y WHERE a.class_id <> b.class_id),
g(u, root) AS (SELECT DISTINCT class_id, class_id FROM c UNION SELECT e.v, g.root FROM g JOIN e ON e.u = g.u)
SELECT id AS record_id, class_id, (SELECT count(*) FROM e WHERE u = class_id) AS links, (SELECT min(root) FROM g WHERE g.u = class_id) AS group_id FROM c"""
#: NFKC as far as the tables need it: canonical composition, and full-width forms of ASCII by their offset.
_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
_PLAIN = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
_NORMAL = r"regexp_extract_all(lower(regexp_replace(nfc_normalize(translate(text, '{wide}', '{plain}')), '\p{{Cf}}', '', 'g')), '[\pL\pN]+')".format(wide=_WIDE, plain=_PLAIN)
_LEAKS = f"""WITH d AS (SELECT DISTINCT doc_id, {_NORMAL} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT DISTINCT item_id, {_NORMAL} AS w FROM eval_items WHERE text IS NOT NULL),
g AS (SELECT DISTINCT item_id, array_to_string(w[k:k + {WORDS - 1}], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - {WORDS - 2})) AS k FROM i)),
h AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + {WORDS - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WORDS - 2})) AS k FROM d))
SELECT DISTINCT doc_id, item_id FROM g JOIN h USING (g)"""
ORACLE = {
    "p2_restored": f"SELECT item_table, item_id, {_STRIPPED} AS text, 0 AS over_limit FROM {_ITEMS} WHERE {_STRIPPED} <> ''",
    "p8_audit": "SELECT count(*) AS texts, 0 AS over_capacity, 0 AS not_covered FROM documents WHERE text <> ''",
    "p9_found": _LEAKS,
    "p2_found": f"SELECT item_table, item_id FROM {_ITEMS} WHERE length({_STRIPPED}) > {LIMIT}",
    "p6_groups": _GROUPS,
    "p6_found": _SEQUENCES + "SELECT x AS record_id_a, y AS record_id_b FROM p JOIN n a ON a.id = x JOIN n b ON b.id = y WHERE 10 * k >= 7 * (a.n + b.n - k)",
}
