"""Deeply nested JSON records as flat, linked tables (problem 1)."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.functions.batches import by_batch
from vellumine.operators import structural


def json_nodes(records: DataFrame, id_column: str, json_column: str, fields: bool = False) -> DataFrame:
    """One row for each object in the JSON texts: ``record_id, node_path, parent_path, table_path,
    place`` and, if asked for, ``fields``.

    ``node_path`` joins keys by ``.`` and marks list positions from 0 as ``[i]``; the root object
    has an empty ``node_path`` and a null ``parent_path``; ``parent_path`` is the nearest enclosing
    object's path (empty for the root, also where the body is a list).  ``table_path`` is
    ``node_path`` with positions blanked: rows alike in it form one flat table.  ``place`` is the
    position in the enclosing list.  ``fields`` maps the scalar members that belong to the object,
    those in lists of scalars included, from their path below it to their text (JSON null to null);
    of repeated keys the last counts.

    A string, or a whole body, that holds a valid JSON object or array counts as that value.  Null,
    empty and unreadable texts give no rows.  Repeated rows give repeated nodes.  A null id stays
    null.  Texts of any length and depth are read whole.  No column but the two is read.
    """
    kind = records.schema[id_column].dataType
    schema = T.StructType(
        [
            T.StructField("record_id", kind),
            T.StructField("node_path", T.StringType()),
            T.StructField("parent_path", T.StringType()),
            T.StructField("place", T.LongType()),
        ]
        + ([T.StructField("fields", T.MapType(T.StringType(), T.StringType()))] if fields else [])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies = batch.column(0), batch.column(1)
            texts = [b"" if t is None else t for t in bodies.cast(pa.large_binary()).to_pylist()]
            which, own, up, place, inner = [], [], [], [], []
            for number, path, outer, where, members in structural.nodes(texts, fields):
                which.append(number)
                own.append(path)
                up.append(outer)
                place.append(where)
                if fields:
                    inner.append(list(dict(members).items()))
            columns = [ids.take(pa.array(which, pa.int64())), pa.array(own, pa.string()), pa.array(up, pa.string()), pa.array(place, pa.int64())]
            if fields:
                columns.append(pa.array(inner, pa.map_(pa.string(), pa.string())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    readable = records.select(F.col(id_column).alias("record_id"), F.col(json_column).alias("_body")).filter(F.col("_body").isNotNull() & (F.col("_body") != ""))
    out = by_batch(readable, run, schema)
    tail = ["fields"] if fields else []
    return out.select("record_id", "node_path", "parent_path", F.regexp_replace("node_path", r"\[\d+\]", "[]").alias("table_path"), "place", *tail)


def flat_table(nodes: DataFrame, table_path: str, columns: Mapping[str, str]) -> DataFrame:
    """One flat table of ``nodes`` (made with ``fields=True``): the objects at ``table_path`` with
    their links and the given typed columns (path below the object -> SQL type; a value that
    doesn't fit the type is null)."""
    picked = [F.try_element_at("fields", F.lit(name)).try_cast(kind).alias(name) for name, kind in columns.items()]
    return nodes.filter(F.col("table_path") == table_path).select("record_id", "node_path", "parent_path", "place", *picked)
