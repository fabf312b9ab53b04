"""Embedding providers: anything with ``embed(texts) -> vectors``, applied in Arrow batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.functions.batches import by_batch
from vellumine.errors import UpstreamFailure


class Provider(Protocol):
    width: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class HashingProvider:
    """Deterministic vectors by signed feature hashing of words, for tests and offline use."""

    def __init__(self, width: int = 768) -> None:
        self.width = width

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.width), dtype=np.float32)
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = xxhash.xxh3_64_intdigest(word.encode())
                row[h % self.width] += 1.0 if h >> 63 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1, norms)).tolist()


class Retrying:
    """A provider over a transport that gives (status, [(index, vector)]): results go back into
    the order of the request, their number must match, and one retry follows a 429, a 5xx or a
    network failure."""

    def __init__(self, transport: Callable[[Sequence[str]], tuple[int, list[tuple[int, list[float]]]]], width: int, pause: float = 0.5) -> None:
        self.transport, self.width, self.pause = transport, width, pause

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        for attempt in (0, 1):
            try:
                status, rows = self.transport(texts)
            except OSError as e:
                status, rows = 599, [(0, [str(e)])]
            if status < 300:
                if len(rows) != len(texts):
                    raise UpstreamFailure(f"{len(rows)} vectors for {len(texts)} texts")
                return [v for _, v in sorted(rows)]
            if attempt or not (status == 429 or status >= 500):
                raise UpstreamFailure(f"embedding failed with {status}")
            time.sleep(self.pause)
        raise AssertionError


def embed_chunks(chunks: DataFrame, provider: Provider, batch: int = 64) -> DataFrame:
    """``chunks`` (``record_id, chunk_index, chunk_text``) with ``embedding`` and ``error``: a batch
    that fails leaves null vectors and its error, so its records can be tried again."""
    kind = chunks.schema["record_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows.column(2).to_pylist()
            vectors: list[list[float] | None] = []
            errors: list[str | None] = []
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                try:
                    found = provider.embed(part)
                    if any(len(v) != provider.width for v in found) or len(found) != len(part):
                        raise UpstreamFailure("vectors of unexpected number or width")
                    vectors += found
                    errors += [None] * len(part)
                except UpstreamFailure as e:
                    vectors += [None] * len(part)
                    errors += [str(e)] * len(part)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=["record_id", "chunk_index", "chunk_text", "embedding", "error"])

    return by_batch(chunks.select("record_id", "chunk_index", "chunk_text"), run, f"record_id {kind}, chunk_index int, chunk_text string, embedding array<float>, error string")


#: Attempts after which a record's embedding counts as failed.
ATTEMPTS = 3


def embed_outcome(records: DataFrame, embedded: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """The queue state of pending ``records`` after a run: done if all their chunks have vectors,
    skipped if they have no chunk, else pending, or failed at the last attempt."""
    state = embedded.groupBy("record_id").agg(F.count_if(F.col("error").isNotNull()).alias("bad"))
    joined = records.join(state.withColumnRenamed("record_id", "id"), "id", "left")
    tried = F.coalesce("embed_attempts", F.lit(0)) + F.when(F.col("bad") > 0, 1).otherwise(0)
    status = F.when(F.col("bad").isNull(), "skipped").when(F.col("bad") == 0, "done").when(tried >= attempts, "failed").otherwise("pending")
    waiting = F.col("embed_status") == "pending"
    return joined.withColumns({"embed_status": F.when(waiting, status).otherwise(F.col("embed_status")), "embed_attempts": F.when(waiting, tried).otherwise(F.col("embed_attempts"))}).select(*records.columns)
