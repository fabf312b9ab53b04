"""Sources of change events and repository snapshots, and the schema registry."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.errors import UpstreamFailure
from vellumine.functions.text import authority, matches_any_glob

#: Change events as they arrive, one JSON object a line.  Events without a record body (identity
#: changes) keep nulls; unreadable lines come out with every field null.
WIRE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("type", "did", "collection", "rkey", "action", "record", "cid", "rev")] + [T.StructField("live", T.BooleanType())]
)


def wire_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events parsed from a column of JSON lines, batch or streaming; only record events, and
    only those with a whole key and a known action."""
    e = F.from_json(column, WIRE, {"mode": "PERMISSIVE"})
    rows = lines.select(*[c for c in lines.columns if c != column], e.alias("e")).select(*[c for c in lines.columns if c != column], "e.*")
    whole = F.col("did").isNotNull() & F.col("collection").isNotNull() & F.col("rkey").isNotNull() & F.col("action").isin("create", "update", "delete")
    return rows.filter((F.col("type") == "record") & whole)


def read_wire(spark: SparkSession, path: str) -> DataFrame:
    """A batch of event files (text, optionally compressed)."""
    return wire_events(spark.read.text(path))


def stream_wire(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Event files as they appear; the checkpoint is the acknowledgement, so a batch that didn't
    commit is delivered again."""
    return wire_events(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path))


def snapshot_events(rows: DataFrame, rev: str | None, globs: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Exported repository rows (``did, collection, rkey, record, cid``) as create events stamped
    with the commit's ``rev`` (None for the paged fallback), and those the collection globs leave
    out."""
    wanted = matches_any_glob(F.col("collection"), list(globs)) if globs else F.lit(True)
    events = rows.filter(wanted).withColumns({"type": F.lit("record"), "action": F.lit("create"), "rev": F.lit(rev).cast("string"), "live": F.lit(False)})
    return events, rows.filter(~wanted)


def import_repository(export: Callable[[str], DataFrame], pages: Callable[[str, str], DataFrame], did: str, collections: Sequence[str], rev: str | None, not_implemented: type[Exception] = NotImplementedError) -> DataFrame:
    """A repository's events from its whole export, or, where that isn't implemented, from the
    paged lists of ``collections``; other failures propagate."""
    try:
        return snapshot_events(export(did), rev, collections)[0]
    except not_implemented:
        parts = [snapshot_events(pages(did, c), None)[0] for c in collections]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


class Sweep:
    """Imports of all active repositories of a host, in order, resumable, one at a time per DID."""

    def __init__(self, run: Callable[[str], Any]) -> None:
        self.run, self.done, self.failed, self.busy = run, 0, {}, set()

    def __call__(self, repositories: Sequence[Mapping[str, Any]], skip: int = 0) -> dict[str, int]:
        for repo in list(repositories)[skip:]:
            did = repo["did"]
            self.done += 1
            if not repo.get("active", True) or did in self.busy:
                continue
            self.busy.add(did)
            try:
                self.run(did)
            except Exception as e:  # noqa: BLE001
                self.failed[did] = str(e)
            finally:
                self.busy.discard(did)
        return {"swept": self.done, "failed": len(self.failed)}


class Registry:
    """Schemas by name from a folder of JSON files or any resolver, with time to live.

    A success is kept a day, a failure an hour; a failure keeps the schema it replaced.
    """

    def __init__(self, resolve: Callable[[str], Mapping[str, Any] | None], fresh: dt.timedelta = dt.timedelta(hours=24), retry: dt.timedelta = dt.timedelta(hours=1)) -> None:
        self.resolve, self.fresh, self.retry = resolve, fresh, retry
        self.known: dict[str, tuple[dt.datetime, Mapping[str, Any] | None, str | None]] = {}

    @staticmethod
    def folder(path: str) -> Registry:
        def read(name: str) -> Mapping[str, Any] | None:
            file = Path(path) / authority(name) / f"{name}.json"
            return json.loads(file.read_text()) if file.exists() else None

        return Registry(read)

    def get(self, name: str, now: dt.datetime) -> Mapping[str, Any] | None:
        at, schema, error = self.known.get(name, (None, None, None))
        if at is None or now - at >= (self.retry if error else self.fresh):
            try:
                found = self.resolve(name)
                self.known[name] = (now, found, None if found else "not found")
                schema = found
            except Exception as e:  # noqa: BLE001
                self.known[name] = (now, schema, str(e))
        return schema


def cache_key(endpoint: str, params: Mapping[str, Any]) -> str:
    """SHA-256 of the canonical JSON of a request."""
    text = json.dumps([endpoint, sorted((k, str(v)) for k, v in params.items())], separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(text.encode()).hexdigest()


class NetworkCounts:
    """A connector to a network-wide backlink index: a cache with time to live that serves what it
    has when the index fails, and fails only if it has nothing."""

    def __init__(self, fetch: Callable[[str, Mapping[str, Any]], Any], ttl: dt.timedelta) -> None:
        self.fetch, self.ttl, self.cache = fetch, ttl, {}

    def query(self, endpoint: str, params: Mapping[str, Any], now: dt.datetime) -> tuple[Any, bool]:
        """(answer, whether it is stale)."""
        key = cache_key(endpoint, params)
        held = self.cache.get(key)
        if held and now - held[0] < self.ttl:
            return held[1], False
        try:
            answer = self.fetch(endpoint, params)
        except Exception as e:  # noqa: BLE001
            if held:
                return held[1], True
            raise UpstreamFailure(f"{endpoint}: {e}") from e
        self.cache[key] = (now, answer)
        return answer, False


def cached_answers(requests: DataFrame, cache: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """``requests`` (``cache_key, ...``) with the cached ``response`` and whether it is ``fresh``;
    both null where nothing is cached."""
    fresh = F.col("fetched_at") > now - F.make_dt_interval(secs=F.lit(ttl_seconds))
    return requests.join(cache.select("cache_key", "response", "fetched_at"), "cache_key", "left").withColumn("fresh", fresh).drop("fetched_at")
