"""Connected components of a link table by alternating star contractions, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.session import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``node, component`` (the least node) for every node of ``links``; self-links and repeated
    links don't matter, links with a null end are left out.

    Each round links every node to the least node of its neighbourhood (Kiveris and others, 2014):
    first the larger neighbours, then the smaller ones.  The number of rounds is logarithmic in
    practice; the edge set is written to the checkpoint folder after each, and only its size and a
    checksum come to the driver.  More than ``rounds`` raise an error rather than give a partial
    answer.
    """
    e = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("ok")).filter("ok").select("u", "v").distinct()
    e = cut_lineage(e)
    loops = e.filter("u = v").select(F.col("u").alias("node")).distinct()
    edges, before = e.filter("u < v"), None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        small = small.select(F.col("m").alias("u"), "v").unionByName(small.select(F.col("m").alias("u"), F.col("u").alias("v"))).filter("u < v").distinct()
        edges = cut_lineage(small)
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            out = edges.groupBy("v").agg(F.min("u").alias("component")).select(F.col("v").alias("node"), "component")
            roots = edges.select("u").distinct().select(F.col("u").alias("node"), F.col("u").alias("component"))
            return out.unionByName(roots).unionByName(loops.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
        before = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
