"""Connected components by alternating star contraction.

Each round ties every node to the smallest of its neighbourhood, first seen from the larger ends of its links
(large star), then from the smaller (small star); it ends when no link changes.  A round moves a fixed number
of links, so a component of any size is spread over tasks; smallest neighbours are combined map-side, and the
joins on them are ones that adaptive execution can split where a hub has many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _star(links: DataFrame, large: bool) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    if large:
        pairs = links.select(a.alias("u"), b.alias("v")).unionByName(links.select(b.alias("u"), a.alias("v")))
    else:
        pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    smallest = materialise(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    out = pairs.join(smallest, "u")
    if large:
        out = out.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = out.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(smallest.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return materialise(out.where("a <> b").distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node of the component."""
    links = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen or not now[0]:
            break
        seen = tuple(now)
        links = _star(_star(links, large=True), large=False)
    leaves = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
