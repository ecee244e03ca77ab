"""Connected components of an edge table by alternating large and small stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _fingerprint(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("v", "u").cast("long"))).first()
    return tuple(r)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges``: u > v.  Large: each node gives its larger neighbours its least one; small: its smaller ones."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("m", "u").alias("m"))
    joined = near.join(least, near["u"] == least["w"])
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.where(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (u, v: long): root is the least node of the component.

    Each round is a few joins and partial aggregates over the edge table; nothing is gathered on the driver
    but a count and a checksum.  The number of rounds grows with the logarithm of a component's size.
    """
    now = written(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _fingerprint(now)
    while True:
        now = written(_star(_star(now, large=True), large=False), "edges")
        if (mark := _fingerprint(now)) == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
