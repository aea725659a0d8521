"""Connected components of a table of links, by alternating star operations.

Each round links every node's larger neighbours, then its smaller ones, to the smallest node that
it sees. Only minima per node are gathered, which Spark sums up before the shuffle, so a node with
very many links is no burden; neighbours are never collected. The number of rounds grows with the
logarithm of the number of nodes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.llm.common import Scratch


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """``larger``: links every larger neighbour of a node to the smallest node around it; else
    does so with its smaller neighbours and itself. Edges are (u, v) with u > v."""
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    around = edges.unionByName(turned) if larger else edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    if larger:
        out = turned.join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = edges.join(least, F.col("u") == F.col("w"))
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for every node that has a link to another; the root is the component's
    smallest node. Links may point either way, repeat, or lead to the node itself; nulls have
    no links. Nodes are 64-bit integers."""
    scratch, name = Scratch(edges.sparkSession), f"stars-{uuid.uuid4().hex[:8]}"
    a, b = F.col(left).cast("bigint"), F.col(right).cast("bigint")
    current = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    current = scratch.save(current, name)
    state = None
    while True:
        current = scratch.save(_stars(_stars(current, True), False), name)
        seen = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
