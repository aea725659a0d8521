"""Graphs as two tables: vertices (id, value) and edges (src, dst, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.plans.scratch import Scratch


def reverse(edges: DataFrame) -> DataFrame:
    return edges.withColumnsRenamed({"src": "_s", "dst": "src"}).withColumnRenamed("_s", "dst").select("src", "dst", *[c for c in edges.columns if c not in ("src", "dst")])


def triplets(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Each edge with the values of both its ends."""
    source = vertices.select(F.col("id").alias("src"), F.col("value").alias("src_value"))
    target = vertices.select(F.col("id").alias("dst"), F.col("value").alias("dst_value"))
    return edges.join(source, "src").join(target, "dst").select("src", "dst", "src_value", "dst_value", F.col("value").alias("edge_value"))


def edge_orders(edges: DataFrame) -> DataFrame:
    """For each pair of linked vertices which directions there are: 2 from the smaller to the larger
    id, 1 back, 3 both."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.bit_or(F.when(F.col("src") <= F.col("dst"), 2).otherwise(1)).alias("direction"))


def gather_messages(vertices: DataFrame, edges: DataFrame, reducer: str, kinds: list[str] | None = None) -> DataFrame:
    """Adds to each vertex's value what its in-neighbours' values come to by min, max, mean or sum; with
    ``kinds`` first within each kind of edge, then over the kinds by the same reducer."""
    reduce = {"min": F.min, "max": F.max, "mean": F.avg, "sum": F.sum}[reducer]
    edges = edges.where(F.col("kind").isin(kinds)) if kinds else edges
    sent = edges.join(vertices.withColumnsRenamed({"id": "src", "value": "_message"}), "src")
    got = sent.groupBy("dst", *(["kind"] if kinds else [])).agg(reduce("_message").alias("_message"))
    if kinds:
        got = got.groupBy("dst").agg(reduce("_message").alias("_message"))
    joined = vertices.join(got, vertices["id"] == got["dst"], "left")
    return joined.select("id", (F.col("value") + F.coalesce("_message", F.lit(0))).alias("value"))


def iterate_messages(vertices: DataFrame, edges: DataFrame, reducer: str, rounds: int) -> DataFrame:
    """Several rounds of messages; each round's values are written out, which keeps plans short."""
    scratch = Scratch(vertices.sparkSession)
    for _ in range(rounds):
        vertices = scratch.save(gather_messages(vertices, edges, reducer), "vertices")
    return vertices
