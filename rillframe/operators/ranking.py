"""Ranking, deduplication by time, order and the placing of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillframe.plans.scratch import Scratch


def top_n(df: DataFrame, n: int, by: list[str], order: list[Column]) -> DataFrame:
    """Rows of rank ``n`` at most in their group, ties included. The filter on the rank lets Spark
    drop rows before the shuffle."""
    return df.withColumn("_r", F.rank().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def keep_first(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The earliest row of each key."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(time, tie)).alias("_r")).select("_r.*")


def keep_last(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The latest row of each key."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(time, tie)).alias("_r")).select("_r.*")


def numbered(df: DataFrame, *order: Column | str, name: str = "at") -> DataFrame:
    """Each row's place in a total order, from 1: sorted by ranges, then numbered within each range
    from where the ranges before end, so no task gets more than its range."""
    placed = Scratch(df.sparkSession).save(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "ordered")
    part, within = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each range
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + within + 1).drop("_id", "_part", "_before")


def cluster_by(df: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """Deals rows out by key and sorts within tasks."""
    return df.repartition(F.col(key)).sortWithinPartitions(*(order or [key]))


def partition_by(df: DataFrame, n: int, partition: Column) -> DataFrame:
    """Puts each row into the partition that the expression names, from 0 to n - 1."""
    return df.repartitionById(n, partition.cast("int"))


def partitioned_once(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by a key that later groupings and joins by it use without another shuffle."""
    return df.repartition(F.col(key))
