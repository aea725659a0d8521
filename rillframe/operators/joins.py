"""Joins that carry time, rules or whole groups."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and bytes up to which a side may be broadcast; beyond, rules are joined like any table.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20


def windowed_join(left: DataFrame, right: DataFrame, keys: list[str], ts: str, size: str, slide: str | None = None) -> DataFrame:
    """Pairs of rows with equal keys in the same window of event time.

    Other columns of the right side get the prefix ``right_``. The result's time is the earlier of
    both; with a slide shorter than the size a pair appears once for each window that holds both.
    """
    def placed(df: DataFrame, prefix: str) -> DataFrame:
        named = df.select(*[F.col(c).alias(c if c in keys else prefix + c) for c in df.columns])
        window = F.window(prefix + ts, size, slide) if slide else F.window(prefix + ts, size)
        return named.withColumn("window", window)

    joined = placed(left, "left_").join(placed(right, "right_"), [*keys, "window"])
    back = {f"left_{c}": c for c in left.columns if c not in keys and c != ts}
    return joined.withColumn(ts, F.least(f"left_{ts}", f"right_{ts}")).withColumnsRenamed(back)


def interval_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, lower: str, upper: str) -> DataFrame:
    """Pairs with equal keys where the left time lies between the right time plus ``lower`` and plus
    ``upper``, both ends included. Time and key columns must be named apart but for the key.

    On streams both sides must carry watermarks; Spark then lets go of rows that can match no more.
    """
    a, b = left.alias("l"), right.alias("r")
    inside = (F.col(f"l.{left_ts}") >= F.col(f"r.{right_ts}") + F.expr(f"INTERVAL {lower}")) & (F.col(f"l.{left_ts}") <= F.col(f"r.{right_ts}") + F.expr(f"INTERVAL {upper}"))
    joined = a.join(b, (F.col(f"l.{key}") == F.col(f"r.{key}")) & inside)
    return joined.select(*[F.col(f"l.{c}") for c in left.columns], *[F.col(f"r.{c}") for c in right.columns if c != key])


def bucketed_interval_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, seconds: int) -> DataFrame:
    """The batch form for keys with very many rows: times fall into buckets as long as the
    interval, each right row meets two buckets, and no key is compared with itself throughout."""
    bucket = lambda c: F.floor(F.unix_micros(c) / (seconds * 1_000_000))
    a = left.withColumn("_bucket", bucket(F.col(left_ts)))
    first = bucket(F.col(right_ts))
    b = right.withColumn("_bucket", F.explode(F.array(first, first + 1)))
    joined = a.join(b, [key, "_bucket"])
    late = F.unix_micros(left_ts) - F.unix_micros(right_ts)
    return joined.where((late >= 0) & (late <= seconds * 1_000_000)).drop("_bucket")


def join_rules(df: DataFrame, rules: DataFrame, on: Column | list[str], how: str = "inner", most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Joins a table of rules that every task needs. It is broadcast only if it has ``most`` rows
    and ``most_bytes`` bytes (as JSON) at most, which is checked; else the join is a shuffled one."""
    size = rules.limit(most + 1).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*rules.columns)))), F.lit(0)).alias("bytes")).first()
    small = size["rows"] <= most and size["bytes"] <= most_bytes
    return df.join(F.broadcast(rules) if small else rules, on, how)


def connect(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both inputs as one, told apart by ``side``, for a handler with state per key."""
    return left.withColumn("side", F.lit("left")).unionByName(right.withColumn("side", F.lit("right")), allowMissingColumns=True)


def co_group(left: DataFrame, right: DataFrame, key: str, function: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A function of both groups of a key at once; either may be empty. A group must fit a task's
    memory: aggregate first where keys may be hot."""
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInPandas(function, schema)
