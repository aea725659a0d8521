"""Windows of time and of counts; each function takes batch and streaming input alike unless said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounded_out_of_orderness(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """A watermark that trails the largest time by ``delay``."""
    return df.withWatermark(ts, delay)


def monotonous(df: DataFrame, ts: str) -> DataFrame:
    """A watermark for times that never go back."""
    return df.withWatermark(ts, "0 seconds")


def with_event_time(df: DataFrame, ts: str, expression: Column) -> DataFrame:
    """A computed event time."""
    return df.withColumn(ts, expression.cast("timestamp"))


def tumbling(df: DataFrame, ts: str, size: str, keys: list[str], *aggregates: Column) -> DataFrame:
    return df.groupBy(F.window(ts, size).alias("window"), *keys).agg(*aggregates)


def sliding(df: DataFrame, ts: str, size: str, slide: str | None, keys: list[str], *aggregates: Column) -> DataFrame:
    """Windows of a size every slide; without a slide they tumble."""
    return df.groupBy(F.window(ts, size, slide or size).alias("window"), *keys).agg(*aggregates)


def session(df: DataFrame, ts: str, gap: str | Column, keys: list[str], *aggregates: Column) -> DataFrame:
    """Sessions that end after a gap, fixed or by row."""
    return df.groupBy(F.session_window(ts, gap).alias("window"), *keys).agg(*aggregates)


def processing_time(df: DataFrame, size: str, keys: list[str], *aggregates: Column, slide: str | None = None) -> DataFrame:
    """Windows of the time at which rows are read: on streams, that of their batch. Sessions of it:
    :class:`rillframe.streaming.triggers.ProcessingTimeSession`."""
    return sliding(df.withColumn("_read", F.current_timestamp()), "_read", size, slide, keys, *aggregates)


def count_tumbling(df: DataFrame, size: int, keys: list[str], order: list[str], *aggregates: Column) -> DataFrame:
    """Batch: windows of ``size`` rows of a key in the order given; a last window that isn't full
    puts nothing out. Streams: :class:`rillframe.streaming.state.CountWindow`."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    numbered = df.withColumn("n_window", F.floor((rank - 1) / size))
    return numbered.groupBy(*keys, "n_window").agg(F.count("*").alias("_n"), *aggregates).where(F.col("_n") == size).drop("_n")


def count_sliding(df: DataFrame, size: int, slide: int, keys: list[str], order: list[str], **aggregates: Column) -> DataFrame:
    """Batch: after every ``slide`` rows of a key, aggregates of its last ``size`` rows; the first
    firings have fewer rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    frame = w.rowsBetween(-(size - 1), 0)
    out = df.withColumns({name: a.over(frame) for name, a in aggregates.items()}).withColumn("_rn", F.row_number().over(w))
    return out.where(F.col("_rn") % slide == 0).drop("_rn")


def split_late(df: DataFrame, ts: str, arrival: str, keys: list[str], seconds: int) -> tuple[DataFrame, DataFrame]:
    """Batch: rows in time and late rows of each key, where a row is late if it lies more than
    ``seconds`` behind the largest time that arrived before it. Streams:
    :class:`rillframe.streaming.state.LateTag`."""
    before = F.max(ts).over(Window.partitionBy(*keys).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    tagged = df.withColumn("_late", F.coalesce(F.unix_micros(before) - F.unix_micros(ts) > seconds * 1_000_000, F.lit(False)))
    return tagged.where(~F.col("_late")).drop("_late"), tagged.where("_late").drop("_late")
