"""Windows that wait for late rows, and fire again for them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.streaming.buckets import Bucketed
from rillframe.streaming.state import process

FOUND, NUMBERS = ["key", "start", "kind", "n", "total"], {"start": "int64", "n": "int64", "total": "float64"}


def with_late_rows(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """A watermark that trails the largest ``ts`` by ``delay`` but under which Spark drops no row.

    Spark takes a row for late by the column that carries the watermark. That is ``clock`` here: a
    second, narrow copy of each row brings its time there to move the watermark on, and goes
    before anything is shuffled; the row itself comes with a null clock, which is never late. Rows without
    a time are left out.
    """
    copies = df.where(F.col(ts).isNotNull()).withColumn("_tick", F.explode(F.array(F.lit(False), F.lit(True))))
    timed = copies.withColumn("clock", F.when(F.col("_tick"), F.col(ts))).withWatermark("clock", delay)
    return timed.where(F.col("clock").isNull()).drop("_tick")  # names the clock alone, so that Spark leaves it above the watermark


class LatenessWindows(Bucketed):
    """Number and sum of a key's values in tumbling windows, and what becomes of late rows.

    A window's accumulator is in the key's state under its start. When the watermark passes the window's
    end a timer puts it out as ``first``. Rows that come later are added and put it out anew, once for
    a batch, as ``corrected``, whose numbers replace the earlier ones; a window that had no row in time
    comes as corrected at once. When the watermark is ``lateness`` past the end, the accumulator goes;
    what comes then is ``rejected``, put out with number and sum of the rejected rows of that batch
    alone, for an output of their own."""

    STATE = [("start", "i8"), ("n", "i8"), ("total", "f8"), ("fired", "?")]

    def __init__(self, value: str, ts: str, size_ms: int, lateness_ms: int):
        self.value, self.ts, self.size, self.lateness = value, ts, size_ms, lateness_ms

    def arrived(self, rows, held, timers) -> tuple[pd.DataFrame, pd.DataFrame]:
        watermark = timers.getCurrentWatermarkInMs()
        starts = rows[self.ts].astype("datetime64[ms]").astype("int64") // self.size * self.size
        new = pd.DataFrame({"key": rows["key"], "start": starts, "n": 1, "total": rows[self.value].fillna(0).astype(float)})
        new = new.groupby(["key", "start"], as_index=False).sum()
        gone = new["start"] + self.size + self.lateness <= watermark
        rejected, new = new[gone].assign(kind="rejected"), new[~gone]
        new = new.assign(fired=new["start"] + self.size <= watermark, here=True)
        both = pd.concat([held.assign(here=False), new])
        # What is held comes first and tells whether the window has fired.
        now = both.groupby(["key", "start"], as_index=False).agg(n=("n", "sum"), total=("total", "sum"), fired=("fired", "first"), here=("here", "any"))
        now = now.astype({"fired": bool, "here": bool})
        corrected = now[now["fired"] & now["here"]].assign(kind="corrected")
        return pd.concat([rejected, corrected])[FOUND].astype(NUMBERS), now[["key", "start", "n", "total", "fired"]]

    def passed(self, held, timers) -> tuple[pd.DataFrame, pd.DataFrame]:
        watermark, end = timers.getCurrentWatermarkInMs(), held["start"] + self.size
        first = ~held["fired"] & (end <= watermark)
        left = held.assign(fired=held["fired"] | first)[end + self.lateness > watermark]
        return held[first].assign(kind="first")[FOUND].astype(NUMBERS), left

    def dues(self, held) -> pd.Series:
        return held["start"] + self.size + self.lateness * held["fired"]


def windows_with_lateness(df: DataFrame, key: str, ts: str, value: str, size_seconds: int, lateness_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """Streams: (key, start in epoch seconds, kind, n, total) of tumbling windows; see
    :class:`LatenessWindows`. Null values count as zero."""
    rows = with_late_rows(df.select(F.col(key).alias("key"), F.col(ts).alias("at"), F.col(value).cast("double").alias("value")), "at", delay)
    kind = df.schema[key].dataType.simpleString()
    found = process(rows, "key", LatenessWindows("value", "at", size_seconds * 1000, lateness_seconds * 1000), f"key {kind}, start bigint, kind string, n bigint, total double", time_mode="EventTime")
    return found.withColumn("start", F.floor(F.col("start") / 1000))
