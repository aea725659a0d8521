"""Changelogs: streams whose rows say what they do to a table, aggregates over them, and the table
that they come to.

A row's ``kind`` is ``+I`` (insert), ``-U`` and ``+U`` (what an update takes away and what it puts
there) or ``-D`` (delete). Update mode says only what a group is now; with the row taken away named as
well, a second aggregate over the changes of the first stays right."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillframe.streaming.buckets import Bucketed
from rillframe.streaming.state import process

INSERT, BEFORE, AFTER, DELETE = "+I", "-U", "+U", "-D"


def sign(kind: str = "kind") -> Column:
    """1 for rows that come, -1 for rows that go; a null kind is an insert."""
    return F.when(F.col(kind).isin(BEFORE, DELETE), -1).otherwise(1)


class ChangelogAggregate(Bucketed):
    """Number and sum of each key's rows over a changelog, put out as a changelog.

    A batch's rows of a key come to one change: an insert if the key had no rows, a delete if it has
    none any more, nothing if it is as before, and else the old row as ``-U`` and the new one as
    ``+U``, in this order by ``seq``, which counts a key's changes. State is number, sum and this count;
    the count stays when a key's rows have gone, so that a later insert comes after the delete."""

    STATE = [("n", "i8"), ("total", "f8"), ("seq", "i8")]

    def arrived(self, rows, held, timers) -> tuple[pd.DataFrame, pd.DataFrame]:
        signs = rows["sign"].astype("int64")
        new = pd.DataFrame({"key": rows["key"], "n": signs, "total": signs * rows["value"].fillna(0)}).groupby("key").sum()
        old = held.set_index("key").reindex(new.index, fill_value=0)
        n, total = old["n"] + new["n"], old["total"] + new["total"]
        total = total.where(n != 0, 0.0)  # what rounding has left of values that are all gone
        was = old["n"] != 0
        update = was & (n != 0) & ((n != old["n"]) | (total != old["total"]))
        frame = lambda which, kind, n, total, ahead: pd.DataFrame({"seq": old["seq"] + ahead, "kind": kind, "n": n, "total": total})[which]
        out = [frame(~was & (n != 0), INSERT, n, total, 0), frame(was & (n == 0), DELETE, old["n"], old["total"], 0)]
        out = pd.concat([*out, frame(update, BEFORE, old["n"], old["total"], 0), frame(update, AFTER, n, total, 1)])
        seq = old["seq"] + out.groupby(level=0).size().reindex(new.index, fill_value=0)
        now = pd.DataFrame({"n": n, "total": total, "seq": seq}).rename_axis("key").reset_index()
        out = out.rename_axis("key").reset_index()[["key", "seq", "kind", "n", "total"]].sort_values(["key", "seq"])
        return out.astype({"seq": "int64", "n": "int64", "total": "float64"}), pd.concat([held[~held["key"].isin(new.index)], now])


def changelog_aggregate(changes: DataFrame, key: str, value: str, kind: str | None = None) -> DataFrame:
    """Streams: (key, seq, kind, n, total) over rows that all insert or, where the column ``kind`` is
    named, do what that says. A row that goes must be one that came, with the same value."""
    rows = changes.select(F.col(key).alias("key"), F.col(value).cast("double").alias("value"), (F.lit(1) if kind is None else sign(kind)).alias("sign"))
    return process(rows, "key", ChangelogAggregate(), f"key {changes.schema[key].dataType.simpleString()}, seq bigint, kind string, n bigint, total double", "update")


def applied(log: DataFrame, *keys: str, seq: str = "seq", kind: str = "kind") -> DataFrame:
    """The table that a changelog comes to: of each key the row of the newest change, unless that
    takes it away. A maximum by key, so a log of any length needs one partial aggregation."""
    columns = [c for c in log.columns if c not in (*keys, seq)]
    # Of -U and +U the later counts, which is the +U: a -U alone would be a log cut in the middle.
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*columns), seq).alias("_r")).select(*keys, "_r.*")
    return newest.where(~F.col(kind).isin(BEFORE, DELETE)).drop(kind)
