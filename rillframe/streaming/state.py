"""Operators with state per key, for streams (and batches) of keyed rows.

Each is a processor for ``groupBy(key).transformWithStateInPandas``; what arrives for a key in one
batch comes in the order of ``order`` where that is given, a chunk at a time. For that the columns in use
of a batch's rows of one key are held; a source's limit on a batch (files or offsets a trigger)
bounds them. Processors that need no order take rows as they come and hold none. State per key has
a bounded size but where the docstring says otherwise.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rillframe.streaming.buckets import BUCKETS, NEVER, Bucketed
from rillframe.streaming.drains import use_rocksdb

#: Rows of a key that are worked on at once.
CHUNK = 10_000


def process(df: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str = "append", time_mode: str = "None", event_time: str = "") -> DataFrame:
    """Applies a processor to the rows of each key. Rows with a null key are of no key and left out:
    Spark would give the other keys of their batch another type."""
    use_rocksdb(df.sparkSession)
    # Spark also starts a Python process of its own for processors, which finds no shipped package.
    for name in [m for m in sys.modules if m.startswith("rillframe.streaming.")]:
        cloudpickle.register_pickle_by_value(sys.modules[name])
    rows, by = df.where(F.col(key).isNotNull()), key
    if isinstance(processor, Bucketed):
        processor.key, processor.kind, by = key, df.schema[key].dataType.simpleString(), "_bucket"
        rows = rows.withColumn(by, F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
    return rows.groupBy(by).transformWithStateInPandas(processor, schema, mode, time_mode, None, event_time)


def _micros(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[us]").astype("int64")


def _sorted_chunks(rows: Iterator[pd.DataFrame], order: list[str], *columns: str) -> Iterator[pd.DataFrame]:
    """A key's rows of a batch in the order of ``order``, ``CHUNK`` rows at a time and only the columns that
    are needed. Spark gives no order within a batch's rows of a key and lets streams sort nothing before, so
    these columns are held until the last row has come: the one thing that grows with the batch, which
    the source's limit bounds."""
    needed = list(dict.fromkeys([*order, *columns]))
    held = [r[needed] for r in rows if len(r)]
    if not held:
        return
    whole = held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
    held.clear()
    places = np.lexsort([whole[c].to_numpy() for c in reversed(order)])
    for at in range(0, len(places), CHUNK):
        yield whole.iloc[places[at : at + CHUNK]].reset_index(drop=True)


class RunningSum(StatefulProcessor):
    """Each row's key, ``order`` and the key's sum so far. Value state, with a time to live that
    counts from the last write; ``refresh`` also writes where nothing is added."""

    def __init__(self, value: str, order: str, ttl_ms: int | None = None, refresh: bool = False):
        self.value, self.order, self.ttl_ms, self.refresh = value, order, ttl_ms, refresh

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "total double", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        total, added = self.total.get()[0] if self.total.exists() else 0.0, False
        for found in _sorted_chunks(rows, [self.order], self.value):
            sums = total + found[self.value].fillna(0).cumsum()
            total, added = float(sums.iloc[-1]), True
            yield pd.DataFrame({"key": key[0], "at": found[self.order], "total": sums})
        if added or self.refresh:
            self.total.update((total,))

    def close(self) -> None:
        pass


class CountWindow(StatefulProcessor):
    """Sums over the last ``size`` values of a key after every ``slide`` of them; where size and
    slide are equal the windows tumble and a window that isn't full puts nothing out. List state holds less
    than ``size`` values; ``purge`` empties it when it has fired. A chunk's sums are differences of
    one running sum."""

    def __init__(self, value: str, order: str, size: int, slide: int | None = None, purge: bool = False):
        self.value, self.order, self.slide, self.purge = value, order, slide or size, purge
        self.size = min(size, self.slide) if purge else size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "v double")
        self.seen = handle.getValueState("seen", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        held = np.array([x[0] for x in self.last.get()] if self.last.exists() else [], float)
        n = before = self.seen.get()[0] if self.seen.exists() else 0
        for found in _sorted_chunks(rows, [self.order], self.value):
            values = np.append(held, found[self.value].fillna(0).to_numpy(float))
            sums = np.append(0.0, np.cumsum(values))
            fires = np.flatnonzero((n + 1 + np.arange(len(found))) % self.slide == 0)
            ends = len(held) + fires + 1
            totals = sums[ends] - sums[np.maximum(ends - self.size, 0)]
            n += len(found)
            left = min(self.size - 1, n % self.slide if self.purge else len(values))
            held = values[len(values) - left :]
            yield pd.DataFrame({"key": key[0], "at": found[self.order].to_numpy()[fires], "total": totals})
        if n == before:
            return
        self.seen.update((n,))
        if len(held):
            self.last.put([(float(x),) for x in held])
        elif self.last.exists():
            self.last.clear()

    def close(self) -> None:
        pass


class CountTrigger(StatefulProcessor):
    """The sum over all values of a key so far, after every ``every`` of them: a global window with
    a count trigger. State is the sum and the number of rows, however many rows a key has."""

    def __init__(self, value: str, order: str, every: int):
        self.value, self.order, self.every = value, order, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.so_far = handle.getValueState("so_far", "total double, n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        total, n = self.so_far.get() if self.so_far.exists() else (0.0, 0)
        for found in _sorted_chunks(rows, [self.order], self.value):
            sums = total + found[self.value].fillna(0).cumsum()
            fires = (n + 1 + pd.RangeIndex(len(found))) % self.every == 0
            total, n = float(sums.iloc[-1]), n + len(found)
            yield pd.DataFrame({"key": key[0], "at": found[self.order][fires], "total": sums[fires]})
        if n:
            self.so_far.update((total, n))

    def close(self) -> None:
        pass


class ContinuousTrigger(StatefulProcessor):
    """The sum over all values of a key so far at the end of every ``seconds`` of event time in which
    the key had rows: a global window that fires early and goes on. It fires when a row of a later
    stretch arrives; rows of an earlier one count towards the present. State is the sum and the
    stretch. :class:`rillframe.streaming.triggers.EventTimeTrigger` fires by timers instead."""

    def __init__(self, value: str, ts: str, order: str, seconds: int):
        self.value, self.ts, self.order, self.seconds = value, ts, order, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.so_far = handle.getValueState("so_far", "total double, stretch bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        total, stretch = self.so_far.get() if self.so_far.exists() else (0.0, None)
        for found in _sorted_chunks(rows, [self.ts, self.order], self.value):
            stretches = np.maximum.accumulate(_micros(found[self.ts]).to_numpy() // (self.seconds * 1_000_000))
            stretches = stretches if stretch is None else np.maximum(stretches, stretch)
            sums = np.append(total, total + np.cumsum(found[self.value].fillna(0).to_numpy(float)))
            before = np.append(stretches[0] if stretch is None else stretch, stretches[:-1])
            fires = np.flatnonzero(stretches > before)
            total, stretch = float(sums[-1]), int(stretches[-1])
            yield pd.DataFrame({"key": key[0], "at": (before[fires] + 1) * self.seconds, "total": sums[fires]})
        if stretch is not None:
            self.so_far.update((total, stretch))

    def close(self) -> None:
        pass


class Accumulator(StatefulProcessor):
    """Sum and number of a key's values so far after each of them, whose ratio is their mean. State is
    this accumulator alone, which values are added to as they come."""

    def __init__(self, value: str, order: str):
        self.value, self.order = value, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "total double, n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        total, n = self.held.get() if self.held.exists() else (0.0, 0)
        for found in _sorted_chunks(rows, [self.order], self.value):
            sums, numbers = total + found[self.value].fillna(0).cumsum(), n + 1 + np.arange(len(found))
            total, n = float(sums.iloc[-1]), int(numbers[-1])
            yield pd.DataFrame({"key": key[0], "at": found[self.order], "total": sums, "n": numbers})
        if n:
            self.held.update((total, n))

    def close(self) -> None:
        pass


class Connected(StatefulProcessor):
    """Two inputs (:func:`rillframe.operators.joins.connect`) with a handler each and one state: a row
    of the left leaves its id there; a row of the right is put out with the id that it finds."""

    def __init__(self, ts: str, order: str):
        self.ts, self.order = ts, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "id bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        before = latest = self.latest.get()[0] if self.latest.exists() else None
        for found in _sorted_chunks(rows, [self.ts, self.order], "side"):
            ids = found[self.order].astype("Int64")
            seen = ids.where(found["side"] == "left").ffill()
            if latest is not None:
                seen = seen.fillna(latest)
            if not pd.isna(seen.iloc[-1]):
                latest = int(seen.iloc[-1])
            right = found["side"] == "right"
            yield pd.DataFrame({"key": key[0], "at": ids[right], "seen": seen[right]})
        if latest != before:
            self.latest.update((latest,))

    def close(self) -> None:
        pass


class CountsByValue(Bucketed):
    """How often each value of a column has come for a key; map state by key and value, in update mode. A
    time to live counts from a value's last row."""

    STATE = [("n", "i8")]
    BESIDE = [("value", "string")]

    def __init__(self, value: str, ttl_ms: int | None = None):
        self.value, self.ttl_ms = value, ttl_ms

    def arrived(self, rows, held, timers) -> tuple[pd.DataFrame, pd.DataFrame]:
        new = pd.DataFrame({"key": rows["key"], "value": rows[self.value].fillna("").astype(object), "n": 1})
        here = new.drop_duplicates(["key", "value"])[["key", "value"]]
        now = pd.concat([held, new]).groupby(["key", "value"], as_index=False)["n"].sum()
        return now.merge(here, on=["key", "value"]), now


class LateTag(StatefulProcessor):
    """Every row's id with whether it lies more than ``seconds`` behind its key's largest time so
    far: split by it, late rows go to an output of their own before any aggregation."""

    def __init__(self, ts: str, order: str, seconds: int):
        self.ts, self.order, self.seconds = ts, order, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.largest = handle.getValueState("largest", "ts bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        start = self.largest.get()[0] if self.largest.exists() else -(1 << 62)
        for found in _sorted_chunks(rows, [self.order], self.ts):
            micros = _micros(found[self.ts])
            before = micros.cummax().shift(1).fillna(start).clip(lower=start)
            start = int(max(start, micros.max()))
            yield pd.DataFrame({"key": key[0], "at": found[self.order], "late": (before - micros) > self.seconds * 1_000_000})
        self.largest.update((start,))

    def close(self) -> None:
        pass


class KeepLast(StatefulProcessor):
    """A key's latest row by time so far, or with ``first`` its earliest, put out when it changes:
    deduplication that keeps the last, or the first. In update mode downstream keeps the newest
    row of a key."""

    def __init__(self, ts: str, order: str, first: bool = False):
        self.ts, self.order, self.first = ts, order, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "ts bigint, id bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        choose = min if self.first else max
        old = top = tuple(self.best.get()) if self.best.exists() else None
        for chunk in rows:
            for place in [choose(zip(_micros(chunk[self.ts]), chunk[self.order], strict=True))] if len(chunk) else []:
                top = place if top is None else choose(top, place)
        if top != old:
            self.best.update((int(top[0]), int(top[1])))
            yield pd.DataFrame({"key": [key[0]], "id": [int(top[1])]})

    def close(self) -> None:
        pass


class InactivityTimer(StatefulProcessor):
    """Puts out a key's count of rows when the watermark is ``idle_ms`` past its latest row: each
    row deletes the key's timer and registers one anew. Event time; needs a watermark."""

    def __init__(self, ts: str, idle_ms: int):
        self.ts, self.idle_ms = ts, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n bigint, due bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        n, due = self.seen.get() if self.seen.exists() else (0, None)
        latest = due
        for chunk in rows:
            ends = int(chunk[self.ts].astype("datetime64[ms]").astype("int64").max()) + self.idle_ms
            n, latest = n + len(chunk), ends if latest is None else max(latest, ends)
        if latest != due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(latest)
        self.seen.update((n, latest))
        yield pd.DataFrame({"key": pd.Series([], dtype="int64"), "n": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n = self.seen.get()[0]
        self.seen.clear()
        yield pd.DataFrame({"key": [key[0]], "n": [n]})

    def close(self) -> None:
        pass


class EvolvingTotal(StatefulProcessor):
    """A key's sum so far, and from its second version on the number of rows too. The later version
    reads what the earlier has stored, a missing field as null, where state is encoded as Avro
    (``spark.sql.streaming.stateStore.encodingFormat``)."""

    def __init__(self, value: str, counted: bool):
        self.value, self.counted = value, counted

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "total double, n bigint" if self.counted else "total double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        old = self.total.get() if self.total.exists() else (0.0, None)
        total, n = old[0], (old[1] if len(old) > 1 else None) or 0
        for chunk in rows:
            total, n = total + float(chunk[self.value].fillna(0).sum()), n + len(chunk)
        self.total.update((total, n) if self.counted else (total,))
        yield pd.DataFrame({"key": [key[0]], "total": [total], "n": [n if self.counted else 0]})

    def close(self) -> None:
        pass


class EventTimeSort(Bucketed):
    """A key's rows in the order of their times: each waits until the watermark has passed it, and is put
    out with its place in the key's order. The watermark's delay bounds what is held. Event time; rows
    without a time are left out."""

    #: A key's number of rows put out is in ``n``, at ``NEVER``.
    STATE = [("at", "i8"), ("id", "i8"), ("n", "i8")]

    def __init__(self, ts: str, order: str):
        self.ts, self.order = ts, order

    def arrived(self, rows, held, timers) -> tuple[pd.DataFrame, pd.DataFrame]:
        rows = rows[rows[self.ts].notna()]
        new = pd.DataFrame({"key": rows["key"], "at": _micros(rows[self.ts]), "id": rows[self.order].astype("int64"), "n": 0})
        return pd.DataFrame({"key": rows["key"][:0], "id": new["id"][:0], "place": new["n"][:0]}), pd.concat([held, new])

    def passed(self, held, timers) -> tuple[pd.DataFrame, pd.DataFrame]:
        counts = held["at"] == NEVER
        done, waiting = held[counts].set_index("key")["n"], held[~counts].sort_values(["key", "at", "id"])
        ripe = waiting["at"] < timers.getCurrentWatermarkInMs() * 1000
        out = waiting[ripe]
        place = out.groupby("key").cumcount() + 1 + out["key"].map(done).fillna(0).astype("int64")
        last = out.assign(at=NEVER, id=0, n=place).drop_duplicates("key", keep="last")
        held = pd.concat([held[counts & ~held["key"].isin(last["key"])], last, waiting[~ripe]])
        return pd.DataFrame({"key": out["key"], "id": out["id"], "place": place.astype("int64")}), held

    def dues(self, held) -> pd.Series:
        return held.loc[held["at"] != NEVER, "at"] // 1000 + 1
