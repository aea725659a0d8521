"""Processors that timers move: triggers of global windows, sessions of processing time, and the
letting go of idle keys. Timers fire in a batch, whether or not their key has rows in it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rillframe.streaming.buckets import NEVER, Bucketed


def _frame(key, rows: list[tuple], **types: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=list(types)).astype(types)
    out.insert(0, "key", pd.Series([key[0]] * len(rows), dtype=object))
    return out


class EventTimeTrigger(Bucketed):
    """The sum over all values of a key so far at the end of every stretch of ``interval_ms`` of event
    time in which the key had rows: a global window that fires early and goes on. It fires once the
    watermark has come to the stretch's end, though the key may never have another row. State
    holds the sums of stretches to come; rows of a stretch that has fired count towards the
    next. ``purge`` begins anew after each firing."""

    STATE = [("stretch", "i8"), ("total", "f8"), ("until", "i8")]

    def __init__(self, value: str, ts: str, interval_ms: int, purge: bool = False):
        self.value, self.ts, self.interval, self.purge = value, ts, interval_ms, purge

    def arrived(self, rows, held, timers) -> tuple[pd.DataFrame, pd.DataFrame]:
        fired = held["stretch"] == NEVER
        until = rows["key"].map(held[fired].set_index("key")["until"]).fillna(NEVER).astype("int64")
        stretch = np.maximum(rows[self.ts].astype("datetime64[ms]").astype("int64") // self.interval, until)
        new = pd.DataFrame({"key": rows["key"], "stretch": stretch, "total": rows[self.value].fillna(0).astype(float)})
        sums = pd.concat([held.loc[~fired, ["key", "stretch", "total"]], new]).groupby(["key", "stretch"], as_index=False)["total"].sum()
        none = pd.DataFrame({"key": rows["key"][:0], "at": pd.Series(dtype="int64"), "total": pd.Series(dtype=float)})
        return none, pd.concat([held[fired], sums.assign(until=0)])

    def passed(self, held, timers) -> tuple[pd.DataFrame, pd.DataFrame]:
        fired = held["stretch"] == NEVER
        before, waiting = held[fired].set_index("key"), held[~fired].sort_values(["key", "stretch"])
        ripe = (waiting["stretch"] + 1) * self.interval <= timers.getCurrentWatermarkInMs()
        out = waiting[ripe].copy()
        if not self.purge:
            out["total"] = out.groupby("key")["total"].cumsum() + out["key"].map(before["total"]).fillna(0.0)
        last = out.drop_duplicates("key", keep="last")
        done = pd.DataFrame({"key": last["key"], "stretch": NEVER, "total": 0.0 if self.purge else last["total"], "until": last["stretch"] + 1})
        held = pd.concat([held[fired & ~held["key"].isin(last["key"])], done, waiting[~ripe]])
        return pd.DataFrame({"key": out["key"], "at": (out["stretch"] + 1) * self.interval // 1000, "total": out["total"]}), held

    def dues(self, held) -> pd.Series:
        return (held.loc[held["stretch"] != NEVER, "stretch"] + 1) * self.interval


class ProcessingTimeTrigger(Bucketed):
    """Number and sum of all values of a key so far, put out ``interval_ms`` of processing time after
    the first row since the last firing. State is the two and the time at which they are due."""

    STATE = [("n", "i8"), ("total", "f8"), ("due", "i8")]

    def __init__(self, value: str, interval_ms: int):
        self.value, self.interval = value, interval_ms

    def arrived(self, rows, held, timers) -> tuple[pd.DataFrame, pd.DataFrame]:
        new = pd.DataFrame({"key": rows["key"], "n": 1, "total": rows[self.value].fillna(0).astype(float)})
        new = new.groupby("key", as_index=False).sum().assign(due=timers.getCurrentProcessingTimeInMs() + self.interval)
        # What is held comes first: a key that waits keeps its time.
        here = held["key"].isin(new["key"])
        both = pd.concat([held[here], new])
        both["due"] = both["due"].where(both["due"] != NEVER)
        now = both.groupby("key", as_index=False).agg(n=("n", "sum"), total=("total", "sum"), due=("due", "first"))
        return held.loc[[], ["key", "n", "total"]], pd.concat([held[~here], now.astype({"due": "int64"})])

    def passed(self, held, timers) -> tuple[pd.DataFrame, pd.DataFrame]:
        fires = (held["due"] != NEVER) & (held["due"] <= timers.getCurrentProcessingTimeInMs())
        return held.loc[fires, ["key", "n", "total"]], held.assign(due=held["due"].mask(fires, NEVER))

    def dues(self, held) -> pd.Series:
        return held.loc[held["due"] != NEVER, "due"]


class NeverTrigger(StatefulProcessor):
    """Number and sum of all values of a key, kept in state for whoever reads it, and never put out."""

    def __init__(self, value: str):
        self.value = value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "n bigint, total double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        n, total = self.held.get() if self.held.exists() else (0, 0.0)
        for chunk in rows:
            n, total = n + len(chunk), total + float(chunk[self.value].fillna(0).sum())
        self.held.update((n, total))
        yield _frame(key, [], n="int64", total="float64")

    def close(self) -> None:
        pass


class ProcessingTimeSession(Bucketed):
    """Sessions of processing time: rows of a key belong to one as long as no two batches with rows of
    it lie further apart than ``gap_ms``. Every batch puts out the session that its rows have come to,
    under the time at which it began and with ``closed`` false, and a timer puts it out closed when
    the gap has passed; of the rows of a session the newest counts. A batch that comes after the gap but
    before the timer closes the session itself."""

    STATE = [("began", "i8"), ("due", "i8"), ("n", "i8"), ("total", "f8")]

    def __init__(self, value: str, gap_ms: int):
        self.value, self.gap = value, gap_ms

    def arrived(self, rows, held, timers) -> tuple[pd.DataFrame, pd.DataFrame]:
        now = timers.getCurrentProcessingTimeInMs()
        new = pd.DataFrame({"key": rows["key"], "began": now, "n": 1, "total": rows[self.value].fillna(0).astype(float)})
        here = held["key"].isin(new["key"])
        over = here & (held["due"] <= now)
        both = pd.concat([held.loc[here & ~over, ["key", "began", "n", "total"]], new])
        going = both.groupby("key", as_index=False).agg(began=("began", "min"), n=("n", "sum"), total=("total", "sum"))
        out = pd.concat([held[over].assign(closed=True), going.assign(closed=False)])
        return out[["key", "began", "n", "total", "closed"]].astype({"closed": bool}), pd.concat([held[~here], going.assign(due=now + self.gap)])

    def passed(self, held, timers) -> tuple[pd.DataFrame, pd.DataFrame]:
        over = held["due"] <= timers.getCurrentProcessingTimeInMs()
        return held.loc[over, ["key", "began", "n", "total"]].assign(closed=True).astype({"closed": bool}), held[~over]

    def dues(self, held) -> pd.Series:
        return held["due"]


class IdleRetention(StatefulProcessor):
    """Counts by key that go when the key has been idle: after ``min_ms`` at the earliest and 1.5 times
    that at the latest. A key has one clean-up timer, 1.5 times the minimum ahead of when it was set; a row
    moves it only if it stands nearer than the minimum, so most rows of a busy key don't touch it. With
    ``event_time`` idleness is measured by the watermark and rows have their time in ``ts``, else by
    the clock. Each batch puts out a key's count so far, and the clean-up its last one, with ``gone``."""

    def __init__(self, min_ms: int, ts: str | None = None):
        self.least, self.most, self.ts = min_ms, min_ms * 3 // 2, ts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "n bigint, due bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        n, due = self.held.get() if self.held.exists() else (0, None)
        now = timerValues.getCurrentProcessingTimeInMs() if self.ts is None else None
        for chunk in rows:
            n += len(chunk)
            if self.ts is not None:
                latest = int(chunk[self.ts].astype("datetime64[ms]").astype("int64").max())
                now = latest if now is None else max(now, latest)
        if due is None or due < now + self.least:
            if due is not None:
                self.handle.deleteTimer(due)
            due = now + self.most
            self.handle.registerTimer(due)
        self.held.update((n, due))
        yield _frame(key, [(n, False)], n="int64", gone="bool")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, _ = self.held.get()
        self.held.clear()
        yield _frame(key, [(n, True)], n="int64", gone="bool")

    def close(self) -> None:
        pass
