"""State per key for very many keys: keys are dealt to buckets, and a bucket's keys are worked on together.

A processor by key is called for each key of a batch, and each call costs some milliseconds, as does each
timer. Here a call has all rows of a bucket, and its work is done by columns. State is still
written by key, a key's rows of it as one value, and only where a batch has changed it; one timer of a
bucket stands at whatever is due first, and what else is due by then goes with it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Buckets of a stream; a checkpoint keeps its number. More keys than some millions want more.
BUCKETS = 512
#: Where a state row has no time: those that hold what a key has come to.
NEVER = -(1 << 62)


class Bucketed(StatefulProcessor):
    """``rillframe.streaming.state.process`` groups the rows of such a processor by bucket. A subclass names the columns
    of its state in ``STATE`` and gives ``arrived``, for the rows of a batch, and ``passed``, for a timer:
    both take the bucket's state as a table with ``key`` and give what is put out and the state from then on. ``dues``
    gives the times at which state rows are due, None for processors without timers. ``BESIDE`` names columns that
    tell a key's entries of state apart, with Spark's types: each is then written alone, and has its own time to live."""

    STATE: list[tuple[str, str]] = []
    BESIDE: list[tuple[str, str]] = []
    key, kind = "key", "bigint"
    ttl_ms: int | None = None

    def arrived(self, rows: pd.DataFrame, held: pd.DataFrame, timers) -> tuple[pd.DataFrame, pd.DataFrame]:
        raise NotImplementedError

    def passed(self, held: pd.DataFrame, timers) -> tuple[pd.DataFrame, pd.DataFrame]:
        raise NotImplementedError

    def dues(self, held: pd.DataFrame) -> pd.Series | None:
        return None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", ", ".join([f"k {self.kind}", *(f"{n} {t}" for n, t in self.BESIDE)]), "rows binary", self.ttl_ms)
        self.due = handle.getValueState("due", "ms bigint")

    def _table(self, before: dict) -> pd.DataFrame:
        kind = np.dtype(self.STATE)
        data = np.frombuffer(b"".join(before.values()), kind)
        out = pd.DataFrame({name: data[name] for name, _ in self.STATE})
        sizes = [len(x) // kind.itemsize for x in before.values()]
        for k, name in enumerate(self._keys()):
            keys = pd.Series([x[k] for x in before], dtype="int64" if k == 0 and self.kind == "bigint" else object)
            out.insert(k, name, keys.to_numpy().repeat(sizes))
        return out

    def _keys(self) -> list[str]:
        return ["key", *(name for name, _ in self.BESIDE)]

    def _save(self, before: dict, held: pd.DataFrame) -> None:
        held = held.sort_values([*self._keys(), self.STATE[0][0]], kind="stable")
        data = np.empty(len(held), np.dtype(self.STATE))
        for name, _ in self.STATE:
            data[name] = held[name].to_numpy()
        keys = [held[name].to_numpy() for name in self._keys()]
        starts = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))) if len(held) else np.array([], int)
        names = zip(*(k[starts].tolist() for k in keys), strict=True)
        after = {k: data[a:b].tobytes() for k, a, b in zip(names, starts, np.append(starts, len(held))[1:], strict=True)}
        for k in before.keys() - after.keys():
            self.held.removeKey(k)
        for k, new in after.items():
            if before.get(k) != new:
                self.held.updateValue(k, (new,))

    def _step(self, timers, rows: pd.DataFrame | None) -> pd.DataFrame:
        before = {tuple(k): bytes(v[0]) for k, v in self.held.iterator()}
        out, held = self.passed(self._table(before), timers) if rows is None else self.arrived(rows, self._table(before), timers)
        self._save(before, held)
        dues = self.dues(held)
        if dues is not None:
            old = self.due.get()[0] if self.due.exists() else None
            due = None if dues.empty else int(dues.min())
            if due != old or rows is None:
                if old is not None and rows is not None:
                    self.handle.deleteTimer(old)  # one that has fired is gone
                if due is None:
                    self.due.clear()
                else:
                    self.handle.registerTimer(due)
                    self.due.update((due,))
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        found = pd.concat(list(rows), ignore_index=True).rename(columns={self.key: "key"})
        yield self._step(timerValues, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._step(timerValues, None)

    def close(self) -> None:
        pass
