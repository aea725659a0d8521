"""Processors called without Spark, on keys with many rows."""

import numpy as np
import pandas as pd

from rillframe.streaming import state as S


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    put = update

    def clear(self):
        self.held = None


class Handle:
    def getValueState(self, name, schema, ttl=None):  # noqa: N802
        return Value()

    getListState = getValueState  # noqa: N815


def test_global_window_sums_keys_above_a_million_rows():
    trigger = S.CountTrigger("value", "event_id", 10)
    trigger.init(Handle())
    n, out = 1_200_000, []
    for at in (0, n // 2 + 3):
        ids = range(at, n // 2 + 3 if at == 0 else n)
        out += trigger.handleInputRows((1,), iter([pd.DataFrame({"event_id": ids, "value": 1.0})]), None)
    out = pd.concat(out)
    assert out["total"].tolist() == [float(k) for k in range(10, n + 1, 10)]
    assert (out["at"] + 1 == out["total"]).all()


def test_chunks_make_no_difference(monkeypatch):
    """Batches of several frames out of order, in chunks of any size, against one row after another."""
    rng = np.random.default_rng(2)
    n = 997
    frame = pd.DataFrame({"id": rng.permutation(n), "value": np.where(rng.random(n) < 0.1, np.nan, rng.integers(0, 100, n)), "ts": pd.to_datetime(rng.integers(0, 500, n) * 10_000_000_000), "side": rng.choice(["left", "right"], n), "other": "x"})
    makers = {
        "sum": lambda: S.RunningSum("value", "id"), "tumble": lambda: S.CountWindow("value", "id", 7), "slide": lambda: S.CountWindow("value", "id", 9, 4), "purge": lambda: S.CountWindow("value", "id", 5, 8, purge=True),
        "count": lambda: S.CountTrigger("value", "id", 6), "continuous": lambda: S.ContinuousTrigger("value", "ts", "id", 300), "mean": lambda: S.Accumulator("value", "id"), "connected": lambda: S.Connected("ts", "id"), "late": lambda: S.LateTag("ts", "id", 2000), "last": lambda: S.KeepLast("ts", "id"),
    }
    for name, make in makers.items():
        want = None
        for chunk in (10_000, 64, 1):
            monkeypatch.setattr(S, "CHUNK", chunk)
            processor, out = make(), []
            processor.init(Handle())
            for lot in (frame.iloc[:400], frame.iloc[400:]):
                pieces = [lot.iloc[:90], lot.iloc[90:90], lot.iloc[90:]]
                found = list(processor.handleInputRows((1,), iter(pieces), None))
                assert name == "last" or all(len(x) <= chunk for x in found)
                out += [tuple(None if pd.isna(v) else round(float(v), 6) for v in row) for x in found for row in x.itertuples(index=False)]
            want = want or out
            assert out == want and len(out) > 0, name
        assert list(processor.handleInputRows((1,), iter([]), None)) == [] or name == "last"
