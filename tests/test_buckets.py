"""Processors that work on many keys at once."""

import numpy as np
import pandas as pd

from rillframe.streaming.buckets import Bucketed
from rillframe.streaming.changelog import ChangelogAggregate
from rillframe.streaming.lateness import LatenessWindows
from rillframe.streaming.matching import SequenceMatch
from rillframe.streaming.state import CountsByValue, EventTimeSort
from rillframe.streaming.triggers import EventTimeTrigger, ProcessingTimeTrigger


class Timers:
    now = 0

    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.watermark

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now


def rows_of(keys):
    at = pd.to_datetime(np.array([1_000, 1_500, 12_000, 25_000] * keys), unit="ms")
    return pd.DataFrame({"key": np.repeat(np.arange(keys), 4), "ts": at, "value": [1.0, None, 2.0, 4.0] * keys})


def none(processor):
    return pd.DataFrame({"key": pd.Series(dtype="int64"), **{n: pd.Series(dtype=np.dtype(t)) for n, t in processor.STATE}})


def test_triggers_of_many_keys_in_one_call():
    for purge, totals in ((False, [1.0, 3.0]), (True, [1.0, 2.0])):
        trigger = EventTimeTrigger("value", "ts", 10_000, purge)
        assert isinstance(trigger, Bucketed)
        _, held = trigger.arrived(rows_of(3_000), none(trigger), Timers(0))
        out, held = trigger.passed(held, Timers(20_000))
        assert len(out) == 6_000 and out[out["key"] == 7][["at", "total"]].values.tolist() == [[10, totals[0]], [20, totals[1]]]
        _, held = trigger.arrived(rows_of(1), held, Timers(20_000))  # all count towards what is open
        out, held = trigger.passed(held, Timers(30_000))
        assert out[out["key"] == 0]["total"].tolist() == [11.0 if purge else 14.0] and trigger.dues(held).empty


def test_lateness_of_many_keys_in_one_call():
    windows = LatenessWindows("value", "ts", 10_000, 10_000)
    assert isinstance(windows, Bucketed)
    _, held = windows.arrived(rows_of(3_000), none(windows), Timers(0))
    out, held = windows.passed(held, Timers(20_000))
    assert out["kind"].tolist() == ["first"] * 6_000 and sorted(windows.dues(held).unique()) == [30_000]
    out, held = windows.arrived(rows_of(1), held, Timers(20_000))
    assert sorted(out[["start", "kind", "n", "total"]].itertuples(index=False, name=None)) == [(0, "rejected", 2, 1.0), (10_000, "corrected", 2, 4.0)]


def test_changelog_of_many_keys_in_one_call():
    aggregate = ChangelogAggregate()
    assert isinstance(aggregate, Bucketed)
    first = pd.DataFrame({"key": range(3_000), "sign": 1, "value": 2.0})
    out, held = aggregate.arrived(first, none(aggregate), None)
    assert len(out) == 3_000 and set(out["kind"]) == {"+I"}
    out, held = aggregate.arrived(pd.DataFrame({"key": [1, 2, 3, 3], "sign": [-1, 1, 1, -1], "value": [2.0, 5.0, 1.0, 1.0]}), held, None)
    assert list(out.itertuples(index=False, name=None)) == [(1, 1, "-D", 1, 2.0), (2, 1, "-U", 1, 2.0), (2, 2, "+U", 2, 7.0)]
    assert len(held) == 3_000 and held[held["key"] == 2]["seq"].tolist() == [3]


def test_sequences_of_many_keys_in_one_call():
    keys, second = 3_000, 1_000_000
    for within, last in ((None, 7), (5, None)):
        matches = SequenceMatch([True, False, True], within and within * second, ["a", "b", "c"], True)
        assert isinstance(matches, Bucketed)
        frame = lambda rows: pd.DataFrame([(k, pd.Timestamp(at, unit="s"), i, f) for k in range(keys) for at, i, f in rows], columns=["key", "at", "id", "fits"])
        out, held = matches.arrived(frame([(1, 1, 1), (1, 1, 1), (9, 7, 4)]), none(matches), Timers(0))
        out, held = matches.passed(held, Timers(5_000))  # two starts of each key, alike in time and id
        assert out.empty and len(held) == 3 * keys and matches.dues(held).min() == (9_001 if within is None else 6_001)
        out, held = matches.arrived(frame([(8, 6, 2), (6, 5, 0)]), held, Timers(5_000))
        out, held = matches.passed(held, Timers(10_000))
        assert len(out) == 2 * keys and held.empty and matches.dues(held).empty
        assert set(out[["a", "b", "c"]].astype(object).where(out[["a", "b", "c"]].notna(), None).itertuples(index=False, name=None)) == {(1, 6, 7) if last else (1, None, None)}
        assert (out["timed_out"] == (last is None)).all()


def test_event_time_order_of_many_keys_in_one_call():
    order = EventTimeSort("ts", "id")
    assert isinstance(order, Bucketed)
    frame = lambda keys, *rows: pd.DataFrame([(k, pd.Timestamp(at, unit="s"), i) for k in range(keys) for at, i in rows], columns=["key", "ts", "id"])
    rows = pd.concat([frame(3_000, (3, 1), (1, 9), (1, 8), (1, 8), (20, 2)), pd.DataFrame({"key": [5], "ts": [pd.NaT], "id": [77]})], ignore_index=True)
    out, held = order.arrived(rows, none(order), Timers(0))
    assert out.empty and order.dues(held).min() == 1_001
    out, held = order.passed(held, Timers(10_000))
    assert len(out) == 12_000 and out[out["key"] == 5][["id", "place"]].values.tolist() == [[8, 1], [8, 2], [9, 3], [1, 4]]
    _, held = order.arrived(frame(1, (15, 3)), held, Timers(10_000))
    out, held = order.passed(held, Timers(30_000))
    assert out[out["key"] == 0][["id", "place"]].values.tolist() == [[3, 5], [2, 6]] and len(out) == 3_001
    assert order.dues(held).empty and held["n"].sum() == len(rows) - 1 + 1


def test_processing_time_triggers_of_many_keys_in_one_call():
    trigger, clock = ProcessingTimeTrigger("value", 1_000), Timers(0)
    assert isinstance(trigger, Bucketed)
    some = lambda keys: pd.DataFrame({"key": np.repeat(np.arange(keys), 2), "value": [1.0, None] * keys})
    for now, keys in ((0, 2_000), (600, 3_000)):  # the first 2,000 wait already
        clock.now = now
        out, held = trigger.arrived(some(keys), held if now else none(trigger), clock)
        assert out.empty and list(out) == ["key", "n", "total"]
    clock.now = 1_000
    out, held = trigger.passed(held, clock)
    assert set(out["key"]) == set(range(2_000)) and set(zip(out["n"], out["total"], strict=True)) == {(4, 2.0)} and set(trigger.dues(held)) == {1_600}
    clock.now = 1_700
    _, held = trigger.arrived(some(1), held, clock)
    out, held = trigger.passed(held, clock)
    assert set(out["key"]) == set(range(2_000, 3_000)) and trigger.dues(held).tolist() == [2_700]
    clock.now = 2_700
    out, held = trigger.passed(held, clock)
    assert out.values.tolist() == [[0, 6, 3.0]] and trigger.dues(held).empty and len(held) == 3_000


def test_counts_by_value_of_many_keys_in_one_call():
    counts = CountsByValue("kind")
    assert isinstance(counts, Bucketed)
    held = pd.DataFrame({"key": [1, 1], "value": ["a", "b"], "n": [4, 5]})
    rows = pd.DataFrame({"key": np.repeat(np.arange(3_000), 3), "kind": ["a", "a", None] * 3_000})
    out, held = counts.arrived(rows, held, None)
    assert len(out) == 6_000 and out[out["key"] == 1].values.tolist() == [[1, "", 1], [1, "a", 6]]
    assert held[held["key"] == 1].values.tolist() == [[1, "", 1], [1, "a", 6], [1, "b", 5]]

    class Held(dict):
        written = 0

        def updateValue(self, k, v):  # noqa: N802
            self[k], self.written = v, self.written + 1

        removeKey = dict.__delitem__  # noqa: N815

    counts.held, before = Held(), {}
    for n, some in ((6_001, held), (1, held.assign(n=held["n"] + (held["value"] == "b"))), (0, held[held["value"] != "b"])):
        counts._save(before, some)
        before = {k: v[0] for k, v in counts.held.items()}
        assert counts.held.written == n  # what has changed, by key and value
        assert counts._table(before)[["key", "value", "n"]].values.tolist() == some.values.tolist()
        counts.held.written = 0
