"""Streaming parts called without a stream, and sources and sinks by hand."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from rillframe.sources import streams as ST
from rillframe.streaming import changelog as L
from rillframe.streaming import triggers as G
from rillframe.streaming.matching import Matcher
from rillframe.streaming.metrics import Meter, MeterListener
from rillframe.streaming.rules import RuleBook, join_valid, valid_intervals


def best_match(rows, first, strict, within):
    """The match of a start that takes the earliest row for each step that leaves a whole match."""

    def go(step, at):
        if step == len(strict):
            return []
        for j in [at + 1] if strict[step] else range(at + 1, len(rows)):
            if j < len(rows) and rows[j][1] >> step & 1 and (rest := go(step + 1, j)) is not None:
                return [j, *rest]
        return None

    found = go(1, first)
    if found is None or within is not None and found and rows[found[-1]][0] - rows[first][0] > within:
        return None
    return [(rows[j][0], j) for j in (first, *found)]


@pytest.mark.parametrize("strict", list(itertools.product([True], [True, False], [True, False], [True, False])))
def test_matcher_against_all_sequences(strict):
    rng = np.random.default_rng(sum(2**k * s for k, s in enumerate(strict)))
    for within in (None, 6, 15):
        for _ in range(15):
            times = np.sort(rng.integers(0, 40, 30)).tolist()
            rows = [(t, int(rng.integers(0, 16))) for t in times]
            matcher, held, got = Matcher(list(strict), within), {}, {}
            for j, (t, fits) in enumerate(rows):
                got.update(matcher.row(held, (t, j), fits))
                assert all(len(parts) <= len(strict) for parts in held.values())
            for first in held:  # still open at the end
                got[first] = None
            assert got == {(t, j): best_match(rows, j, strict, within) for j, (t, fits) in enumerate(rows) if fits & 1}


class Clock:
    def __init__(self, now=0):
        self.now = now

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now

    getCurrentWatermarkInMs = getCurrentProcessingTimeInMs  # noqa: N815


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Handle:
    """One key's state and timers."""

    def __init__(self):
        self.timers, self.registered = set(), 0

    def getValueState(self, name, schema, ttl=None):  # noqa: N802
        return Value()

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)
        self.registered += 1

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)


def test_idle_keys_go_between_the_minimum_and_half_as_much_again():
    rows = pd.DataFrame({"value": [1.0]})
    for gap in (100, 499, 500, 999, 1000):
        handle, clock = Handle(), Clock()
        keeper = G.IdleRetention(1000)
        keeper.init(handle)
        for k in range(50):
            clock.now = k * gap
            assert not any(at <= clock.now for at in handle.timers)  # a busy key isn't cleaned up
            (out,) = keeper.handleInputRows((1,), iter([rows]), clock)
            assert out["n"].tolist() == [k + 1] and len(handle.timers) == 1
        idle = min(handle.timers) - clock.now
        assert 1000 <= idle <= 1500
        assert handle.registered <= 1 + 49 // max(1, 500 // gap)  # most rows of a busy key leave the timer alone


def test_sessions_of_processing_time():
    handle, clock, session = Handle(), Clock(), G.ProcessingTimeSession("value", 100)
    session.init(handle)
    out = []
    for now in (0, 60, 150, 400, 499, 599):
        clock.now = now
        out += next(session.handleInputRows((1,), iter([pd.DataFrame({"value": [1.0, None]})]), clock)).values.tolist()
        assert len(handle.timers) == 1
    closed = [x[1:] for x in out if x[-1]]
    assert closed == [[0, 6, 3.0, True], [400, 4, 2.0, True]]


def test_meter_over_a_scripted_minute():
    """Rates are rows over seconds of the last minute, whatever comes before and in whatever order."""
    rng = np.random.default_rng(3)
    meter, marks = Meter(60), []
    for k in range(400):
        at, n = 1000 + k * 0.7 + float(rng.integers(-5, 5)), int(rng.integers(0, 90))
        meter.mark(n, at)
        marks.append((int(at), n))
        now = max(t for t, _ in marks)
        assert meter.rate(now) == pytest.approx(sum(n for t, n in marks if now - 60 < t <= now) / 60)
    assert meter.total == sum(n for _, n in marks)
    assert meter.rate(now + 1000) == 0


def test_listener_keeps_queries_apart(spark):
    listener = MeterListener(60, keep=5)
    for k in range(8):
        listener.report("a", None, k, 100.0 + k, 60)
        listener.report("b", "named", k, 100.0 + k, 6)
    rows = listener.rows(spark).collect()
    assert len(rows) == 5 and rows[-1].total == 48 and rows[-1].rate == pytest.approx(48 / 60) and rows[-2].rate == pytest.approx(8)


def test_applied_changelog(spark):
    log = [("a", 0, "+I", 1), ("a", 1, "-U", 1), ("a", 2, "+U", 2), ("b", 0, "+I", 5), ("b", 1, "-D", 5), ("c", 0, "+I", 1), ("c", 1, "-D", 1), ("c", 2, "+I", 9), (None, 0, "+I", 3)]
    df = spark.createDataFrame(log, "k string, seq bigint, kind string, n bigint")
    for rows in (df, df.orderBy(F.desc("seq"))):
        assert {tuple(r) for r in L.applied(rows, "k").collect()} == {("a", 2), ("c", 9), (None, 3)}
    assert L.applied(df.limit(0), "k").count() == 0


def test_valid_rules(spark):
    versions = spark.createDataFrame([("a", 10, 1.0, 1), ("a", 20, 2.0, 1), ("a", 20, 2.5, 2), ("b", 15, 7.0, 1)], "k string, since bigint, rate double, published bigint")
    rows = spark.createDataFrame([(k, t) for k in ("a", "b", "c", None) for t in (9, 10, 19, 20, 30, None)], "k string, t bigint")
    got = {(r.k, r.t): r.rate for r in join_valid(rows, valid_intervals(versions, "k", "since", "published"), "k", "t", "since").collect()}
    assert got == {(k, t): None if k in ("c", None) or t is None else ({9: None, 10: 1.0, 19: 1.0, 20: 2.5, 30: 2.5}[t] if k == "a" else 7.0 if t >= 15 else None) for k, t in got} and len(got) == 24


def test_a_rule_book_without_rules(spark):
    book = RuleBook(spark, "k string, since bigint, rate double", "k", "since")
    rows = spark.createDataFrame([("a", 1)], "k string, t bigint")
    assert [tuple(r) for r in book.look_up(rows, "t").collect()] == [("a", 1, None)]
    again = RuleBook(spark, "k string, since bigint, rate double", "k", "since", book.path)
    book.publish(spark.createDataFrame([("a", 0, 1.0)], "k string, since bigint, rate double"))
    again.publish(spark.createDataFrame([("a", 0, 2.0)], "k string, since bigint, rate double"))
    assert [tuple(r) for r in book.look_up(rows, "t").collect()] == [("a", 1, 2.0)]


def test_log_offsets_and_ranges(spark, tmp_path):
    rows = spark.range(100).select("id", (F.col("id") % 3).cast("string").alias("s"), F.timestamp_seconds("id").alias("ts"))
    path = str(tmp_path / "log")
    schema = ST.StructType.fromDDL("id bigint, split string, offset bigint, record_ts timestamp")
    reader = ST.SplitLogReader(path, schema, 0, "ts")
    assert reader.latestOffset() == {}
    ST.append_to_log(rows.where("id < 50"), path, "s", 0)
    first = reader.latestOffset()
    assert first == {"0": 17, "1": 17, "2": 16}
    ST.append_to_log(rows.where("id >= 50"), path, "s", 1)
    (tmp_path / "log" / "part=000002" / "_split=0").mkdir(parents=True)  # a part that is still being written
    second = reader.latestOffset()
    assert sum(second.values()) == 100
    got = [[r for p in reader.partitions(a, b) for batch in reader.read(p) for r in batch.to_pylist()] for a, b in (({}, first), (first, {"0": 20, "1": 17, "2": 16}), ({"0": 20, "1": 17, "2": 16}, second))]
    assert [len(x) for x in got] == [50, 3, 47]
    assert sorted(r["id"] for x in got for r in x) == list(range(100))
    assert all(r["record_ts"].timestamp() == r["id"] and int(r["split"]) == r["id"] % 3 for x in got for r in x)
    assert sorted((r["split"], r["offset"]) for x in got for r in x) == [(s, k) for s in "012" for k in range(second[s])]
    limited = ST.SplitLogReader(path, schema, 5, "ts")
    assert limited.latestOffset() == {"0": 5, "1": 5, "2": 5}
    limited.partitions({}, {"0": 5, "1": 5, "2": 5})
    assert limited.latestOffset() == {"0": 10, "1": 10, "2": 10}


def test_folder_writer(spark, tmp_path):
    path, schema = str(tmp_path / "out"), ST.StructType.fromDDL("a bigint, b string")
    writer = ST.FolderWriter(path, schema)
    rows = lambda *ids: iter([Row(a=k, b=None if k % 2 else "x") for k in ids])
    read = lambda: sorted(tuple(r) for r in ST.committed(spark, path, schema).collect())
    messages = [writer.write(rows(1, 2)), writer.write(rows()), writer.write(rows(3))]
    assert messages[1].file is None
    writer.commit([*messages, None], 0)
    want = [(1, None, 0), (2, "x", 0), (3, None, 0)]
    assert read() == want
    pending = writer.write(rows(4))
    assert read() == want
    writer.abort([pending, None], 1)
    writer.commit([writer.write(rows(9))], 0)
    assert read() == want and len(list((tmp_path / "out" / "data").glob("*.parquet"))) == 2
    writer.commit([], 1)
    writer.commit([writer.write(rows(5))], 2)
    assert read() == [*want, (5, None, 2)]
