"""Metrics of running streams: meters over the last minute, kept by a listener."""

from __future__ import annotations

import threading
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

ROWS = "query string, name string, batch bigint, at double, rows bigint, total bigint, rate double"


class Meter:
    """Events a second over the last ``seconds``, in a ring with a count for each second: marking
    and reading cost as much however many events there are. Times may come in any order within
    the ring; what is older counts in the total alone."""

    def __init__(self, seconds: int = 60):
        self.seconds, self.total = seconds, 0
        self.counts, self.of = [0] * seconds, [-1] * seconds

    def mark(self, n: int, at: float) -> None:
        self.total += n
        second, place = int(at), int(at) % self.seconds
        if second > self.of[place]:
            self.of[place], self.counts[place] = second, n
        elif second == self.of[place]:
            self.counts[place] += n

    def rate(self, at: float) -> float:
        """Events in the ``seconds`` up to and with the second of ``at``, a second."""
        first = int(at) - self.seconds
        return sum(n for n, second in zip(self.counts, self.of, strict=True) if first < second <= int(at)) / self.seconds


class MeterListener(StreamingQueryListener):
    """A meter for each query, marked with the rows of every progress report, and a metric row for
    each report: the last ``keep`` of them can be read as a DataFrame."""

    def __init__(self, seconds: int = 60, keep: int = 10_000):
        self.seconds, self.keep = seconds, keep
        self.meters: dict[str, Meter] = {}
        self.found: list[tuple] = []
        self.ended: set[str] = set()
        self.changed = threading.Condition()

    def report(self, query: str, name: str | None, batch: int, at: float, rows: int) -> None:
        with self.changed:
            meter = self.meters.setdefault(query, Meter(self.seconds))
            meter.mark(rows, at)
            self.found = [*self.found, (query, name, batch, at, rows, meter.total, meter.rate(at))][-self.keep :]
            self.changed.notify_all()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        at = datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")).timestamp()
        self.report(str(p.id), p.name, p.batchId, at, p.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self.changed:
            self.ended.add(str(event.id))
            self.changed.notify_all()

    def wait_for_end(self, query: str, seconds: float = 60.0) -> bool:
        """Waits until the end of a query has been reported, and so all of its progress."""
        with self.changed:
            return self.changed.wait_for(lambda: query in self.ended, seconds)

    def rows(self, spark: SparkSession) -> DataFrame:
        with self.changed:
            return spark.createDataFrame(self.found, ROWS)
