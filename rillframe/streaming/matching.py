"""Sequence patterns on streams: a state machine per key over rows in the order of their times."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.operators.patterns import Step
from rillframe.streaming.buckets import Bucketed
from rillframe.streaming.state import process

#: (micros, id, number) of a row: rows of equal time come in the order of their ids.
Place = tuple[int, ...]


class Matcher:
    """Partial matches of a pattern, moved on by one row at a time.

    Every row that fits the first step starts a match of its own. A partial match is a list of
    places, one for each step that it has come to. One that waits for a relaxed step stays and also
    goes on by each row that fits, so that a strict step behind it may fail for one row and hold
    for a later one; of those of a start that wait for the same relaxed step, only the earliest can
    ever be put out and is kept. So a start has as many partial matches as the pattern has steps, at
    most. It ends with the first row that completes one of them, or unmatched: when none is left,
    or once ``within`` microseconds from its first row have passed.
    """

    def __init__(self, strict: list[bool], within: int | None):
        self.strict, self.within = strict, within

    def row(self, held: dict[Place, list[list[Place]]], at: Place, fits: int) -> Iterator[tuple[Place, list[Place] | None]]:
        """Feeds a row, whose bits in ``fits`` tell the steps that it fits; changes ``held`` and gives
        the starts that end, with their match or None."""
        steps = len(self.strict)
        for first in list(held):
            if self.within is not None and at[0] - first[0] > self.within:
                del held[first]
                yield first, None
                continue
            live: dict[tuple[int, bool], list[Place]] = {}  # by the step waited for
            for part in held[first]:
                step = len(part)
                moved = [*part, at] if fits >> step & 1 else None
                stays = part if not self.strict[step] else None
                for new in (moved, stays):
                    if new is not None and (len(new) not in live or new < live[len(new)]):
                        live[len(new)] = new
            if steps in live:
                del held[first]
                yield first, live[steps]
            elif live:
                held[first] = [live[n] for n in sorted(live)]
            else:
                del held[first]
                yield first, None
        if fits & 1:
            if steps == 1:
                yield at, [at]
            else:
                held[at] = [[at]]

    def expired(self, held: dict[Place, list[list[Place]]], passed: int) -> Iterator[tuple[Place, None]]:
        """Ends the starts that no row at ``passed`` or later can complete in time."""
        if self.within is not None:
            for first in [x for x in held if x[0] + self.within < passed]:
                del held[first]
                yield first, None


class SequenceMatch(Bucketed):
    """Puts out the matches of a :class:`Matcher`, and with ``ends`` the starts that found none.

    State holds rows that the watermark has not passed, with what they fit, and partial matches with
    their places one behind another; a bucket's keys are worked on in one call. The bucket's event-time timer
    stands at whichever comes first: a row that can go, or the end of a start's time. Rows of one time and
    id are told apart by a number.
    """

    def __init__(self, strict: list[bool], within: int | None, names: list[str], ends: bool):
        self.matcher, self.names, self.ends = Matcher(strict, within), names, ends
        self.places = [f"{x}{k}" for k in range(max(1, len(strict) - 1)) for x in ("at", "id", "no")]
        #: A row that waits has its own place and no steps; a partial match has the places of its ``steps``.
        self.STATE = [*((x, "i8") for x in self.places), ("fits", "i8"), ("steps", "i8")]

    def _frame(self, found: list[tuple[object, Place, list[Place] | None]]) -> pd.DataFrame:
        columns = {"key": pd.Series([x[0] for x in found], dtype=object)}
        for k, name in enumerate(self.names):
            columns[name] = pd.array([first[1] if k == 0 else m[k][1] if m else None for _, first, m in found], dtype="Int64")
        columns["timed_out"] = pd.Series([m is None for _, _, m in found], dtype=bool)
        return pd.DataFrame(columns)

    def arrived(self, rows, held, timers) -> tuple[pd.DataFrame, pd.DataFrame]:
        micros = rows["at"].astype("datetime64[us]").astype("int64")
        new = pd.DataFrame({"key": rows["key"], "at0": micros, "id0": rows["id"].astype("int64"), "fits": rows["fits"].astype("int64")})
        return self._frame([]), pd.concat([held, new.reindex(columns=held.columns, fill_value=0)])

    def passed(self, held, timers) -> tuple[pd.DataFrame, pd.DataFrame]:
        passed = timers.getCurrentWatermarkInMs() * 1000
        waits = held["steps"] == 0
        ready = waits & (held["at0"] < passed)
        partial: defaultdict = defaultdict(dict)  # by key, by start
        for key, *flat, _, steps in held[~waits].itertuples(index=False, name=None):
            part = [tuple(flat[k : k + 3]) for k in range(0, 3 * steps, 3)]
            partial[key].setdefault(part[0], []).append(part)
        rows = held.loc[ready, ["key", "at0", "id0", "fits"]].sort_values(["key", "at0", "id0", "fits"])
        rows["no0"] = rows.groupby(["key", "at0", "id0"]).cumcount()
        found = []
        for key, at, id_, fits, no in rows.itertuples(index=False, name=None):
            found += [(key, *x) for x in self.matcher.row(partial[key], (at, id_, no), fits)]
        left = []
        for key, starts in partial.items():
            found += [(key, *x) for x in self.matcher.expired(starts, passed)]
            left += [(key, *sum(part, ()), *[0] * (len(self.places) - 3 * len(part)), 0, len(part)) for parts in starts.values() for part in parts]
        left = pd.DataFrame(left, columns=held.columns)
        return self._frame([x for x in found if x[2] is not None or self.ends]), pd.concat([held[waits & ~ready], left]) if len(left) else held[waits & ~ready]

    def dues(self, held) -> pd.Series:
        waits = held["steps"] == 0
        ends = held.loc[~waits, "at0"] + self.matcher.within if self.matcher.within is not None else held.loc[[], "at0"]
        return pd.concat([held.loc[waits, "at0"], ends]) // 1000 + 1


def match_stream(df: DataFrame, key: str, ts: str, row_id: str, steps: list[Step], within_seconds: int | None = None, ends: bool = True, delay: str = "0 seconds") -> DataFrame:
    """Streams: every row that starts the pattern with the rows of its first match, as
    :func:`rillframe.operators.patterns.next_match` gives it for a batch. ``key``, a column for each
    step and ``timed_out``: true, with null ids behind the first, for starts that found no end or
    not ``within_seconds`` of their first row; ``ends=False`` leaves these out.

    Rows come in any order within ``delay``; rows that are later yet are dropped. Rows of equal time
    follow their ids; rows without a time or an id are left out. A start is put out once the watermark has passed what decides it. Rows that fit
    no step are only sent on where a strict step needs them."""
    fits = sum((F.when(F.expr(s.condition), F.lit(1 << k)).otherwise(F.lit(0)) for k, s in enumerate(steps)), F.lit(0))
    rows = df.withWatermark(ts, delay).select(F.col(key).alias("key"), F.col(ts).alias("at"), F.col(row_id).alias("id"), fits.cast("int").alias("fits"))
    # One condition that names the time: Spark would put another below the watermark, which would then miss these rows.
    wanted = F.lit(True) if any(s.strict for s in steps[1:]) else F.col("fits") != 0
    rows = rows.where(F.when(F.col("at").isNull() | F.col("id").isNull(), F.lit(False)).otherwise(wanted))
    within = None if within_seconds is None else within_seconds * 1_000_000
    kind = df.schema[key].dataType.simpleString()
    schema = ", ".join([f"key {kind}", *(f"{s.name} bigint" for s in steps), "timed_out boolean"])
    found = process(rows, "key", SequenceMatch([s.strict for s in steps], within, [s.name for s in steps], ends), schema, time_mode="EventTime")
    return found.withColumnRenamed("key", key)
