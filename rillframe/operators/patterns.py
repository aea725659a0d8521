"""Sequence patterns over keyed, time-ordered rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """A pattern's step: a name, a SQL condition, and whether it must follow at once (``strict``)
    or at any later row of the key."""

    name: str
    condition: str
    strict: bool = True


def strict_sequence(df: DataFrame, key: str, order: list[str], steps: list[Step], row_id: str) -> DataFrame:
    """Matches whose steps are neighbouring rows: one window, no join. A column per step holds the
    id of the row that it matched."""
    w = Window.partitionBy(key).orderBy(*order)
    flagged = df.withColumns({f"_is_{s.name}": F.coalesce(F.expr(s.condition), F.lit(False)) for s in steps})
    ahead = flagged.withColumns({f"_{s.name}": F.struct(F.lead(row_id, k).over(w).alias("id"), F.lead(f"_is_{s.name}", k).over(w).alias("fits")) for k, s in enumerate(steps)})
    fits = F.lit(True)
    for s in steps:
        fits = fits & F.coalesce(F.col(f"_{s.name}.fits"), F.lit(False))
    return ahead.where(fits).select(key, *[F.col(f"_{s.name}.id").alias(s.name) for s in steps])


def next_match(df: DataFrame, key: str, order: list[str], steps: list[Step], row_id: str, ts: str, within_seconds: int | None = None) -> DataFrame:
    """Every row that starts the pattern, with the first later row for each further step: relaxed
    steps skip rows that don't fit, strict ones must be the very next row. A pass of windows from
    the last step back, in time linear in the rows of a key once they are sorted. ``order`` are columns, ascending. ``within_seconds`` bounds the
    time from first to last; ``timed_out`` marks starts that found no end in time."""
    w = Window.partitionBy(key).orderBy(*order)
    # Backwards, so that the frame grows by a row at a time; frames that reach to a key's end are computed anew for each row.
    later = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumns({f"_is_{s.name}": F.coalesce(F.expr(s.condition), F.lit(False)) for s in steps})
    chain = F.struct(F.struct(F.col(row_id).alias("id"), F.col(ts).alias("ts")).alias(steps[-1].name))
    out = out.withColumn("_chain", F.when(F.col(f"_is_{steps[-1].name}"), chain))
    for k in range(len(steps) - 2, -1, -1):
        follower = F.lead("_chain").over(w) if steps[k + 1].strict else F.last("_chain", ignorenulls=True).over(later)
        out = out.withColumn("_next", follower)
        fields = [F.col(f"_next.{s.name}").alias(s.name) for s in steps[k + 1 :]]
        here = F.struct(F.struct(F.col(row_id).alias("id"), F.col(ts).alias("ts")).alias(steps[k].name), *fields)
        whole = F.when(F.col(f"_is_{steps[k].name}") & F.col("_next").isNotNull(), here)
        out = out.withColumn("_chain", whole)
    started = out.where(F.col(f"_is_{steps[0].name}"))
    last = F.col(f"_chain.{steps[-1].name}.ts")
    in_time = last.isNotNull() if within_seconds is None else F.coalesce(F.unix_micros(last) - F.unix_micros(ts) <= within_seconds * 1_000_000, F.lit(False))
    return started.select(key, F.col(row_id).alias(steps[0].name), *[F.when(in_time, F.col(f"_chain.{s.name}.id")).alias(s.name) for s in steps[1:]], (~in_time).alias("timed_out"))
