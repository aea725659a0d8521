"""Scalar functions that Spark has under no name of its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_boolean(column: Column) -> Column:
    """true, false, 1 and 0 in any case; anything else is null."""
    text = F.lower(F.trim(column))
    return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)


def half_up(column: Column, places: int = 2) -> Column:
    """Rounds halves towards positive infinity, as scaling, flooring and scaling back do."""
    scale = float(10**places)
    return F.floor(column * scale + 0.5) / scale


def day_time_interval(column: Column) -> Column:
    """An interval from text like ``1 2:02:00.123``."""
    return column.cast("interval day to second")


def year_month_interval(column: Column) -> Column:
    """An interval from text like ``10-11``."""
    return column.cast("interval year to month")


def rowtime(window: Column) -> Column:
    """The last millisecond of a window."""
    return window["end"] - F.expr("INTERVAL '0.001' SECOND")


def json_increment(column: Column, field: str, schema: str, by: int = 1) -> Column:
    """The JSON record with one number raised."""
    record = F.from_json(column, schema)
    return F.to_json(record.withField(field, record[field] + by))
