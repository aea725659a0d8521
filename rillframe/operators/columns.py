"""Projection, filters and parsing of columns."""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COMPARISONS: dict[str, Callable[[Column, object], Column]] = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "startsWith": lambda c, v: c.startswith(v), "endsWith": lambda c, v: c.endswith(v), "contains": lambda c, v: c.contains(v),
}


def project(df: DataFrame, *positions: int) -> DataFrame:
    """Columns by position, in the order given; a position may not repeat a name."""
    return df.select(*[df.columns[i] for i in positions])


def add_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """New columns at the end; a name that exists is an error."""
    taken = sorted(set(columns) & set(df.columns))
    if taken:
        raise ValueError(f"columns exist: {', '.join(taken)}")
    return df.withColumns(columns)


def add_or_replace_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """Replaces columns in place and appends the others."""
    return df.withColumns(columns)


def rename_columns(df: DataFrame, **names: str) -> DataFrame:
    """Renames old=new; the order stays. A name that isn't there is an error."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    return df.withColumnsRenamed(names)


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def select_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Columns whose whole name matches a regular expression."""
    return df.select(df.colRegex(f"`{pattern}`"))


def compare(df: DataFrame, column: str, comparison: str, literal: object) -> DataFrame:
    """Rows whose column compares with a literal as said; pushed down to the source."""
    return df.filter(COMPARISONS[comparison](F.col(column), literal))


def tokenize(df: DataFrame, text: str, out: str = "word") -> DataFrame:
    """A row per word: lower case, cut at everything but ASCII letters, digits and underscores."""
    return df.select("*", F.explode(F.split(F.lower(F.col(text)), "[^a-z0-9_]+")).alias(out)).where(F.col(out) != "")


def union_same(left: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of inputs of one type; other names or types are an error."""
    kinds = [(f.name, f.dataType) for f in left.schema]
    for other in others:
        if [(f.name, f.dataType) for f in other.schema] != kinds:
            raise TypeError(f"types differ: {left.schema.simpleString()} and {other.schema.simpleString()}")
        left = left.union(other)
    return left


def split_by_tag(df: DataFrame, tag: Column, tags: list[str]) -> dict[str, DataFrame]:
    """One output per tag, and the rest under ''. Tags must be named and unlike each other."""
    if not all(tags) or len(set(tags)) < len(tags):
        raise ValueError("tags must be non-empty and unlike each other")
    tagged = df.withColumn("_tag", tag)
    out = {t: tagged.filter(F.col("_tag") == t).drop("_tag") for t in tags}
    return out | {"": tagged.filter(F.coalesce(~F.col("_tag").isin(tags), F.lit(True))).drop("_tag")}


def flatten_struct(df: DataFrame, separator: str = "_") -> DataFrame:
    """Nested records as flat columns named parent, separator, child."""

    def leaves(schema: StructType, path: tuple[str, ...]) -> list[Column]:
        found = []
        for field in schema:
            here = (*path, field.name)
            if isinstance(field.dataType, StructType):
                found += leaves(field.dataType, here)
            else:
                found.append(F.col(".".join(f"`{p}`" for p in here)).alias(separator.join(here)))
        return found

    return df.select(*leaves(df.schema, ()))


def parse_sensor_lines(df: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """Readings from lines of date, time, epoch, mote, temperature, humidity, light and voltage
    with single blanks between; and the lines that don't parse."""
    parts = F.split(F.col(line), " ")
    stamp = F.unix_timestamp(F.try_to_timestamp(F.concat_ws(" ", parts[0], F.regexp_replace(parts[1], r"\..*", "")), F.lit("yyyy-MM-dd HH:mm:ss")))
    cells = [F.when(F.size(parts) == 8, F.get(parts, F.lit(i)).try_cast(kind)).alias(name) for i, (name, kind) in enumerate([("", ""), ("", ""), ("epoch", "int"), ("mote", "int"), ("temperature", "double"), ("humidity", "double"), ("light", "double"), ("voltage", "double")]) if name]
    parsed = df.select("*", *cells, F.when(F.size(parts) == 8, stamp).alias("ts"))
    names = ["epoch", "mote", "temperature", "humidity", "light", "voltage", "ts"]
    fine = F.lit(True)
    for name in names:
        fine = fine & F.col(name).isNotNull()
    return parsed.where(fine).select(*names), parsed.where(~fine).select(line)


def parse_pairs(df: DataFrame, line: str = "value") -> DataFrame:
    """Lines like ``{name=a-b-c, latency=1}`` as a map column ``pairs``."""
    body = F.regexp_replace(F.col(line), r"^\{|\}$", "")
    return df.select("*", F.str_to_map(body, F.lit(", "), F.lit("=")).alias("pairs"))
