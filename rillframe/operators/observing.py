"""Workload observation: what steps of a pipeline let through, plan tables, and prediction metrics."""

from __future__ import annotations

import json
import os
import re
import socket
import time
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from rillframe.operators.aggregates import draw, percentiles
from rillframe.operators.ranking import numbered

#: Features of every operator, of all but sources, and by kind (fixed names).
COMMON = ["tupleWidthOut", "parallelism", "component"]
INNER = ["tupleWidthIn", "avgRealSelectivity"]
FEATURES: dict[str, list[str]] = {
    "source": ["numString", "numDouble", "numInteger", "confEventRate", *COMMON],
    "filter": ["filterFunction", "filterClass", *INNER, *COMMON],
    "join": ["joinKeyClass", "windowType", "windowPolicy", "slidingLength", "windowLength", *INNER, *COMMON],
    "windowedAggregate": ["windowLength", "aggClass", "windowType", "windowPolicy", "slidingLength", "aggFunction", "keyByClass", *INNER, *COMMON],
    "physical": ["networkLinkSpeed", "totalMemory", "physicalCPUCores", "maxCPUFreq"],
}


def observe_step(df: DataFrame, step: Callable[[DataFrame], DataFrame], name: str) -> dict[str, float]:
    """Runs one step and tells rows in and out, selectivity, the mean number of fields with values of
    a row in and out, and rows in and out a second; what is counted is gathered beside the run, which
    writes nothing."""
    before, after = Observation(f"{name} in"), Observation(f"{name} out")

    def width(df: DataFrame) -> Column:
        return F.sum(sum((F.col(c).isNotNull().cast("bigint") for c in df.columns), F.lit(0))).alias("fields")

    out = step(df.observe(before, F.count("*").alias("n"), width(df)))
    out = out.observe(after, F.count("*").alias("n"), width(out))
    began = time.perf_counter()
    out.write.format("noop").mode("overwrite").save()
    seconds = time.perf_counter() - began
    rows_in, rows_out = before.get["n"], after.get["n"]
    mean = lambda seen, n: seen.get["fields"] / n if n else None
    return {
        "step": name, "rows_in": rows_in, "rows_out": rows_out, "selectivity": rows_out / rows_in if rows_in else None,
        "width_in": mean(before, rows_in), "width_out": mean(after, rows_out), "rate_in": rows_in / seconds, "rate_out": rows_out / seconds,
    }


def observe_join(left: DataFrame, right: DataFrame, join: Callable[[DataFrame, DataFrame], DataFrame], name: str) -> dict[str, float]:
    """As :func:`observe_step` for a step with two inputs: the selectivity is that of all pairs, and the
    width of what comes in is that of a row of either side together."""
    seen = {side: Observation(f"{name} {side}") for side in ("left", "right", "out")}

    def watched(df: DataFrame, side: str) -> DataFrame:
        fields = F.sum(sum((F.col(c).isNotNull().cast("bigint") for c in df.columns), F.lit(0))).alias("fields")
        return df.observe(seen[side], F.count("*").alias("n"), fields)

    watched(join(watched(left, "left"), watched(right, "right")), "out").write.format("noop").mode("overwrite").save()
    n = {side: x.get["n"] for side, x in seen.items()}
    width = {side: x.get["fields"] / n[side] if n[side] else None for side, x in seen.items()}
    pairs = n["left"] * n["right"]
    both = None if None in (width["left"], width["right"]) else width["left"] + width["right"]
    return {"step": name, "rows_left": n["left"], "rows_right": n["right"], "rows_out": n["out"], "selectivity": n["out"] / pairs if pairs else None, "width_in": both, "width_out": width["out"]}


def join_step(left: DataFrame, keys: list[str], length: int, slide: int | None = None) -> dict:
    """What a windowed join has of its description: the type of its key, and its window in seconds."""
    kinds = {left.schema[k].dataType.simpleString() for k in keys}
    return {"joinKeyClass": kinds.pop() if len(kinds) == 1 else "mixed", "windowType": "tumbling" if slide in (None, length) else "sliding", "windowPolicy": "time", "windowLength": length, "slidingLength": slide or length}


def features(kind: str, step: dict, no_joins: bool = False) -> dict:
    """The features that a kind of operator has, of what is known of a step; joins have none in a set
    of plans without joins. Features that aren't known are missing, and nothing else is in it."""
    return {} if kind == "join" and no_joins else {name: step[name] for name in FEATURES[kind] if step.get(name) is not None}


NODE = "host string, physicalCPUCores bigint, totalMemory bigint, maxCPUFreq double, networkLinkSpeed bigint"


def physical_nodes(spark: SparkSession) -> DataFrame:
    """The hosts that tasks run on, as far as tasks can tell: cores, bytes of memory, the highest clock in MHz, and
    the fastest link in Mbit/s; null where the system doesn't say."""

    def look(frames):
        def read(path: str) -> str:
            try:
                return Path(path).read_text()
            except (OSError, UnicodeDecodeError):
                return ""

        for frame in frames:
            if not len(frame):
                continue
            memory = re.search(r"MemTotal:\s+(\d+)", read("/proc/meminfo"))
            clocks = [float(x) for x in re.findall(r"cpu MHz\s*:\s*([\d.]+)", read("/proc/cpuinfo"))]
            links = [int(x) for p in Path("/sys/class/net").glob("*/speed") if (x := read(str(p)).strip()).isdigit()]
            yield pd.DataFrame({"host": [socket.gethostname()], "physicalCPUCores": [os.cpu_count()], "totalMemory": [int(memory[1]) * 1024 if memory else None], "maxCPUFreq": [max(clocks, default=None)], "networkLinkSpeed": [max(links, default=None)]})

    tasks = spark.sparkContext.defaultParallelism * 4  # so that every host gets some
    found = spark.range(0, tasks, 1, tasks).mapInPandas(look, NODE)
    return found.groupBy("host").agg(*(F.max(c).alias(c) for c in FEATURES["physical"]))


def plan_steps(df: DataFrame) -> list[dict]:
    """The steps of a DataFrame's plan as it was written, sources first: kind, and what its kind has of the
    relation's columns by type, filter function and literal, aggregate functions, join keys, and
    length and slide of a window that is grouped by, in seconds."""
    nodes = json.loads(df._jdf.queryExecution().logical().toJSON())
    kinds = {"Filter": "filter", "Aggregate": "windowedAggregate", "Join": "join"}
    steps = []
    for node in reversed(nodes):  # the plan's nodes stand in prefix order
        name = node["class"].rsplit(".", 1)[-1]
        inside = [x["class"].rsplit(".", 1)[-1] for x in _expressions(node)]
        if name == "LogicalRelation":
            types = [x["dataType"] for x in _expressions(node) if x["class"].endswith("AttributeReference")]
            number = lambda *of: sum(isinstance(x, str) and x in of for x in types)  # noqa: E731,B023
            steps.append({"type": "source", "numString": number("string"), "numDouble": number("double", "float"), "numInteger": number("integer", "long", "short", "byte")})
        elif name in kinds:
            step: dict = {"type": kinds[name]}
            literals = [x.get("value") for x in _expressions(node) if x["class"].endswith(".Literal")]
            if name == "Filter":
                step |= {"filterFunction": next((x for x in inside if x not in ("And", "Or", "Not", "IsNotNull", "AttributeReference", "Literal")), None), "literal": next((str(x) for x in literals if x is not None), None)}
            if name == "Join":
                step |= {"key": next((x["name"] for x in _expressions(node) if x["class"].endswith("AttributeReference")), None)}
            if name == "Aggregate":
                calls = [(k, x["nameParts"].strip("[]")) for k, x in enumerate(_expressions(node)) if "nameParts" in x and x["class"].endswith("UnresolvedFunction")]
                step["aggFunction"] = next((f for _, f in calls if f != "window"), None)
                at = next((k for k, f in calls if f == "window"), None)
                if at is not None:
                    length, slide = (int(pd.Timedelta(x["value"]).total_seconds()) for x in [x for x in _expressions(node)[at:] if x["class"].endswith(".Literal")][:2])
                    step["window"] = {"type": "tumbling" if length == slide else "sliding", "length": length, "slide": slide}
            steps.append(step)
    return steps


def _expressions(node: dict) -> list[dict]:
    """All expressions in a plan node's fields, outermost first."""
    found: list[dict] = []

    def walk(value) -> None:
        if isinstance(value, dict):
            if ".expressions." in value.get("class", "") or ".analysis." in value.get("class", ""):
                found.append(value)
            for inner in value.values():
                walk(inner)
        elif isinstance(value, list):
            for inner in value:
                walk(inner)

    walk({k: v for k, v in node.items() if k != "class"})
    return found


def plan_nodes(spark: SparkSession, steps: list[dict]) -> DataFrame:
    """A row for each step: windows have no parallelism of their own, a slide that isn't given is
    the length, and joins take their window's fields."""
    rows = []
    for k, s in enumerate(steps):
        window = s.get("window", {})
        rows.append((k, s["type"], None if s["type"] == "window" else s.get("parallelism", 1), window.get("type"), window.get("length"), window.get("slide", window.get("length")), s.get("literal"), s.get("key")))
    return spark.createDataFrame(rows, "id bigint, operator_type string, parallelism bigint, window_type string, window_length bigint, sliding_length bigint, literal string, join_key string")


def encode_features(df: DataFrame, numeric: list[str], categorical: list[str], most: int = 32) -> DataFrame:
    """Features in name order: numbers as they are, categories as indicator columns where they have
    ``most`` values at most, else as their rank among the values. A feature that isn't there is an error."""
    missing = sorted({*numeric, *categorical} - set(df.columns))
    if missing:
        raise ValueError(f"no such features: {', '.join(missing)}")
    out: list[Column] = []
    ranks = df
    for name in sorted([*numeric, *categorical]):
        if name in numeric:
            out.append(F.col(name).cast("double").alias(name))
            continue
        values = [r[0] for r in df.select(name).where(F.col(name).isNotNull()).distinct().orderBy(name).limit(most + 1).collect()]
        if len(values) <= most:
            out += [F.coalesce((F.col(name) == v).cast("double"), F.lit(0.0)).alias(f"{name}_{v}") for v in values]
        else:
            values = df.select(name).where(F.col(name).isNotNull()).distinct()
            index = numbered(values, name, name="_at").select(name, (F.col("_at") - 1).cast("double").alias(f"{name}_index"))
            ranks = ranks.join(index, name, "left")
            out.append(F.col(f"{name}_index"))
    return ranks.select(*out)


def q_error(label: Column, pred: Column) -> Column:
    """The larger of both ratios of the absolute values; infinite where one is zero or not a number."""
    a, b = F.abs(label), F.abs(pred)
    safe = (a > 0) & (b > 0) & ~F.isnan(a) & ~F.isnan(b)
    return F.when(safe, F.greatest(F.try_divide(a, b), F.try_divide(b, a))).otherwise(F.lit(float("inf")))


def rmse(label: Column, pred: Column) -> Column:
    return F.sqrt(F.avg(F.pow(label - pred, F.lit(2))))


def mape(label: Column, pred: Column) -> Column:
    return F.avg(F.abs((label - pred) / label))


def q_loss(label: Column, pred: Column, least: float = 1e-3) -> Column:
    """The mean ratio, with a penalty for predictions that are hardly positive."""
    return F.avg(F.when(pred < least, (1 - pred) * 100).otherwise(F.greatest(F.try_divide(label, pred), F.try_divide(pred, label))))


def best_so_far(df: DataFrame, order: str, value: str, maximize: bool, by: str) -> DataFrame:
    """Each epoch with the best value up to it, and whether it is strictly better than all before."""
    w = Window.partitionBy(by).orderBy(order)
    best = F.max if maximize else F.min
    before = best(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = F.coalesce(F.col(value) > before if maximize else F.col(value) < before, F.lit(True))
    return df.select("*", best(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("best"), better.alias("improved"))


def merge_sets(sets: dict[str, DataFrame], key: str, most: int) -> DataFrame:
    """All sets as one: ids that several sets use get their set's name in front, and at most
    ``most`` rows of each set, the first by id, are taken."""
    both = None
    for name, df in sets.items():
        part = df.withColumn("origin", F.lit(name))
        both = part if both is None else both.unionByName(part)
    clash = both.groupBy(key).agg(F.countDistinct("origin").alias("_origins"))
    named = both.join(clash, key).withColumn(key, F.when(F.col("_origins") > 1, F.concat_ws("-", "origin", key)).otherwise(F.col(key).cast("string"))).drop("_origins")
    return named.withColumn("_rn", F.row_number().over(Window.partitionBy("origin").orderBy(key))).where(F.col("_rn") <= most).drop("_rn")


def keep_per_group(df: DataFrame, by: str, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows of each group, by the draw of the key."""
    w = Window.partitionBy(by).orderBy(draw(seed, key), key)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def box_statistics(df: DataFrame, by: str, value: str) -> DataFrame:
    """Quartiles, and whiskers: the last values within one and a half times the middle range."""
    quartiles = percentiles(df, value, [0.25, 0.5, 0.75], [by]).select(by, F.col("p0").alias("q1"), F.col("p1").alias("median"), F.col("p2").alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = df.join(quartiles, by).where(F.col(value).between(F.col("q1") - reach, F.col("q3") + reach))
    return inside.groupBy(by, "q1", "median", "q3").agg(F.min(value).alias("low"), F.max(value).alias("high"))


def label_histogram(df: DataFrame, by: str, value: str, low: float, high: float, bins: int = 30) -> DataFrame:
    """Counts by bin of equal width; values outside aren't counted."""
    inside = df.where((F.col(value) >= low) & (F.col(value) < high))
    return inside.groupBy(by, F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))
