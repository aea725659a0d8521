"""Aggregations beyond those that Spark names."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from rillframe.plans.scratch import Scratch

#: Groups up to which their sketches are broadcast: tens of bytes each and for each fraction.
GROUPS = 100_000
FUNCTIONS = {"SUM": F.sum, "MIN": F.min, "MAX": F.max, "AVG": F.avg, "COUNT": F.count}


def aggregate(df: DataFrame, *steps: tuple[str, str], by: list[str] | None = None) -> DataFrame:
    """Several (function, column) aggregates in one pass, named ``function_column``."""
    return df.groupBy(*(by or [])).agg(*[FUNCTIONS[f.upper()](c).alias(f"{f.lower()}_{c}") for f, c in steps])


def extreme_row(df: DataFrame, fields: list[str], ties: list[str], by: list[str] | None = None, largest: bool = False) -> DataFrame:
    """The whole row with the smallest (largest) fields, compared in their order; of equal rows the
    one with the smallest ``ties``. A partial aggregate keeps a row per group and task."""
    if not largest:
        order = F.struct(*fields, *ties)
        return df.groupBy(*(by or [])).agg(F.min_by(F.struct(*df.columns), order).alias("_r")).select("_r.*")
    best = df.groupBy(*(by or [])).agg(F.max(F.struct(*fields)).alias("_best"))
    same = df.join(best, by) if by else df.crossJoin(F.broadcast(best))  # one row
    kept = same.where(F.struct(*fields) == F.col("_best")).groupBy(*(by or [])).agg(F.min_by(F.struct(*df.columns), F.struct(*ties)).alias("_r"))
    return kept.select("_r.*")


def first_n(df: DataFrame, n: int, by: list[str], order: list[Column | str]) -> DataFrame:
    """The first ``n`` rows of each group in an order that makes the choice repeatable."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Exact counts by value as one sorted map: counted by value first, so what meets in one task
    is a row for each distinct value."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counted.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias("histogram"))


def summary(df: DataFrame) -> DataFrame:
    """One row per column: rows, nulls, values, and whether there are nulls; a single pass."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("_n").alias("total"), (F.col("_n") - F.col(c)).alias("nulls"), F.col(c).alias("non_nulls"), (F.col(c) < F.col("_n")).alias("has_nulls")) for c in df.columns])
    return counts.select(F.inline(rows))


def observed(df: DataFrame, name: str, column: str) -> tuple[DataFrame, Observation]:
    """The rows unchanged, with count, minimum and maximum of a column gathered beside whatever
    job runs over them."""
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("n"), F.min(column).alias("least"), F.max(column).alias("most")), seen


def draw(seed: int, *key: str) -> Column:
    """32 random bits of a seed and a key, by a digest that other engines have too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), *[F.col(c).cast("string") for c in key])), 1, 8), 16, 10).cast("bigint")


def sample_fraction(df: DataFrame, fraction: float, seed: int, replace: bool = False, key: list[str] | None = None) -> DataFrame:
    """Each row with a chance of ``fraction`` or, with ``replace``, as often as a Poisson draw of that
    mean says; by the draw of a key where one is given, which makes the sample the same whatever the
    partitions. A map without a shuffle."""
    if not key:
        return df.sample(replace, fraction, seed)
    if not replace:
        return df.where(draw(seed, *key) < int(fraction * (1 << 32)))
    steps = [int(x * (1 << 32)) for x in poisson_steps(fraction)]
    times = sum((F.when(draw(seed, *key) >= step, 1).otherwise(0) for step in steps), F.lit(0))
    return df.withColumn("_times", F.explode(F.array_repeat(F.lit(1), times))).drop("_times")


def poisson_steps(mean: float) -> list[float]:
    """Where the distribution function of a Poisson variable steps up, as far as 32 bits tell."""
    out, chance, total = [], math.exp(-mean), 0.0
    while total + chance < 1 - 2.0**-32 and len(out) < 200:
        total += chance
        out.append(total)
        chance *= mean / len(out)
    return out


#: Rows of a bucket, about, in which sampled places are looked up.
PLACES = 100_000


def sample_size(df: DataFrame, n: int, seed: int, key: str, replace: bool = False) -> DataFrame:
    """``n`` rows by the draw of the key: repeatable whatever the partitions. Without replacement
    every task hands on ``n`` rows at most.

    With ``replace`` each of ``n`` draws takes one of the rows of the table, in the order of their draws;
    a row comes as often as it is taken. Rows lie in buckets by the first bits of their draw: counts of buckets
    alone are summed up, so the draws fall on buckets multinomially, and only buckets that a draw has
    hit are put in order, each by itself. An empty table gives none."""
    if not replace:
        return df.orderBy(draw(seed, key), key).limit(n)
    rows = df.count()
    bits = min(max(rows // PLACES, 1).bit_length(), 24)
    placed = df.withColumn("_draw", draw(seed, key)).withColumn("_bucket", F.shiftright("_draw", 32 - bits))
    counts = placed.groupBy("_bucket").agg(F.count("*").alias("_n"))  # 2 to the bits rows at most
    starts = counts.withColumn("_start", F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n"))
    picks = df.sparkSession.range(n).select(F.floor(draw(seed + 1, "id") * F.lit(rows) / (1 << 32)).alias("_place"))
    hit = picks.groupBy("_place").agg(F.count("*").alias("_times"))
    spans = F.broadcast(starts)
    hit = hit.join(spans, (F.col("_place") >= F.col("_start")) & (F.col("_place") < F.col("_start") + F.col("_n"))).select("_bucket", (F.col("_place") - F.col("_start")).alias("_at"), "_times")
    near = placed.join(hit.select("_bucket").distinct(), "_bucket", "left_semi")
    near = near.withColumn("_at", F.row_number().over(Window.partitionBy("_bucket").orderBy("_draw", key)) - 1)
    return near.join(hit, ["_bucket", "_at"]).withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_times").cast("int")))).select(*df.columns)


def sample_weighted(df: DataFrame, n: int, seed: int, key: str, weight: str) -> DataFrame:
    """``n`` rows without replacement, each next one with a chance in proportion to its weight among
    those that are left: the rows of the smallest exponential keys, -ln(u) / weight with u by the draw of
    the key. Keys of parts of a table are comparable, so every task hands on ``n`` rows at most. Rows whose
    weight is null or not above zero are never taken."""
    u = (draw(seed, key) + 0.5) / (1 << 32)
    return df.where(F.col(weight) > 0).orderBy(-F.log(u) / F.col(weight).cast("double"), key).limit(n)


def percentiles(df: DataFrame, value: str, fractions: list[float], by: list[str] | None = None, accuracy: int = 2000) -> DataFrame:
    """Exact percentiles with linear interpolation, a row for each group with ``p0``, ``p1``, ... and
    the count ``n``; nulls don't count.

    A sketch gives for each fraction two values between which its ranks surely lie. One more pass
    counts, for each fraction, what lies below and gathers the distinct values between, about one in
    ``accuracy / 4`` of the rows: a task holds that part of a group's values, where Spark's own exact
    percentile holds all. The sketch has a row for each group and is broadcast up to ``GROUPS`` of them.
    """
    by = by or []
    scratch = Scratch(df.sparkSession)
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    margin = 2.0 / accuracy
    marks = [min(max(f + s * margin, 0.0), 1.0) for f in fractions for s in (-1, 1)]
    sketch = rows.groupBy(*by).agg(F.percentile_approx("_v", F.array(*map(F.lit, marks)), accuracy).alias("_a"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.count("*").alias("n"))
    low = lambda k: F.when(F.lit(marks[2 * k] == 0.0), F.col("_least")).otherwise(F.col("_a")[2 * k])
    high = lambda k: F.when(F.lit(marks[2 * k + 1] == 1.0), F.col("_most")).otherwise(F.col("_a")[2 * k + 1])
    several = range(len(fractions))
    spans = scratch.save(sketch.select(*by, "n", *(x for k in several for x in (low(k).alias(f"_low{k}"), high(k).alias(f"_high{k}")))), "spans")
    spans = F.broadcast(spans) if not by or spans.count() <= GROUPS else spans
    bounds = [x for k in several for x in (f"_low{k}", f"_high{k}")]
    joined = rows.join(spans, by) if by else rows.crossJoin(spans)
    # A row of its own for each value between any bounds; all other rows of a group come to one.
    within = F.lit(False)
    for k in several:
        within = within | F.col("_v").between(F.col(f"_low{k}"), F.col(f"_high{k}"))
    counted = joined.groupBy(*by, "n", *bounds, F.when(within, F.col("_v")).alias("_v")).agg(F.count("*").alias("c"), *(F.count_if(F.col("_v") < F.col(f"_low{k}")).alias(f"_below{k}") for k in several))
    at = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"_below{k}").alias("below"), F.when(F.col("_v").between(F.col(f"_low{k}"), F.col(f"_high{k}")), F.col("c")).otherwise(0).alias("inside"), (F.lit(f) * (F.col("n") - 1)).alias("rank")) for k, f in enumerate(fractions)))).alias("_b")
    each = counted.select(*by, "n", "_v", at).select(*by, "n", "_v", "_b.*").where("below > 0 OR inside > 0")
    upto = Window.partitionBy(*by, "k").orderBy(F.asc_nulls_first("_v"))
    below = F.sum("below").over(Window.partitionBy(*by, "k"))
    placed = each.withColumn("end", below + F.sum("inside").over(upto)).where("inside > 0")
    first = F.floor("rank")
    at = lambda r: F.min(F.when(F.col("end") > r, F.col("_v")))
    ranked = placed.groupBy(*by, "k", "n", "rank").agg(at(first).alias("a"), at(F.least(first + 1, F.col("n") - 1)).alias("b"))
    found = ranked.withColumn("p", F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - first))
    return found.groupBy(*by, "n").agg(*[F.max(F.when(F.col("k") == k, F.col("p"))).alias(f"p{k}") for k in several])


def energy_kwh(load: Column, seconds: Column) -> Column:
    """Energy of loads in watts over durations in seconds, summed up, in kilowatt hours. Exact for
    decimals; sums of doubles depend on their order in the last places."""
    return F.sum(load * seconds).cast("double") / 3_600_000


def deviation_ratio(column: Column) -> Column:
    """The sample deviation over the mean; null where the mean is zero."""
    mean = F.avg(column)
    return F.when(mean != 0, F.stddev_samp(column) / mean)
